"""Exactly-once tables: each batch writes a folder of its own and then a small commit file, and readers see committed folders only."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def put_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name and move it into place, so that it is there whole or not at all."""
    to, fs = _file_system(spark, path)
    part, _ = _file_system(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(to):
        fs.delete(to, False)
    if not fs.rename(part, to):
        raise OSError(f"{path} could not be put in place")


def commit(batch: DataFrame, number: int, path: str, writer: str) -> None:
    """Write a batch below ``path`` and record it as number ``number`` of ``writer``.

    A batch that runs again writes another folder and replaces the record, so its rows count once; one that dies before its record is written
    is not seen. Folders without a record are left for ``sweep``.
    """
    spark = batch.sparkSession
    folder = f"data/{writer}-{number:012d}-{uuid.uuid4().hex}"
    batch.write.parquet(f"{path}/{folder}")
    put_file(spark, f"{path}/_commits/{writer}-{number:012d}.json", json.dumps({"writer": writer, "batch": number, "folder": folder}))


def commits(spark: SparkSession, path: str) -> list[dict]:
    """The records of a table, one for each committed batch, in order; their number is that of the batches since the last ``compact``."""
    at, fs = _file_system(spark, f"{path}/_commits")
    if not fs.exists(at):
        return []
    found = [s.getPath().toString() for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")]
    if not found:
        return []
    rows = spark.read.text(found).collect()
    return sorted((json.loads(r.value) for r in rows), key=lambda c: (c["batch"], c["writer"]))


def read_committed(spark: SparkSession, path: str, schema: T.StructType, key: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """The rows of committed batches. With a ``key`` the newest row of each: of the latest batch, and in it the first by ``order``."""
    done = commits(spark, path)
    if not done:
        return spark.createDataFrame([], schema)
    names = schema.fieldNames()
    rows = spark.read.schema(schema).parquet(*[f"{path}/{c['folder']}" for c in done])
    if not key:
        return rows
    newest = F.regexp_extract(F.input_file_name(), r"data/[^/]*-(\d{12})-[0-9a-f]{32}/", 1)
    ranked = rows.withColumn("_batch", newest).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_batch"), *(order or []))))
    return ranked.where("_n = 1").select(*names)


def compact(spark: SparkSession, path: str, schema: T.StructType, key: list[str] | None = None, order: list[Column] | None = None) -> None:
    """Rewrite what is live as one folder, recorded in place of the batches that it holds. No writer may be at work meanwhile."""
    done = commits(spark, path)
    if len(done) < 2:
        return
    last = max(c["batch"] for c in done)
    folder = f"data/compact-{last:012d}-{uuid.uuid4().hex}"
    read_committed(spark, path, schema, key, order).write.parquet(f"{path}/{folder}")
    kept = done[-1]
    put_file(spark, f"{path}/_commits/{kept['writer']}-{kept['batch']:012d}.json", json.dumps({**kept, "folder": folder}))
    for c in done[:-1]:
        p, fs = _file_system(spark, f"{path}/_commits/{c['writer']}-{c['batch']:012d}.json")
        fs.delete(p, False)


def sweep(spark: SparkSession, path: str) -> int:
    """Delete the folders that no record names, and say how many there were. No writer may be at work meanwhile."""
    live = {c["folder"].split("/")[-1] for c in commits(spark, path)}
    at, fs = _file_system(spark, f"{path}/data")
    dead = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in live] if fs.exists(at) else []
    for p in dead:
        fs.delete(p, True)
    return len(dead)


def write_once(stream: DataFrame, path: str, checkpoint: str, each: int | None = None):
    """Each micro-batch of ``stream`` becomes a committed batch at ``path``; the query, which ends with what is there now.

    A checkpoint is a writer of its own: several may write to one table. ``read_committed`` reads it, by key where rows replace earlier ones.
    """
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    out = stream if each is None else stream.repartition(each)
    return out.writeStream.foreachBatch(lambda batch, number: commit(batch, number, path, writer)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
