"""WARC archives with a two-level capture index: sorted reversed-host keys in compressed blocks, and a sparse directory of them.

Archives are files of gzip members, one for each record, written and read in ranges through ``pyarrow.fs`` at the URI of the shared folder
(file, hdfs, s3 or gs). Only files named in a committed manifest count, so retried or repeated tasks leave no record twice.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crucible.llm.common import scratch_path, written

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
LAST_ID = (1 << 63) - 1
MANIFEST = "key string, page_id long, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1, 20 bits at a time, without Python."""
    digest = F.sha1(payload)
    letters = []
    for k in range(8):
        n = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.when(digest.isNotNull(), F.concat(*letters))


def surt(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then path and query; fragments and scheme don't count."""
    if not url:
        return ")/"
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").rstrip(".").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return f"){url.strip().lower()}"
    if not host:
        return f"){url.strip().lower()}"
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + port + ")" + path.lower()


def capture_key(url: str | None, page_id: int) -> str:
    """Keys of one URL sort by page id, which is always two's complement at fixed width."""
    return f"{quote(surt(url), safe='/,:?=&)%~.-_!')} {page_id + (1 << 63):020d}"


# --- records -------------------------------------------------------------------------------------------------------


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """A gzip member with one WARC/1.1 record; a revisit has the HTTP head only, which states the length of what it stands for."""
    clean = lambda u: quote(u or "about:blank", safe=":/?#[]@!$&'()*+,;=%~")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {clean(refers_url)}"]
    block = http + (payload if refers_to is None else b"")
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n") + packer.flush()


def parsed(member: bytes) -> dict:
    """What a record says and holds; the digest of a response is that of the bytes read, and must be the one stated."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']} is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != stated):
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't match its digest")
    page = lambda x: int(x.removeprefix("<urn:page:").rstrip(">"))
    return {
        "page_id": page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "payload_bytes": size, "payload_digest": stated,
    }


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder as Spark names it, and the path on it: ``s3a`` is ``s3`` here, ``dbfs`` is mounted."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    if uri.startswith("dbfs:"):
        return fs.LocalFileSystem(), re.sub("^dbfs:/*", "/dbfs/", uri)
    uri = re.sub("^s3[an]://", "s3://", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


# --- writing -------------------------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", most: int = 256 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row to archives under ``folder``; returns the manifest (key, page_id, file, offset, length).

    Of rows with equal payloads the one with the smallest id (then url) is the response, the others revisit it. Null html is an empty
    payload, and empty payloads are equal too. A null id counts as the largest id. Rows equal in id, url and payload are all responses.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    marks = written(rows.select("page_id", "url", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").alias("size")), "page-digests")
    least = written(marks.groupBy("digest", "size").agg(F.min(F.struct("page_id", "url")).alias("first")), "payloads")
    roles = written(marks.distinct().join(least, ["digest", "size"]).select("page_id", "url", "digest", "first"), "roles")
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    same = (rows.page_id == roles.page_id) & rows.url.eqNullSafe(roles.url) & (rows.digest == roles.digest)
    joined = rows.join(roles.hint("shuffle_hash"), same).select(rows.page_id, rows.url, rows.payload, rows.digest, "first")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _place(folder)
        out, name, at = None, "", 0
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if out is None:
                    name, at = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                first = row["first"]
                revisit = (first["page_id"], first["url"]) != (row["page_id"], row["url"])
                member = record(row["page_id"], row["url"], row["payload"], row["digest"], first["page_id"] if revisit else None, first["url"], date)
                out.write(member)
                made.append({"key": capture_key(row["url"], row["page_id"]), "page_id": row["page_id"], "file": name, "offset": at, "length": len(member)})
                at += len(member)
                if at >= most:
                    out = out.close()
            if made:
                yield pa.RecordBatch.from_pylist(made, pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        if out is not None:
            out.close()

    return written(joined.mapInArrow(write, MANIFEST), "manifest")


# --- the index -----------------------------------------------------------------------------------------------------


def write_index(manifest: DataFrame, lines: int = 300) -> tuple[DataFrame, DataFrame]:
    """(blocks, directory): captures sorted by key in compressed blocks of ``lines`` lines, and each block's first and last key and place.

    Ranges of keys are dealt to tasks, so the blocks of all tasks in order are one sorted list.
    """
    ordered = manifest.select(F.concat_ws("\t", "key", "file", "offset", "length").alias("line"), "key").repartitionByRange("key").sortWithinPartitions("key")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        part, n = TaskContext.get().partitionId(), 0

        def block() -> pa.RecordBatch:
            nonlocal n
            n += 1
            packed = zlib.compress("\n".join(held).encode(), 6)
            ends = [pa.array([line.split("\t", 1)[0]]) for line in (held[0], held[-1])]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + n]), *ends, pa.array([packed], pa.binary())], ["block", "first_key", "last_key", "packed"])

        for batch in batches:
            for line in batch.column("line").to_pylist():
                held.append(line)
                if len(held) == lines:
                    yield block()
                    held.clear()
        if held:
            yield block()

    blocks = written(ordered.mapInArrow(cut, "block long, first_key string, last_key string, packed binary"), "index-blocks")
    return blocks, blocks.select("first_key", "last_key", "block")


def lookup(keys: DataFrame, blocks: DataFrame, directory: DataFrame, stretches: int | None = None) -> DataFrame:
    """Captures (key, file, offset, length) of the distinct keys in ``keys``, by binary search in the directory, then within blocks.

    Directory and keys are cut alike into ``stretches`` of keys (as many as shuffle partitions, by default) and meet stretch by stretch. An
    entry goes to every stretch that its block's keys reach into, so each stretch holds all it needs; the driver gets the cuts alone.
    """
    n = stretches or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = directory.repartitionByRange(n, "first_key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("first_key").alias("k")).collect()
    cuts = sorted(r["k"] for r in ranked if r["k"] is not None)[1:]

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last, block = (batch.column(c).to_pylist() for c in ("first", "last", "block"))
            rows = [(s, k, b) for k, z, b in zip(first, last, block, strict=True) for s in range(bisect_right(cuts, k), bisect_right(cuts, z) + 1)]
            s, k, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(b, pa.int64()), pa.array(k, pa.string())], ["stretch", "block", "key"])

    entries = directory.select(F.col("first_key").alias("first"), F.col("last_key").alias("last"), "block").mapInArrow(deal, "stretch int, block long, key string")
    wanted_ = keys.select(F.col("key").alias("first"), F.col("key").alias("last"), F.lit(None).cast("long").alias("block")).mapInArrow(deal, "stretch int, block long, key string")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each stretch first its directory, then its keys, in order."""
        now, first, block = None, [], []
        for batch in batches:
            found = []
            for s, b, k in zip(*(batch.column(c).to_pylist() for c in ("stretch", "block", "key")), strict=True):
                if s != now:
                    now, first, block = s, [], []
                if b is not None:
                    first.append(k)
                    block.append(b)
                else:
                    found += [(block[i], k) for i in range(max(0, bisect_left(first, k) - 1), bisect_right(first, k))]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([k for _, k in found], pa.string())], ["_block", "key"])

    both = entries.union(wanted_).repartition(n, "stretch").sortWithinPartitions("stretch", F.col("block").isNull(), "key", "block")
    asked = both.mapInArrow(search, "_block long, key string")
    # a block has at most its number of lines of distinct keys
    wanted = written(asked.groupBy("_block").agg(F.collect_set("key").alias("keys")), "index-lookups")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for packed, keys in zip(batch.column("packed").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                lines = [line.split("\t") for line in zlib.decompress(packed).decode().split("\n")]
                ordered = [x[0] for x in lines]
                for key in keys:
                    found += lines[bisect_left(ordered, key) : bisect_right(ordered, key)]
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(list(map(int, columns[2])), pa.int64()), pa.array(list(map(int, columns[3])), pa.int64())], ["key", "file", "offset", "length"])

    return blocks.join(wanted, blocks.block == wanted._block).select("packed", "keys").mapInArrow(read, "key string, file string, offset long, length long")


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records at (file, offset, length) under ``folder``, by range reads in ascending order of each file."""

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _place(folder)
        name, source = None, None
        for batch in batches:
            out = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    name, source = file, store.open_input_file(f"{base}/{file}")
                out.append(parsed(source.read_at(length, offset)))
            yield pa.RecordBatch.from_pylist(out, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]))

    stretch = F.floor(F.col("offset") / (16 << 20))  # a long file is read by several tasks
    return captures.select("file", "offset", "length").repartition("file", stretch).sortWithinPartitions("file", "offset").mapInArrow(fetch, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None, lines: int = 300) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to), one for each row of ``pages``, as read back from archives.

    Writes the archives and the index, looks up every page's key in it and reads the records it points to. See ``write_archives`` for nulls
    and repeated rows; an empty table gives an empty result. A page of any length is one record, held whole by the task that writes or reads it.
    Other columns are not read, whatever their names.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or scratch_path(spark, "archives")
    manifest = write_archives(pages, folder)
    blocks, directory = write_index(manifest, lines)
    captures = written(lookup(manifest.select("key").distinct(), blocks, directory), "captures")
    null = lambda c: F.when(F.col(c) != LAST_ID, F.col(c)).alias(c)
    return read_records(captures, folder).select(null("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, upper(sha1(b)) AS h, min(page_id) OVER (PARTITION BY sha1(b), octet_length(b)) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(k // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - k % 4 * 5 AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
