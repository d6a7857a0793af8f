"""Transcripts and run logs as data sources, in batches and streams, against the column functions."""

import os

from pyspark.sql import functions as F

from crucible.sources import logfiles, readers
from crucible.streaming import streams

HEAD = "---------- TextMessage ({}) ----------"


def put(folder, name, text, at):
    path = folder / name
    path.write_text(text)
    os.utime(path, (at, at))


def test_transcripts(spark, tmp_path):
    logfiles.register(spark)
    for k in range(5):
        put(tmp_path, f"c{k}.txt", "\n".join(["starting", HEAD.format("user"), f"hello {k}", "", "two  ", HEAD.format("agent"), "  x é", *([HEAD.format("empty")] if k == 3 else [])]) + ("\n" if k % 2 else ""), 1000 + k)
    put(tmp_path, "other.md", HEAD.format("user") + "\nno", 2000)
    put(tmp_path, "none.txt", "nothing here", 2001)
    got = spark.read.format("transcripts").option("maxBytes", 100).load(str(tmp_path))
    lines = spark.createDataFrame([(f"c{k}.txt", i, x) for k in range(5) for i, x in enumerate((tmp_path / f"c{k}.txt").read_text().removesuffix("\n").split("\n"))], "file string, line_no int, value string")
    want = readers.parse_conversation(lines)
    key = lambda df: sorted((r.file, r.message, r.agent, r.text) for r in df.collect())
    assert key(got) == key(want) and got.count() == 11
    stream = spark.readStream.format("transcripts").option("maxFilesPerTrigger", 2).load(str(tmp_path))
    out, state = str(tmp_path / "_out"), str(tmp_path / "_state")
    assert key(streams.to_table(stream, out, state)) == key(want)
    put(tmp_path, "late.txt", HEAD.format("user") + "\nlate", 3000)
    assert key(streams.to_table(stream, out, state)) == sorted([*key(want), ("late.txt", 1, "user", "late")])


def test_run_logs(spark, tmp_path):
    logfiles.register(spark)
    text = ["[1/3]  OK  a/f1.png  (2.5s, 3 tools, in=10, out=20)", "loading", "[2/3]  FAILED  f2.b.png  (0.1s, 1 tool, in=1, out=2)", "[3/3] x"]
    put(tmp_path, "run.log", "\n".join(text), 1)
    got = spark.read.format("runlogs").load(str(tmp_path))
    want = readers.parse_run_log(spark.createDataFrame([(x,) for x in text], "value string"))
    assert sorted(map(tuple, got.drop("file").collect())) == sorted(map(tuple, want.collect())) and got.select(F.first("file")).first()[0] == "run.log"
    assert spark.read.format("runlogs").load(str(tmp_path / "nowhere")).count() == 0
