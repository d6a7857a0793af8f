"""Readers, writers and streams on small files."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from crucible import schemas
from crucible.operators import graph, ranking, rollup, tiers
from crucible.sources import readers, writers
from crucible.streaming import commits, stateful, streams


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(path)


def test_records_and_corrupt_files(spark, tmp_path):
    put(tmp_path / "run1" / "a.json", {"file_name": "a.png", "reactions": [{"reaction_id": "0_1", "reactants": [{"smiles": "C"}], "products": []}]})
    put(tmp_path / "run1" / "b.json", "{broken")
    got = {r.stem: r for r in readers.read_records(spark, str(tmp_path)).collect()}
    assert got["a"].reactions[0].reactants[0].smiles == "C" and got["a"].run == "run1"
    assert got["b"].reactions is None and got["b"]._corrupt_record


def test_extractions_and_sidecars(spark, tmp_path):
    put(tmp_path / "r" / "x.json", {"figure_caption": "c", "reactions": []})
    put(tmp_path / "r" / "x_insight.json", {})
    put(tmp_path / "r" / "x.meta.json", {"stem": "x", "steps": 3, "input_tokens": 10, "output_tokens": 4, "elapsed_s": 1.5})
    assert [r.stem for r in readers.read_extractions(spark, str(tmp_path)).collect()] == ["x"]
    r = readers.read_sidecars(spark, str(tmp_path)).first()
    assert (r.run, r.stem, r.input_tokens) == ("r", "x", 10)


def test_suites(spark, tmp_path):
    put(tmp_path / "s.json", {"suite_id": "s", "vision_model": "m", "per_image": [{"image": "a", "elapsed_s": 1.0}, {"image": "b", "elapsed_s": 2.0}]})
    got = readers.read_suites(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.image, r.model, r.suite_elapsed_s) for r in got] == [("a", "m", 3.0), ("b", "m", 3.0)]


def test_run_log_and_conversation(spark):
    log = spark.createDataFrame([("[3/16] OK  name.png (37.3s, 9 tools, in=10006, out=1574)",), ("noise",)], "value string")
    r = readers.parse_run_log(log).first()
    assert (r.stem, r.ok, r.elapsed_s, r.tool_calls, r.input_tokens, r.output_tokens) == ("name", True, 37.3, 9, 10006, 1574) and readers.parse_run_log(log).count() == 1
    lines = ["before", "---------- TextMessage (user) ----------", "hi", "there", "---------- TextMessage (bot) ----------", "yes"]
    df = spark.createDataFrame([("f", k, v) for k, v in enumerate(lines)], "file string, line_no int, value string")
    assert [(r.agent, r.text) for r in readers.parse_conversation(df).orderBy("message").collect()] == [("user", "hi\nthere"), ("bot", "yes")]


def test_xml(spark, tmp_path):
    one = "<reaction><reactionSmiles>C.N>O>CN</reactionSmiles><productList><product><identifier dictRef='cml:smiles'>CN</identifier></product></productList><reactantList><reactant><identifier dictRef='cml:smiles'>C</identifier></reactant></reactantList><spectatorList><spectator role='solvent'><identifier dictRef='cml:smiles'>O</identifier></spectator></spectatorList><source><documentId>US1</documentId></source></reaction>"
    r = readers.read_reaction_xml(spark, put(tmp_path / "a.xml", f"<reactionList>{one}{one}</reactionList>"))
    assert r.count() == 2
    assert (r.first().REACTANTS, r.first().PRODUCTS, r.first().SOLVENT, r.first().REF, r.first().product) == ("C.N", "CN", "O", "US1", "CN")


def test_ord(spark, tmp_path):
    part = lambda s, role: {"identifiers": [{"type": "NAME", "value": "x"}, {"type": "SMILES", "value": s}], "reaction_role": role}
    doc = {"reaction_id": "r", "inputs": {"a": {"components": [part("C", "REACTANT"), part("O", "SOLVENT")]}, "b": {"components": [part("N", "REACTANT"), part("CO", "SOLVENT")]}}, "outcomes": [{"reaction_time": {"value": 2.0, "units": "HOUR"}, "products": [{"identifiers": [{"type": "SMILES", "value": "CN"}], "is_desired_product": True, "measurements": [{"type": "YIELD", "percentage": {"value": 70.0}}]}, {"identifiers": [], "is_desired_product": False, "measurements": [{"type": "YIELD", "percentage": {"value": 90.0}}]}]}, {"products": []}]}
    r = readers.flatten_ord(spark.read.schema(readers.ORD).json(put(tmp_path / "o.json", doc), multiLine=True)).first()
    assert (r.REACTION, r.SOLVENT, r.time, r.YIELD) == ("C.N>>CN", "CO.O", 2.0, 70.0)


def test_csv_trend_dimension(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("file_name,solvent\na,\xe9ther\n".encode("latin-1"))
    assert readers.read_gold_csv(spark, str(tmp_path / "g.csv")).first().solvent == "éther"
    put(tmp_path / "t.csv", "year,a,b\n2000,1,x\n2001,2,3\n")
    assert {(r.year, r.series): r.value for r in readers.read_trend(spark, str(tmp_path / "t.csv")).collect()} == {(2000, "a"): 1.0, (2000, "b"): None, (2001, "a"): 2.0, (2001, "b"): 3.0}
    put(tmp_path / "d.csv", "key,name\nk,b\nk,a\n")
    assert readers.read_dimension(spark, str(tmp_path / "d.csv"), "key").first().name == "a"


def test_corpus_and_runs(spark, tmp_path):
    put(tmp_path / "r1" / "a.json", "{}")
    put(tmp_path / "r2" / "b.json", "{}")
    put(tmp_path / "r2" / "c.txt", "x")
    files = readers.list_corpus(spark, str(tmp_path), "json")
    assert sorted(r.stem for r in files.collect()) == ["a", "b"]
    assert {r.run: r.files for r in readers.list_runs(files, limit=0).collect()}.keys() <= {"r1", "r2"} and readers.list_runs(files, limit=9).count() == 2


def test_ghs(spark):
    info = lambda ref, name, *values: {"ReferenceNumber": ref, "Name": name, "Value": {"StringWithMarkup": [{"String": v} for v in values]}}
    doc = {"Record": {"RecordTitle": "X", "Section": [{"TOCHeading": "Safety and Hazards", "Section": [{"TOCHeading": "Hazards Identification", "Section": [{"TOCHeading": "GHS Classification", "Information": [info(2, "GHS Hazard Statements", "H225: Highly flammable", "H319 (50%): Irritates"), info(2, "Signal", "Danger"), info(9, "GHS Hazard Statements", "H999: other")]}]}]}], "Reference": [{"ReferenceNumber": 2, "SourceName": "ECHA list"}, {"ReferenceNumber": 9, "SourceName": "ECHA later"}]}}
    r = readers.read_ghs(spark.createDataFrame([(json.dumps(doc),)], "document string")).first()
    assert r.codes == ["H225", "H319"] and r.signal == "Danger" and "Highly flammable" in r.statements


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, ["x", "y"]), ("b", 2, [])], "system string, n int, tags array<string>")
    writers.write_csv(df, str(tmp_path / "c"), ["system", "tags", "absent"])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True).orderBy("system").collect()] == [("a", "x|y", None), ("b", None, None)]
    for n in (2, 3):
        writers.replace_partition(df.where("system = 'b'").withColumn("n", F.lit(n)), str(tmp_path / "p"), "system")
        writers.replace_partition(df.where("system = 'a'"), str(tmp_path / "p"), "system")
    assert sorted((r.system, r.n) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [("a", 1), ("b", 3)]
    writers.write_report(df, str(tmp_path / "r"), ["system"])
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    writers.write_patterns(spark.createDataFrame([("1", "b", "s"), ("1", "a", "t")], "class string, name string, smirks string"), str(tmp_path / "j"), ["name"])
    assert [r.name for r in readers.read_patterns(spark, str(tmp_path / "j")).orderBy("pos").collect()] == ["a", "b"]
    merged = writers.merge_chunks([df.select("system", "n"), spark.createDataFrame([("c", "x", 1.0)], "system string, n string, extra double")])
    assert dict(merged.dtypes) == {"system": "string", "n": "string", "extra": "double"} and merged.count() == 3
    assert writers.pending(df, df.where("n = 1"), "system").first().system == "b"


def test_streams_equal_batch(spark, tmp_path):
    for k in range(6):
        put(tmp_path / "in" / f"r{k % 2}" / f"{k}.meta.json", {"stem": str(k), "input_tokens": 10 * k, "output_tokens": k, "elapsed_s": 1.0})
    live = streams.to_table(streams.running_costs(streams.sidecar_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "check"), "complete")
    batch = rollup.cost_summary(readers.read_sidecars(spark, str(tmp_path / "in")), ["run"])
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))


def events(spark, tmp_path, rows):
    spark.createDataFrame(rows, "run string, time timestamp, kind string").coalesce(1).write.parquet(str(tmp_path / "events"))
    return spark.readStream.schema("run string, time timestamp, kind string").parquet(str(tmp_path / "events"))


def at(minute):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_windows_sessions_and_first_wins(spark, tmp_path):
    rows = [("a", at(0), "x"), ("a", at(3), "x"), ("b", at(3), "x"), ("a", at(30), "x")]
    stream = events(spark, tmp_path, rows)
    out = streams.to_table(streams.windowed_counts(stream, "time", ["run"], "10 minutes"), str(tmp_path / "w"), str(tmp_path / "wc"), "complete")
    assert sorted((r.run, r.n) for r in out.collect()) == [("a", 1), ("a", 2), ("b", 1)]
    out = streams.to_table(streams.session_counts(stream, "time", ["run"], "5 minutes"), str(tmp_path / "s"), str(tmp_path / "sc"), "complete")
    assert sorted((r.run, r.n) for r in out.collect()) == [("a", 1), ("a", 2), ("b", 1)]
    out = streams.to_table(streams.first_wins(stream, "run", "time"), str(tmp_path / "f"), str(tmp_path / "fc"))
    assert sorted(r.run for r in out.collect()) == ["a", "b"]


def test_stuck_runs(spark, tmp_path):
    rows = [("many", at(k), "step") for k in range(6)] + [("good", at(0), "step"), ("good", at(1), "done")]
    out = streams.to_table(streams.stuck_runs(events(spark, tmp_path, rows), "run", "time", "kind", steps=4), str(tmp_path / "o"), str(tmp_path / "c"))
    assert [(r.run, r.alert, r.steps) for r in out.collect()] == [("many", "steps", 6)]


def test_write_once_over_many_batches(spark, tmp_path):
    """Files of shared keys, one a batch; a second writer; a batch that is committed again; a dead one; by key; compacted."""
    out, kind = str(tmp_path / "o"), "run string, n long"
    for k in range(4):
        spark.createDataFrame([("a", k), (f"r{k}", k)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    schema = stream.schema
    assert commits.read_committed(spark, out, schema).count() == 0
    streams.write_once(stream, out, str(tmp_path / "c0")).awaitTermination()
    rows = lambda **k: sorted(map(tuple, commits.read_committed(spark, out, schema, **k).collect()))
    want = sorted([("a", k) for k in range(4)] + [(f"r{k}", k) for k in range(4)])
    assert rows() == want and len(commits.commits(spark, out)) == 4
    streams.write_once(stream, out, str(tmp_path / "c0")).awaitTermination()  # the same checkpoint: nothing is new
    assert rows() == want
    writer = commits.commits(spark, out)[0]["writer"]
    again = spark.read.schema(schema).parquet(f"{out}/{commits.commits(spark, out)[2]['folder']}")
    commits.commit(again, 2, out, writer)
    again.write.parquet(f"{out}/data/{writer}-000000000009-dead")
    assert rows() == want
    assert rows(key=["run"]) == [("a", 3), *((f"r{k}", k) for k in range(4))]
    assert commits.sweep(spark, out) == 2 and rows() == want
    commits.compact(spark, out, schema, ["run"])
    assert len(commits.commits(spark, out)) == 1 and rows() == [("a", 3), *((f"r{k}", k) for k in range(4))]
    commits.commit(spark.createDataFrame([("a", 9)], kind), 4, out, writer)
    assert rows(key=["run"])[0] == ("a", 9) and len(rows()) == 6


def test_graph(spark):
    db = spark.createDataFrame([("r1", "X.W", "A", "THF", "p1"), ("r2", "Y", "X", "THF", "p1"), ("r3", "Z", "Y.Q", "", None)], "REACTION string, PRODUCTS string, REACTANTS string, SOLVENT string, REF string")
    nodes, edges = graph.nodes_and_edges(db)
    names = {r.id: r.key for r in nodes.collect()}
    assert {(names[r.src], names[r.dst]) for r in graph.precedes(edges).collect()} == {("r1", "r2"), ("r2", "r3")}
    start = nodes.where("key = 'r1'").select(F.col("id").alias("node"))
    assert {(names[r.node], r.hops) for r in graph.khop(graph.precedes(edges), start, 5).collect()} == {("r1", 0), ("r2", 1), ("r3", 2)}
    assert {r.name: r["count"] for r in graph.stats(nodes, edges).collect()}["USES_SOLVENT"] == 2
    assert graph.reactions_by(nodes, edges, F.col("key") == "r2").first().USES_SOLVENT == "THF"


def test_tiers_and_lookups(spark):
    known = spark.createDataFrame([("1",), ("1.2",), ("1.2.3",), ("2",)], "class string")
    got = {(r.spec, r["class"]) for r in tiers.expand_classes(spark.createDataFrame([("1.*",), ("1.**",), ("2",)], "spec string"), known).collect()}
    assert got == {("1.*", "1.2"), ("1.**", "1.2"), ("1.**", "1.2.3"), ("2", "2")}
    rows = spark.createDataFrame([(1, "1", "1.2", "1.2.9"), (2, "3", "3.1", None), (3, "1", "1.2", "1.2.3")], "k int, t1 string, t2 string, t3 string")
    assert {r.k: r.true_class for r in tiers.resolve_true_class(rows, spark.createDataFrame([("1.2.3",)], "class string"), ["t1", "t2", "t3"], "k").collect()} == {1: "1.2", 3: "1.2.3"}
    assert {r["class"] for r in tiers.class_members(spark.createDataFrame([("1.2",)], "wanted string"), spark.createDataFrame([("1.2.3",), ("1.20",)], "class string")).collect()} == {"1.2.3"}
    df = spark.createDataFrame([("c", "g1", 9, "a"), ("c", "g1", 8, "b"), ("c", "g1", 7, "d"), ("c", "g2", 1, "e")], "c string, g string, n int, t string")
    assert sorted(r.t for r in tiers.diverse_topn(df, ["c"], "g", "n", "t", 3).collect()) == ["a", "b", "e"]
    near = ranking.nearest(spark.createDataFrame([("a", 0.0), ("b", 0.0), ("c", 2.0)], "k string, x double"), "k", ["x"], 1)
    assert {r.k: r.other for r in near.collect()} == {"a": "b", "b": "a", "c": "a"}


def test_atom_filter(spark):
    df = spark.createDataFrame([({"C": 2, "N": 1},), ({"C": 2},), ({"C": 2, "O": 1},)], "m map<string, int>")
    fits = lambda spec, strict=False: [r[0] for r in df.select(tiers.atom_filter(spec, F.col("m"), strict)).collect()]
    assert fits({"C": 2}) == [True] * 3 and fits({"C": 2}, True) == [False, True, False] and fits({"N": None}) == [True, False, False] and fits({}) == [False] * 3 and fits({"C": [1, 2], "O": 1}) == [False, False, True]


def test_gold_json_is_one_row_or_many(spark, tmp_path):
    path = put(tmp_path / "g.json", [{"file_name": "a"}, {"file_name": "b"}])
    assert readers.read_gold_json(spark, path, schemas.RECORD).count() == 2
    assert readers.read_gold_json(spark, put(tmp_path / "h.json", {"file_name": "a"}), schemas.RECORD).count() == 1


@pytest.mark.parametrize("missing", [True, False])
def test_compare_and_fallback(spark, missing):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double")
    b = spark.createDataFrame([("x", 3.0)] + ([] if missing else [("y", 1.0)]), "k string, v double")
    got = {r.k: (r.delta, r.improved) for r in rollup.compare_runs(a, b, "k", "v").collect()}
    assert got == {"x": (2.0, True), "y": (None, None) if missing else (-1.0, False)}


def test_run_alerts_over_batches(spark, tmp_path):
    """Five batches: a run over its steps, one that is done, one that goes silent and times out, one that is still open; and what the state holds."""
    kind = "run string, time timestamp, kind string"
    hours = [[("many", 0, "a"), ("done", 0, "a"), ("quiet", 0, "a"), ("open", 0, "b")], [("many", 1, "a"), ("many", 1, "b"), ("done", 1, "done"), ("open", 1, "a")], [("many", 2, "a"), ("open", 2, "a")], [("open", 3, "a")], [("open", 4, "c")]]
    for k, rows in enumerate(hours):
        spark.createDataFrame([(r, datetime.datetime(2024, 1, 1, h), c) for r, h, c in rows], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with stateful.rocksdb(spark):
        got = streams.to_table(stateful.run_alerts(stream, "run", "time", "kind", steps=3, minutes=90), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {tuple(r) for r in got.collect()} == {("many", "steps", 4, "a:3,b:1"), ("many", "timeout", 4, "a:3,b:1"), ("open", "steps", 4, "a:3,b:1"), ("quiet", "timeout", 1, "a:1")}
    total = stateful.state_rows(spark, str(tmp_path / "state"), "total").select("run", "n", "alerted").collect()
    assert [tuple(r) for r in total] == [("open", 5, True)]
    assert {tuple(r) for r in stateful.state_rows(spark, str(tmp_path / "state"), "kinds").collect()} == {("open", "a", 3), ("open", "b", 1), ("open", "c", 1)}
