"""Ties: what stays of equal rows is what the SQL takes in the order of the table."""

import duckdb

from crucible import plans
from crucible.operators import reactiondb
from crucible.plans import hierarchy
from crucible.plans.registry import Tables


def test_recommendation_orders_numbers_and_rounds_like_sql(spark):
    rows = [("a", 10, 1, 9.0, "Recommended"), ("a", 9, 2, 9.0, "Recommended"), ("b", 1, 1, 9.045, "Recommended"), ("c", 1, 1, 9.125, "Recommended"), ("d", 1, 0, 9.0, "Recommended")]
    got = reactiondb.recommendation(spark.createDataFrame(rows, "k string, other long, precedents long, distance double, ranking string"), ["k"]).collect()
    say = lambda o, n, d: f"Use {o} ({n} precedents, distance {duckdb.execute('SELECT printf(?, ?)', ['%.2f', d]).fetchone()[0]})."
    assert {r.k: r.advice for r in got} == {"a": say(9, 2, 9.0), "b": say(1, 1, 9.045), "c": say(1, 1, 9.125), "d": "No recommended alternative has a precedent."}


def test_first_of_equal_lines_stays(spark, sf, tmp_path):
    """Lines 1 and 2 whose parts lie 100,000 apart have one number, and the table has many rows of it, in two files; Spark starts with the larger one."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    rows = f"SELECT (l_orderkey % 50)::BIGINT AS l_orderkey, (l_partkey % 3 + CASE WHEN l_linenumber = 1 THEN 100000 ELSE 0 END)::BIGINT AS l_partkey, least(l_linenumber, 2)::INTEGER AS l_linenumber, * EXCLUDE (l_orderkey, l_partkey, l_linenumber) FROM '{sf}/lineitem.parquet'"
    (tmp_path / "lineitem.parquet").mkdir()
    for k, part in enumerate(("LIMIT 1000", "OFFSET 1000")):
        con.execute(f"COPY ({rows} {part}) TO '{tmp_path}/lineitem.parquet/{k}.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    kept = hierarchy.line_boxes(Tables(spark, str(tmp_path)))
    got = sorted(tuple(r) for r in kept.select("image", "idx", "x1", "y1", "x2", "y2", "l_returnflag").collect())
    assert got == sorted(con.execute(hierarchy.BOXES.rstrip().rstrip(",") + " SELECT image, idx, x1, y1, x2, y2, f FROM b").fetchall())
    for name in ("dedupe_boxes", "match_boxes", "box_overlaps", "box_reaction_match"):
        want = con.execute(plans.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(map(repr, (tuple(r) for r in plans.queries()[name](spark, str(tmp_path)).select(*names).collect()))) == sorted(map(repr, want.fetchall())), name
