"""The registered queries on the smallest tables: against their SQL, or whole and stable where SQL can't express them; and the pipeline, stage by stage."""

import collections
import re

import duckdb
import pytest

import corpus_pipeline
from crucible.llm import queries
from crucible.llm.common import table, written

from test_near_texts import least_ids

TABLES = "documents embeddings pages benchmark labels".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted((tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, db, name):
    got = queries.queries()[name](spark, sf)
    cursor = db.execute(queries.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql()) - {"op4_leaks"}))
def test_has_a_row_for_each_document(spark, sf, name):
    got = [r.doc_id for r in queries.queries()[name](spark, sf).select("doc_id").collect()]
    assert sorted(got) == sorted(r.doc_id for r in table(spark, sf, "documents").select("doc_id").collect())


def grams(text, n):
    w = re.findall(r"[0-9a-z\x80-\xff]+", (text or "").encode().lower().decode("latin1"))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def test_pipeline_stages(spark, sf):
    docs = table(spark, sf, "documents")
    kinds = docs.dtypes
    before = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeated_passages", "benchmark_leaks", "mixture"]

    def step(name, df):
        out = written(stages[name](spark, df, sf), name)
        assert name == "mixture" or out.dtypes == kinds
        return out, {r.doc_id: r for r in out.collect()}

    docs, kept = step("quality", docs)
    scored = {r.doc_id: r.predicted for r in corpus_pipeline.quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()}
    assert set(kept) == {i for i, p in scored.items() if p} and all(kept[i] == before[i] for i in kept)
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    assert sum(labels[i] == 1 for i in before if i in labels and i not in kept) <= 2

    docs, alone = step("near_duplicates", docs)
    assert set(alone) == least_ids([(i, r.text) for i, r in kept.items()])

    docs, cut = step("repeated_passages", docs)
    seen = set()
    for i in sorted(alone):
        w = WORD.findall(alone[i].text or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        assert cut[i].text == (" ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else alone[i].text)
    assert set(cut) == set(alone)

    docs, clean = step("benchmark_leaks", docs)
    items = [grams(r.text, 8) for r in table(spark, sf, "benchmark").collect()]
    assert set(cut) - set(clean) == {i for i, r in cut.items() if any(len(g & grams(r.text, 8)) >= 5 for g in items)}

    _, mixed = step("mixture", docs)
    assert set(mixed) == set(clean)
    total = collections.Counter()
    for i, r in mixed.items():
        assert r.size == len(WORD.findall(clean[i].text or "")) and r.taken <= 3 * r.size
        total[r.source] += r.taken
    for s in total:
        own = [r for r in mixed.values() if r.source == s]
        assert abs(total[s] - own[0].target) <= max(r.size for r in own)
    last = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(tuple, last)) == sorted(map(tuple, mixed.values()))


ODD = "doc_id long, text string, lang string, source string, n_chars int, kept_text string, n_removed int, n_words string, _doc long, _mark string, _rest int, item_id int, matched string, component_id int, held_out int, score string, predicted string"


def odd_rows(spark, n):
    """Good prose of the given table under columns whose names the operators use themselves, with null and repeated ids, null and empty texts."""
    texts = [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").where("length(text) > 300").orderBy("doc_id").limit(12).collect()]
    rows = [(k, texts[k % len(texts)] + (f" tail {k}" if k % 3 else ""), "en", "abc"[k % 3]) for k in range(24)] + [(None, texts[0] + " x y z", "en", None), (None, None, None, "a"), (40, "", "en", "a"), (41, None, "en", "b"), (5, texts[7], "en", "b"), (6, texts[6], "en", "a"), (6, texts[6], "en", "a")]
    more = lambda t: (len(t or ""), "k", 7, "w", 1, "m", 2, 3, "x", 4, 5, "s", "p")
    return spark.createDataFrame([(*r, *more(r[1])) for r in rows[:n]], ODD)


@pytest.mark.parametrize("n", [31, 0])
@pytest.mark.parametrize("name", ["quality", "near_duplicates", "repeated_passages", "benchmark_leaks", "mixture"])
def test_stages_on_odd_rows_and_on_none(spark, sf, name, n):
    docs = odd_rows(spark, n)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
    rows_ = out.collect()
    if name != "mixture":
        assert out.dtypes == docs.dtypes
        before = collections.Counter((r.doc_id, r.lang, *r[5:]) for r in docs.collect())
        assert not collections.Counter((r.doc_id, r.lang, *r[5:]) for r in rows_) - before  # rows pass with all they had
    if name in ("repeated_passages", "mixture"):
        assert len(rows_) == n
    assert not n or rows_
