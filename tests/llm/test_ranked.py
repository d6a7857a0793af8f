"""Ranked search against scores of all pairs; sketches bound every score; blocks of items, ties, odd rows, empty tables."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa

from crucible.llm import ranked

TERM = re.compile(ranked.TERM)
DOCS = "doc_id long, text string, _id string, terms long, score double"
ITEMS = "item_id string, text string, _item int, rank int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, k):
    tf = [collections.Counter(TERM.findall(lower(d[1]))) for d in docs]
    lengths = [sum(t.values()) for t in tf]
    n_docs, total = sum(x > 0 for x in lengths), sum(lengths)
    df = collections.Counter(t for c in tf for t in c)
    out = []
    for name, text, *_ in items:
        scores = []
        for (doc, *_), c, n in zip(docs, tf, lengths, strict=True):
            m = n and 75 + 25 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in TERM.findall(lower(text)) if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(name, r + 1, doc, -s) for r, (s, _, doc) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def made(seed=1, n=500):
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice("abcdeéßЖ日Aİ7") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    text = lambda k: rng.choice(" ,\x7f_-\n").join(lexicon[int(300 * rng.random() ** 3)] for _ in range(k))
    docs = [(i, text(rng.choice([0, 1, 3, 30, 80, 300]))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "!? _"), (None, text(40)), (None, text(5)), (n + 3, text(20_000)), docs[8], docs[8], (n + 4, docs[9][1]), (n + 5, docs[9][1])]
    items = [(f"i{k}", text(rng.choice([1, 5, 40]))) for k in range(40)]
    items += [(None, "a b"), ("none", None), ("empty", " ?"), ("unknown", "zzzzzz qqqq"), ("i0", items[0][1]), ("i0", "abc"), ("common", " ".join(lexicon)), ("twice", f"{lexicon[3]} {lexicon[3]} {lexicon[4]}")]
    return [(*d, "x", 1, 0.5) for d in docs], [(*i, 1, 2) for i in items]


def test_equals_scores_of_all_pairs(spark):
    docs, items = made()
    df, asked = spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS).repartition(3)
    index = ranked.build_index(df)
    for k, most_terms in ((20, 1 << 15), (3, 60), (1000, 1 << 15)):
        got = ranked.search(index, asked, k, most_terms=most_terms)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, k)


def test_equal_scores_come_by_id(spark):
    docs = [(90 - i, "same words here" if i % 3 else "other words", "", 0, 0.0) for i in range(90)]
    items = [("a", "same here", 0, 0), ("b", "words", 0, 0)]
    got = ranked.search(ranked.build_index(spark.createDataFrame(docs, DOCS).repartition(7)), spark.createDataFrame(items, ITEMS))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, 20)


def test_empty_tables(spark):
    docs, items = made()
    none, nothing = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert ranked.search(ranked.build_index(none), spark.createDataFrame(items, ITEMS)).count() == 0
    assert ranked.search(ranked.build_index(spark.createDataFrame(docs[:9], DOCS)), nothing).count() == 0
    blank = spark.createDataFrame([(1, " ", "", 0, 0.0), (2, None, "", 0, 0.0)], DOCS)
    assert ranked.search(ranked.build_index(blank), spark.createDataFrame(items, ITEMS)).count() == 0


def index_batch(docs):
    data = "".join(lower(d[1]) for d in docs).encode()
    offsets = np.r_[0, np.cumsum([len(lower(d[1]).encode()) for d in docs])]
    h, count, first, n = ranked.terms_of(np.frombuffer(data, np.uint8), offsets)
    impact = ranked.impacts(count, np.repeat(75 + n, np.diff(first)))
    cells, at = ranked.folded(h, impact, first)
    columns = [pa.array([d[0] for d in docs], pa.int64()), ranked.binaries(h, first), ranked.binaries(impact.astype(np.uint32), first), ranked.binaries(cells, at)]
    return pa.RecordBatch.from_arrays(columns, ["_id", "terms", "impacts", "sketch"])


def test_sketches_bound_scores_and_few_pairs_are_scored(monkeypatch):
    """Bounds are never below the score; of all pairs only those are scored whose bound reaches the threshold."""
    docs, items = made(seed=2, n=3000)
    batch = index_batch([d for d in docs if d[1]])
    words = [(k, t) for k, (_, text, *_) in enumerate(items) for t in TERM.findall(lower(text))]
    data = "".join(t for _, t in words).encode()
    ends = np.cumsum([len(t.encode()) for _, t in words])
    q = ranked.Queries(np.array([k for k, _ in words]), ranked.word_hashes(np.frombuffer(data, np.uint8), np.r_[0, ends[:-1]], ends), np.ones(len(words), np.int64))
    q.weigh(np.full(len(q.known), 5), 3000)
    h, first = ranked.values_of(batch.column("terms"), np.uint64)
    impact, _ = ranked.values_of(batch.column("impacts"), np.uint32)
    bound = q.bounds(*ranked.values_of(batch.column("sketch"), np.uint16))
    hit, slot = q.slots(h)
    keys = np.repeat(np.arange(batch.num_rows), np.diff(first))[hit] * len(q.known) + slot
    doc, item = (x.ravel() for x in np.indices(bound.shape))
    score = q.exact(doc, item, keys, impact[hit].astype(np.int64)).reshape(bound.shape)
    assert (bound >= score).all() and (bound < score + 16 * (q.weight.max() * q.length + 1)).mean() > 0.2
    scored, plain = [], ranked.Queries.exact
    monkeypatch.setattr(ranked.Queries, "exact", lambda self, *a: scored.append(len(a[0])) or plain(self, *a))
    best = ranked.Best(len(q.item), 5)
    ranked.search_batch(q, best, batch, 64)
    assert sum(scored) < bound.size / 4
    ids = np.array(batch.column("_id").fill_null(1 << 40))
    for i in range(len(q.item)):
        want = sorted((-s, d) for s, d in zip(score[:, i].tolist(), ids.tolist(), strict=True) if s > 0)[:5]
        got = [(-s, 1 << 40 if null else d) for s, d, null in zip(best.score[best.item == i].tolist(), best.doc[best.item == i].tolist(), best.null[best.item == i], strict=True)]
        assert got == want
