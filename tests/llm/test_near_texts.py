"""The near-copy stage of the pipeline against brute force over all pairs of texts."""

import random
import re

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def least_ids(rows):
    """The ids that brute force keeps: the smallest of each component; None where a group has no id."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both * 5 >= 4 * (len(sets[i]) + len(sets[j]) - both) > 0:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    ids = {}
    for i, (x, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(x)
    return {min((x for x in g if x is not None), default=None) for g in ids.values()}


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], DOCS)
    return [r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()]


def test_near_copies_like_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    line = " ".join(word() for _ in range(12))
    rows = [(-1, ""), (-2, None), (-3, "one"), (-4, "One"), (-5, "one two three four"), (None, line)]
    for k in range(25):
        base = [word() for _ in range(rng.choice([9, 40, 120, 300]))]
        for n in range(6):
            t = list(base)
            for _ in range(n * len(t) // 120):
                t[rng.randrange(len(t))] = word()
            rows.append((10 * k + n, " ".join(t) + (" " + line if k % 3 == 0 else "")))
    rng.shuffle(rows)
    got = kept(spark, rows)
    assert len(got) == len(set(got))
    assert set(got) == least_ids(rows)


def test_given_documents_like_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert set(kept(spark, rows)) == least_ids(rows)


def test_links_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    """Near copies whose shingles all belong to other texts too, so that none of them is the least of its shingles' rows."""
    import numpy as np

    from crucible import scratch
    from crucible.llm import simhash

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))

    def sets(texts):
        raw = [t.encode() for t in texts]
        return list(simhash.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])].astype(np.int64), 5))

    base = [word() for _ in range(100)]
    near = [" ".join([*base[:k], word(), *base[k + 1 :]]) for k in range(100)]
    low = min(map(simhash.set_class, sets(near)))
    others = []
    for k in range(96):
        window = " ".join(base[k : k + 5])
        own = sets([window])[0][0]
        for found in (t for _ in range(20) for t in [[f"{window} {word()}" for _ in range(500)]]):
            if good := [t for t, x in zip(found, sets(found), strict=True) if x[0] == own and simhash.set_class(x) < low]:
                others.append(good[0])
                break
    assert len(others) > 80
    rows = list(enumerate(others + near))
    made = []

    def counted(df, tag):
        out = scratch.written(df, tag)
        if tag in ("set-links", "group-links"):
            made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (1 << 21, 700):  # the latter: groups are cut into shares
        made.clear()
        out = simhash.near_texts(docs, most_items=most).where("doc_id = component_id").collect()
        assert {r.doc_id for r in out} == least_ids(rows)
        assert sum(made) < 3 * len(rows), made


def test_no_documents(spark):
    assert kept(spark, []) == []


def test_parity_maps_bound_differences():
    import numpy as np

    from crucible.llm import simhash

    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 9000, dtype=np.uint64)
    for n, m, shared in [(10, 12, 8), (300, 320, 280), (4000, 3000, 2900), (4000, 300, 100), (5000, 4000, 0)]:
        a, b = pool[:n], pool[n - shared : n - shared + m]
        apart = simhash.differing(simhash.set_mark(np.sort(a))[1], simhash.set_mark(np.sort(b))[1])
        truly = n + m - 2 * shared
        assert apart <= truly and (apart - truly) % 2 == 0 and apart > 0.25 * min(truly, 2 * min(n, m))
