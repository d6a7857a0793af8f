"""Each operator against a plain brute-force version, and on nulls, empty and repeated rows, empty tables and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from crucible.llm import embeddings, leaks, mixing, quality, simhash, substrings, tokens, warc

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _text string, size long, score double"


def words(text):
    return WORD.findall(text or "")


def made(seed=1, n=60):
    """Documents with exact and near copies, shared passages, nulls, empty, short and long texts, repeated ids and rows."""
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    text = lambda k: " ".join(rng.choice(lexicon) for _ in range(k))
    passage, rows = text(45), []
    for i in range(n):
        t = text(rng.choice([1, 5, 19, 20, 60, 200]))
        if i % 5 == 0:
            t += "\n" + passage + " " + text(10)
        if i % 7 == 3 and rows:
            t = rows[rng.randrange(len(rows))][1]
        if i % 11 == 4 and rows and rows[-1][1]:
            t = rows[-1][1].replace(" ", "  ", 3) + " x"
        rows.append((i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), 0))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, " \n\t ", "en", "a", 0), (n + 3, "the the " * 60, "en", "a", 0), (None, text(30), "de", "b", 0), (n + 4, text(4000), "en", "c", 0)]
    rows += [rows[2], rows[2]]
    return [(*r, "clash", 7, 0.5) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    rows = made()
    return rows, spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def components(keys, linked):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in keys}


# --- 2


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    rows, base = [], rng.standard_normal((12, 16))
    for i in range(260):
        v = base[rng.integers(12)] + rng.standard_normal(16) * rng.choice([0, 0.05, 0.1, 0.2, 2])
        rows.append((i, [float(np.float32(x)) for x in v * rng.uniform(0.5, 2)], int(rng.integers(2)), "x"))
    rows += [(300, None, 1, "x"), (301, [0.0] * 16, 1, "x"), (302, [float("nan")] + [1.0] * 15, 1, "x"), (303, [None] + [1.0] * 15, 1, "x"), (304, rows[0][1], None, "x"), (305, [1.0] * 8, 1, "x"), (306, [1.0] * 8, 1, "x"), (307, [], 1, "x")]
    rows += [(400 + k, rows[5][1], rows[5][2], "x") for k in range(3)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, copies string"), block=16).collect()}
    assert len(got) == len(rows)
    good = {i: np.array(v, dtype=float) for i, v, label, _ in rows if v and label is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {r[0]: r[2] for r in rows}
    close = lambda a, b: len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98
    links = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and close(good[a], good[b])]
    n = collections.Counter(x for pair in links for x in pair)
    group = components([r[0] for r in rows], links)
    assert sum(n.values()) > 200
    for i, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (n[i], group[i], group[i] == i), i
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embeddings_of_any_finite_size(spark):
    sizes = [1e200, 3e307, 1e-200, 5e-324, 1.0]
    rows = [(10 * k + d, [size] * 2 if d < 2 else [size, -size], 1) for k, size in enumerate(sizes) for d in range(3)] + [(90, [float("inf"), 1.0], 1), (91, [0.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (0, i) if i >= 90 else (9, 0) if i % 10 < 2 else (4, 2) for i, _, _ in rows}


def test_embedding_bounds():
    """Bounds by popcounts hold, and estimates are unbiased, for near and far pairs of any length."""
    rng = np.random.default_rng(3)
    for d in (16, 64, 100, 768):
        x = rng.standard_normal((400, d))
        x[200:] = x[:200] + rng.standard_normal((200, d)) * rng.choice([0.05, 0.3, 2], (200, 1))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        codes = embeddings.Codes.of(x @ embeddings.rotations(d, 1)[0])
        i, j = np.r_[np.arange(200), rng.integers(0, 400, 2000)], np.r_[np.arange(200, 400), rng.integers(0, 400, 2000)]
        true = np.einsum("nd,nd->n", x[i], x[j])
        assert (codes.upper(i, j, 6.0) >= true - 1e-9).mean() > 0.999
        assert abs((codes.upper(i, j, 0.0) - true).mean()) < 0.02


def test_embeddings_of_many_dimensions(spark):
    """Text labels, 384 coordinates, 1,500 rows: every link of all pairs."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 384))
    rows = [(k, [float(np.float32(v)) for v in base[k % 300] + rng.standard_normal(384) * rng.choice([0.05, 0.15, 0.2, 0.22])], "pq"[k % 300 % 2]) for k in range(1500)]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    assert near.sum() > 400 and [got[k] for k in range(1500)] == near.sum(axis=1).tolist()


# --- 3


def kept_words(rows, window=20):
    first, out = {}, []
    order = sorted({(i is None, i or 0, t or "") for i, t, *_ in rows})
    # rows that share an id aren't ordered by the contract: only equal ones occur here
    for none, i, t in order:
        w = words(t)
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (none, i, s))
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i is None, i or 0, s):
                gone[s : s + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize(("block", "bits"), [(16_384, 26), (2, 26), (512, 10)])
def test_substrings(docs, nothing, block, bits):
    rows, df = docs
    got = substrings.deduplicate(df, block=block, map_bits=bits, keep=("source", "_text")).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == kept_words(rows)
    assert sum(r.n_removed for r in got) > 500
    assert all(r.kept_text == next(t for i, t, *_ in rows if i == r.doc_id) for r in got if not r.n_removed)
    assert substrings.deduplicate(nothing).count() == 0


def test_fm_index_against_counting():
    rng = random.Random(4)
    for _ in range(20):
        w = rng.choice([1, 2, 3, 5])
        base = [rng.randrange(5) for _ in range(60)]
        cut = [base[a : a + w + rng.randrange(12)] for a in (rng.randrange(45) for _ in range(rng.randrange(1, 9)))]
        order = np.array([(rng.randrange(3) << 32) + 1000 * k for k in range(len(cut))])
        first = {}
        for k, s in enumerate(cut):
            for i in range(len(s) - w + 1):
                first[tuple(s[i : i + w])] = min(first.get(tuple(s[i : i + w]), 1 << 62), order[k] + i)
        got = substrings.earlier(np.array(sum(cut, []), dtype=np.uint64), np.r_[0, np.cumsum([len(s) for s in cut])], order, w)
        assert {(int(k), int(i)): bool(x) for k, i, x in zip(*got, strict=True)} == {(k, i): first[tuple(s[i : i + w])] < order[k] + i for k, s in enumerate(cut) for i in range(len(s) - w + 1)}


def test_index_is_smaller_than_its_words():
    rng = np.random.default_rng(1)
    text = np.minimum(rng.zipf(1.3, 200_000), 4000)
    text[::40] = 0
    index = substrings.FMIndex(text, 20, np.arange(len(text)))
    assert index.tree.levels * 1.4 / 8 + 14 > index.nbytes() / len(text)  # the tree, and 12 bytes for each stretch, here nearly one a symbol
    at = rng.integers(0, len(text), 500)
    bits = substrings.Bits(text % 3 == 0)
    assert (bits.rank(at) == np.cumsum(np.r_[0, text % 3 == 0])[at]).all()


# --- 4


def test_leaks(spark, docs, nothing):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([8, 15, 40, 80])] + [(9, None), (None, "a b c d e f g h"), (10, "")]
    filler = lambda n: " ".join(word() for _ in range(n))
    spoilt = items[2][1].split()
    for k in range(3, 40, 9):
        spoilt[k] = word()
    texts = [filler(30) + " " + items[0][1], items[1][1].upper().replace(" ", ", ") + "! " + filler(9), filler(50) + "\n" + " ".join(spoilt) + " " + filler(4), filler(5) + " " + " ".join(items[3][1].split()[20:45]), filler(200), " ".join(items[3][1].split()[:7]) + " " + filler(20), None, ""]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, item_id int, matched string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(df, bench).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}
    clean = leaks.without_leaks(df, bench)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [4, 5, 6, 7]
    assert leaks.leaks(df, bench.limit(0)).count() == 0 and leaks.leaks(nothing, bench).count() == 0 and leaks.without_leaks(df, bench.limit(0)).count() == 8


def brute_leaks(docs_, items, words_=12, share=0.6):
    """Every diagonal of every document and item that holds a seed; the best stretch along it by trying all."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", lower(t).encode())
    out = {}
    for d, text in docs_:
        w = split(text)
        for i, item in items:
            v = split(item)
            if i is None or not v:
                continue
            masks = leaks.MASKS if len(v) >= leaks.SHORTEST else ("1" * len(v),)
            best = 0
            for shift in range(-len(v), len(w)):
                same = [0 <= k + shift < len(w) and w[k + shift] == v[k] for k in range(len(v))]
                inside = [0 <= k + shift < len(w) for k in range(len(v))]
                if not any(all(x == "0" or same[k + j] for j, x in enumerate(m)) and all(inside[k : k + len(m)]) for m in masks for k in range(len(v) - len(m) + 1)):
                    continue
                runs = [(sum(1 if s else -2 for s in same[a:b]), -(b - a), sum(same[a:b])) for a in range(len(v)) for b in range(a + 1, len(v) + 1) if all(inside[a:b])]
                top = max(r[0] for r in runs)
                best = max(best, max(r[2] for r in runs if r[0] == top))
            if best >= max(min(words_, math.ceil(share * len(v))), min(len(v), leaks.SHORTEST)):
                out[d, i] = best
    return out


@pytest.mark.parametrize("crowd", [0, 2, 64])
def test_leaks_like_brute_force(spark, crowd):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcd") for _ in range(2)) + rng.choice(["", "É", "9"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 9, 14, 25, 40])]
    docs_ = []
    for d in range(160):
        t = [word() for _ in range(rng.randrange(0, 50))]
        for _ in range(rng.randrange(3)):
            v = rng.choice(items)[1].split()
            a = rng.randrange(len(v))
            v = [word() if rng.random() < 0.12 else x for x in v[a:]]
            at = rng.randrange(len(t) + 1)
            t[at:at] = v
        docs_.append((d, rng.choice([" ", ", ", "\n"]).join(t).upper() if d % 3 else " ".join(t)))
    docs_ += [(100, None), (101, ""), (102, items[9][1] + " " + items[10][1])]
    df = spark.createDataFrame([*docs_, docs_[3], docs_[3]], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in leaks.leaks(df, spark.createDataFrame([*items, (None, "x y"), (50, None), (51, "...")], "item_id long, text string"), crowd=crowd).collect()}
    want = brute_leaks(docs_, items)
    assert got == want and len(want) > 60
    assert {i for _, i in want} >= set(range(11))


def test_leaks_of_a_shared_phrase(spark, monkeypatch):
    """A phrase that all items and many texts hold makes no diagonal for each pair; the texts that hold more are found."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    some = lambda n: " ".join(word() for _ in range(n))
    items = [(k, f"{some(k % 5)} which of the following statements is true {some(20 + k % 7)}".strip()) for k in range(300)]
    texts = [(d, f"{some(40)} Which of the following statements is true? {some(40)}") for d in range(1500)] + [(2000 + k, f"{some(30)} {' '.join(items[k][1].split()[:16])} {some(9)}") for k in range(0, 300, 50)]
    kept, write = {}, leaks.written
    monkeypatch.setattr(leaks, "written", lambda df, tag: kept.setdefault(tag, write(df, tag)))
    got = leaks.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(2000 + k, k) for k in range(0, 300, 50)}
    assert kept["diagonals"].count() < 100


# --- 5


def test_warc_round_trip(spark, tmp_path):
    rows = [(k, f"https://www.Host{k % 3}.example.com/a b/{k}?q=é#x", "<p>é</p>" * (k % 4)) for k in range(40)] + [(50, None, None), (51, "no url", "Content-Length: 5\r\n\r\nWARC/1.1\r\n"), (52, "http://[bad", "x" * 300_000), (53, "http://h/\r\nX: y", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, offset int").repartition(3)
    got = {r.page_id: r for r in warc.round_trip(df, str(tmp_path / "a"), lines=7).collect()}
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    assert len(got) == len(rows)
    for i, _, h in rows:
        data = (h or "").encode()
        to = first[h or ""]
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to == i else "revisit", None if to == i else to)
    assert warc.round_trip(df.limit(0), str(tmp_path / "b")).count() == 0


def test_warc_null_and_repeated_ids(spark, tmp_path):
    """Every row comes back; of equal payloads that with the smallest id is the response, null ids come last."""
    rows = [(4, "http://a/x", "same"), (4, "http://a/x", "same"), (None, "http://a/x", "same"), (2, "http://b/y", "same"), (None, None, None), (None, "http://c/z", "own"), (9, "http://c/z", "other")]
    got = warc.round_trip(spark.createDataFrame([(*r, "s") for r in rows], "page_id long, url string, html string, key string").repartition(2), str(tmp_path / "a")).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes) for r in got) == sorted((i is None, i or 0, len(h or "")) for i, _, h in rows)
    same = [r for r in got if r.payload_bytes == 4]
    assert sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to) for r in same) == [(False, 2, "response", None), (False, 4, "revisit", 2), (False, 4, "revisit", 2), (True, 0, "revisit", 2)]
    assert [r.record_type for r in got if r.payload_bytes != 4] == ["response"] * 3


def test_capture_index_lookups(spark, tmp_path):
    keys = [(f"com,host)/{k // 3:04d} {k % 3}", k, "f", k * 10, 10) for k in range(900)]
    manifest = spark.createDataFrame(keys, warc.MANIFEST).repartition(4)
    blocks, directory = warc.write_index(manifest, 50)
    asked = spark.createDataFrame([(k[0],) for k in keys[::7]] + [("com,host)/none",), ("",), ("zzz",)], "key string")
    for stretches in (1, 6, 200):
        assert sorted(r.offset for r in warc.lookup(asked, blocks, directory, stretches).collect()) == [k[3] for k in keys[::7]]
    assert warc.lookup(asked, blocks.limit(0), directory.limit(0)).count() == 0
    same = spark.createDataFrame([("com,host)/one", k, "f", k * 10, 10) for k in range(40)] + [("com,host)/two", 50, "f", 500, 10)], warc.MANIFEST)
    assert warc.lookup(spark.createDataFrame([("com,host)/one",)], "key string"), *warc.write_index(same, 7), 9).count() == 40  # one key over several blocks


def test_places():
    assert warc._place("file:///a/b")[1] == warc._place("/a/b")[1] == "/a/b" and warc._place("dbfs:/a")[1] == "/dbfs/a"


# --- 6


def test_token_counts_and_cache(spark, docs, nothing, tmp_path):
    rows, df = docs
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    odd = ["a  b\n\nc\td ", "  lead", "▁x ▁▁ y", "<s> </s> <unk>", "ﬁ①ａ 　 é", " ", "\n", "x" * 3000]
    more = df.unionByName(spark.createDataFrame([(1000 + k, t, None, None, None, None, None, None) for k, t in enumerate(odd)], DOCS))
    want = collections.Counter((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 50) for i, t, *_ in [*rows, *((1000 + k, t) for k, t in enumerate(odd))])
    cache = str(tmp_path / "cache")
    for _ in range(2):
        assert collections.Counter(map(tuple, tokens.count_tokens(more, PIECES, cache, limit=50).collect())) == want
    assert spark.read.parquet(cache).count() == len({t or "" for _, t, *_ in rows} | set(odd))  # the second run added none
    assert tokens.count_tokens(nothing, PIECES, str(tmp_path / "none")).count() == 0


# --- 8


def test_mixing(spark, docs, nothing):
    rows, df = docs
    got = mixing.mix(df, keep=("source",)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len(words(t))
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:  # water filling, one source at a time
        level = (sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 3 * sizes[s]]
        target |= {s: 3 * sizes[s] for s in full} if full else {s: weight[s] * level for s in open_}
        open_ = open_ - set(full) if full else set()
    for s in names:
        own = [r for r in got if r.source == s]
        largest = max(r.size for r in own)
        assert abs(own[0].target - target[s]) < 1e-6 and own[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in own) - target[s]) <= largest and all(r.taken <= 3 * r.size for r in own)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7), keep=("source",)).collect()))
    assert mixing.mix(nothing).count() == 0


# --- 9


@pytest.mark.parametrize("block", [2048, 2])
def test_simhash(docs, nothing, block):
    rows, df = docs

    def mark(t):
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if w else 0

    marks = {m for m in (mark(t) for _, t, *_ in rows)}
    group = components(marks, [(a, b) for a in marks for b in marks if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[group[mark(t)]] = min(i, least.get(group[mark(t)], 1 << 62))
    want = collections.Counter((i, f"{mark(t):016x}", least.get(group[mark(t)])) for i, t, *_ in rows)
    assert collections.Counter(map(tuple, simhash.near_duplicates(df, block=block).collect())) == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_links_every_pair_within_three_bits(spark):
    rng = random.Random(9)
    marks = set()
    for _ in range(12):
        m = rng.getrandbits(64)
        for _ in range(25):
            marks.add(m)
            m ^= 1 << rng.randrange(64)
    signed = [(m - (1 << 64) if m >> 63 else m,) for m in marks]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), block=4).collect()
    got = components(marks, [(r.a % (1 << 64), r.b % (1 << 64)) for r in links])
    assert got == components(marks, [(a, b) for a in marks for b in marks if a < b and (a ^ b).bit_count() <= 3])


# --- 10


def test_quality(spark, nothing):
    rng = random.Random(10)
    good = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 90))) + "."
    bad = lambda: rng.choice([" ".join([good().split()[0]] * 50), good().upper().replace(" ", "!! "), good().replace(" ", "### ")])
    rows = [(k, good() if k % 3 else bad(), "x") for k in range(240)] + [(500, None, "x"), (501, "", "x")]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(240)] + [(1, None, 0), (None, 1, 0), (7, 9, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string, score string"), labels).collect()}
    assert len(got) == 242 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [k for k in range(240) if got[k].held_out]
    assert sum(got[k].predicted == int(k % 3 > 0) for k in held) >= 0.95 * len(held)
    assert quality.classify(nothing, labels).count() == 0
    assert {r.score for r in quality.classify(spark.createDataFrame(rows[:3], "doc_id long, text string, score string"), labels.limit(0)).collect()} == {0.5}


def test_quality_like_numpy(spark):
    """The same statistics, class moments and log densities without Spark; with ties, repeated rows and a very long text."""
    rng = random.Random(11)
    good = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."
    rows = [(k, good(rng.randint(5, 60)).upper() if k % 3 == 0 else good(rng.randint(20, 90))) for k in range(150)] + [(500, None), (501, ""), (502, good(30_000))]
    rows += [rows[4], rows[4], (600, rows[5][1]), (None, good(9))]
    labels = [(k, int(k % 3 > 0), 0) for k in range(0, 150, 2)] + [(4, 1, 0), (600, 0, 0)]
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()

    def statistics(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        return quality.features(data, np.array([0, len(data)]))[0]

    x = {}
    for i, t in rows:
        x[i, t] = statistics(t)
    seen = [(x[i, t], y) for i, t in rows for k, y, _ in labels if i == k and not zlib.crc32(str(i).encode()) % 5 == 0]
    side = [np.array([v for v, y in seen if y == c]) for c in (0, 1)]
    means, covs = [s.mean(axis=0) for s in side], [np.cov(s.T, bias=True) for s in side]
    n = [len(s) for s in side]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    d = len(scale)

    def density(v, c):
        cov = (0.9 * covs[c] + 0.1 * pooled) / np.outer(scale, scale) + 1e-3 * np.eye(d)
        z = (v - means[c]) / scale
        return -0.5 * z @ np.linalg.solve(cov, z) - 0.5 * np.linalg.slogdet(cov)[1]

    prior = (n[1] + 0.5) / (sum(n) + 1)
    score = lambda v: 1 / (1 + math.exp(-max(-500, min(500, density(v, 1) - density(v, 0) + math.log(prior / (1 - prior))))))
    want = collections.Counter((i, round(score(x[i, t]), 6)) for i, t in rows)
    assert collections.Counter((r.doc_id, round(r.score, 6)) for r in got) == want
    assert all(r.predicted == int(r.score >= 0.3) for r in got)


def test_components_of_a_long_chain(spark):
    from crucible.llm.common import components as spark_components

    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 101), (102, 101)], "a long, b long"))
    assert {(r.node, r.component) for r in spark_components(links).collect()} == {(k, 0) for k in range(61)} | {(k, 100) for k in (100, 101, 102)}
