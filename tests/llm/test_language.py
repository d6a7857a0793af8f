"""Language identification: code lengths against a dictionary of contexts, predictions, and odd rows."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from crucible.llm import language

STYLE = {"ru": ["ба", "до", "ки", "му"], "xx": ["ba", "do", "ki", "mu"], "yy": ["str", "angl", "ent", "éa"], "zz": ["語", "日", "本", "学"]}


def made(seed=6, n=80):
    rng = random.Random(seed)
    text = lambda name: " ".join("".join(rng.choice(STYLE[name]) for _ in range(3)) for _ in range(30))
    rows = [(k, text(name), name) for k, name in enumerate(sorted(STYLE) * (n // 4))]
    return [*rows, (200, None, "xx"), (201, "12 %% 3", "yy"), (202, "", None), (203, "bado kimu", None), (204, text("ru") * 200, None), (None, text("zz"), "zz"), rows[1], rows[1], (205, "日本", None)]


def contexts(texts):
    """Counts of each byte after each context of up to three."""
    seen = collections.defaultdict(collections.Counter)
    for t in texts:
        b = b"\xff" * 3 + t.encode()
        for i in range(3, len(b)):
            for k in range(4):
                seen[b[i - k : i]][b[i]] += 1
    return seen


def code_length(seen, text):
    b, bits = b"\xff" * 3 + text.encode(), 0.0
    for i in range(3, len(b)):
        out = set()
        for k in (3, 2, 1, 0):
            here = seen.get(b[i - k : i])
            if not here:
                continue
            open_ = {s: c for s, c in here.items() if s not in out}
            n, d = sum(open_.values()), len(open_)
            if b[i] in open_:
                bits += math.log2((n + d) / open_[b[i]])
                break
            if d:
                bits += math.log2((n + d) / d)
            out |= set(here)
        else:
            bits += math.log2(255 - len(out))
    return bits


def lengths(tree, text):
    data = np.frombuffer(text.encode(), np.uint8)
    return float(tree.bits(language.grams(data, np.array([0, len(data)]))).sum())


@pytest.mark.parametrize("name", sorted(STYLE))
def test_code_lengths(name):
    texts = [t for _, t, lang in made() if lang == name and t] + ["", "a", "ab"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    gram, n = np.unique(language.grams(data, np.r_[0, np.cumsum([len(t.encode()) for t in texts])]), return_counts=True)
    tree, seen = language.ContextTree(gram, n), contexts(texts)
    for t in [*texts[:3], "bado", "", "q", "entéa 語", "zzz zzz"]:
        assert lengths(tree, t) == pytest.approx(code_length(seen, t), rel=1e-9, abs=1e-9)
    costs = language.Costs([tree], most_cells=50)
    for t in texts[:5]:
        g = np.unique(language.grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])))
        assert np.allclose(costs.of(g)[0], tree.bits(g), rtol=1e-5)


def test_next_byte_sums_to_one():
    texts = ["abracadabra", "abba"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    gram, n = np.unique(language.grams(data, np.array([0, 11, 15])), return_counts=True)
    tree = language.ContextTree(gram, n)
    for before in (b"abr", b"zzz", b"zab", b"\xff\xffa", b"zza"):
        code = np.array([(before[0] << 24) + (before[1] << 16) + (before[2] << 8) + s for s in range(255)], np.uint32)
        assert np.exp2(-tree.bits(code)).sum() == pytest.approx(1)


def test_no_language_learnt_and_an_empty_tree():
    tree = language.ContextTree(np.zeros(0, np.uint32), np.zeros(0, np.int64))
    assert lengths(tree, "ab") == pytest.approx(2 * math.log2(255))


@pytest.mark.parametrize("most", [20_000_000, 100])
def test_predictions(spark, most):
    """Against the dictionary version, with all languages in one group and in several."""
    rows = made()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    seen = {name: contexts([t for i, t, lang in rows if lang == name and t is not None and not held(i)]) for name in STYLE}
    docs = spark.createDataFrame([(*r, 0, "x", 0.1) for r in rows], "doc_id long, text string, lang string, _lang int, _letter string, share double")
    got = language.classify(docs, most_grams=most).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, t, _ in rows:
        bits = {name: code_length(seen[name], t) for name in seen} if t and any(c.isalpha() for c in t) else {}
        best = min(bits, key=lambda k: (bits[k], k)) if bits else "und"
        want[i, held(i), best, round(1 / sum(2 ** max(bits[best] - b, -1000) for b in bits.values()), 3) if bits else 0.0] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 3)) for r in got) == want
    assert all(r.lang_pred == name for r in got for i, _, name in rows[:80] if r.doc_id == i)
    assert language.classify(docs.limit(0)).count() == 0
    nothing = language.classify(spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]
