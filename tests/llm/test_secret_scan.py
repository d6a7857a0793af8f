"""The secret scan against plain patterns over whole texts, and its random runs against a rule written out by hand."""

import base64
import hashlib
import random
import re
import string

import public_tokenizers
import pytest
import tiktoken

from crucible.llm import secret_scan

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, _id string, spans long, n_hex string"


@pytest.fixture(scope="module")
def scanner():
    return secret_scan.Scanner(RANKS, public_tokenizers.PATTERN)


def made(seed=3, n=300):
    rng = random.Random(seed)
    pick = lambda a, k: "".join(rng.choice(a) for _ in range(k))
    word = lambda: pick("etaoinshr", rng.randint(1, 12))
    kinds = (
        lambda: pick(string.ascii_letters + string.digits, rng.randint(10, 60)),
        lambda: f"{rng.choice(['Password', 'passwd', 'SECRET', 'Token', 'api_key', 'apiKey', 'toKen', 'ſecret'])}{rng.choice(['', chr(34), chr(39)])}{' ' * rng.randint(0, 2)}{rng.choice(':=')}{' ' * rng.randint(0, 2)}{rng.choice(['', chr(34)])}{pick('abcXYZ019=.-_', rng.randint(0, 12))}",
        lambda: f"AKIA{pick(string.ascii_uppercase + string.digits, rng.randint(10, 20))}",
        lambda: pick("0123456789abcdef", rng.choice([20, 23, 24, 31, 32, 33, 40, 64])),
        lambda: "token=token: abcdefgh token:token : abcdefgh",
        lambda: pick(string.digits, 16), lambda: "some_long_identifier_name", lambda: "VeryLongCamelCaseName", lambda: "é\U0001f600ß",
        lambda: "/home/user/" + pick(string.ascii_letters + string.digits, 30), lambda: "pwd=" + pick(string.ascii_letters + string.digits, 22) + "==",
        lambda: "6f1ed002-ab55-4a4e-9e0b-0f2b6d2f8a11",
    )
    rows = [(i, " ".join(rng.choice(kinds)() if rng.random() < 0.2 else word() for _ in range(rng.choice([0, 1, 4, 60])))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (None, f"AKIA{pick('ABC123', 16)}"), (None, None), (n + 2, "x " * 200_000 + f"token: {pick('abc0123', 9)}"), rows[7], rows[7]]
    return [(*r, "en", "x", 1, "y") for r in rows]


def base(text):
    found = []
    for m in re.finditer(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    for k, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(found)


def test_fixed_spans_are_those_of_plain_patterns(spark):
    rows = made()
    got = secret_scan.scan(spark.createDataFrame(rows, DOCS).repartition(3), RANKS, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]
    want = []
    for i, text, *_ in rows:
        b = base(text or "")
        line = ",".join(f"{secret_scan.KINDS[k]}:{x}:{y}" for x, k, y in b)
        want.append((i, *(sum(k == j for _, k, _ in b) for j in range(3)), hashlib.sha256(line.encode()).hexdigest(), line))
    given = []
    for r in got.collect():
        spans = [s for s in r.spans.split(",") if s]
        assert sum(s.startswith("random:") for s in spans) == r.n_random
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
        given.append((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, ",".join(s for s in spans if not s.startswith("random:"))))
    assert sorted(given, key=repr) == sorted(want, key=repr)
    assert sum(w[1] for w in want) > 20 and sum(w[2] for w in want) > 5 and sum(w[3] for w in want) > 10


def test_random_runs_are_those_of_low_ratio(spark):
    """The rule of runs again, by a scan over characters and the library's own count of tokens."""
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    count = lambda s: len(tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(s))
    letters = set(string.ascii_letters + string.digits + "+/_-")
    rows = [r for r in made(n=60) if r[1] is not None and len(r[1]) < 5000]
    got = {(r.doc_id, r.spans) for r in secret_scan.scan(spark.createDataFrame(rows, DOCS), RANKS, public_tokenizers.PATTERN).collect()}
    found = 0
    for i, text, *_ in rows:
        fixed, k = base(text), 0
        spans = list(fixed)
        while k < len(text):
            j = k
            while j < len(text) and text[j] in letters:
                j += 1
            if j - k >= 16:
                end = j + next(n for n in (2, 1, 0) if text[j : j + n] == "=" * n)
                if not any(a < end and k < b for a, _, b in fixed) and not secret_scan.is_known(text[k:end], text[max(0, k - 8) : k]):
                    if end - k < 2.2 * count(text[k:end]):
                        spans.append((k, 3, end))
                    else:
                        spans += [(k + m.start(), 3, k + m.end()) for m in re.finditer("[^/_-]{16,}", text[k:end]) if not secret_scan.is_known(m[0]) and len(m[0]) < 2.2 * count(m[0])]
                j = end
            k = j + 1
        found += sum(s[1] == 3 for s in spans)
        assert (i, secret_scan.joined(sorted(spans))) in got
    assert found > 10


def test_random_strings_are_found_and_words_are_not(scanner):
    rng = random.Random(5)
    for alphabet in (string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits):
        strings = ["".join(rng.choice(alphabet) for _ in range(26)) for _ in range(300)]
        assert sum(map(scanner.is_random, strings)) >= 290
    digests = [hashlib.new(h, b"x").hexdigest() for h in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")]
    names = ["internationalization", "getElementsByClassName", "MAX_CONNECTION_POOL_SIZE", "4111111111111111", "2024-01-31_12-30-00", "thedretionthble", "/usr/local/share/doc/package"]
    for s in [*digests, *(d.upper() for d in digests), *names, "123e4567-e89b-12d3-a456-426614174000"]:
        assert not scanner.is_random(s), s
    integrity = base64.b64encode(hashlib.sha384(b"x").digest()).decode()
    assert scanner.is_random(integrity) and not scanner.is_random(integrity, "sha384-")


def test_empty_table(spark):
    got = secret_scan.scan(spark.createDataFrame([], DOCS), RANKS, public_tokenizers.PATTERN)
    assert got.count() == 0 and got.columns[0] == "doc_id"
