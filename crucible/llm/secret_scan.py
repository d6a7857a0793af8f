"""Secret scans: fixed patterns, and strings on which a tokenizer is inefficient, since random characters have no long pieces."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: (kind, pattern, least characters, group that must have them, the same as a cheap test of whole columns)
BASE = (
    ("assign", _ASSIGN, 6, 2, r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    ("access", _ACCESS, 20, 0, "AKIA[A-Z0-9]{16}"),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 24, 0, "[0-9a-f]{24}"),  # runs are maximal, so shorter ones can be left out at once
)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_INNER_DIGITS = re.compile(r"(?<=[A-Za-z])[0-9]+(?=[A-Za-z])")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_NUMBER = re.compile(r"[0-9+/_=-]+")
#: What stands before a digest that is given in base 64.
_NAMED_DIGEST = re.compile(r"(sha(1|224|256|384|512)|md5)[-:=]$", re.IGNORECASE)
#: Lengths of hexadecimal MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))


def is_known(run: str, before: str = "") -> bool:
    """Whether a run of characters is a digest or an identifier: a hash of a usual length, a UUID, a number, or words in any case style."""
    bare = run.rstrip("=")
    if (len(bare) in DIGEST_LENGTHS and _DIGEST.fullmatch(bare)) or _UUID.fullmatch(bare) or _NUMBER.fullmatch(run):
        return True
    if _NAMED_DIGEST.search(before):
        return True
    parts = _PART.findall(bare)
    return not parts or (sum(map(len, parts)) >= 4 * len(parts) and len(_INNER_DIGITS.findall(bare)) < 2)


class Scanner:
    """Spans of one text after the other. ``ratio``: a run with fewer characters a token is random; ``least``: characters of a run."""

    def __init__(self, ranks_file: str, pattern: str, ratio: float = 2.2, least: int = 16):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.ratio, self.least = ratio, least
        self.run = re.compile(rf"[A-Za-z0-9+/_-]{{{least},}}={{0,2}}")

    def is_random(self, run: str, before: str = "") -> bool:
        return len(run) >= self.least and not is_known(run, before) and len(run) < self.ratio * len(self.encode(run))

    def base(self, text: str, asked: tuple[bool, ...] = (True, True, True)) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the fixed patterns' spans; ``asked``: which of them may occur."""
        found = [
            (m.start(), k, m.end())
            for k, (_, pattern, least, group, _) in enumerate(BASE) if asked[k]
            for m in pattern.finditer(text) if len(m.group(group)) >= least
        ]
        return sorted(found)

    def random(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(start, kind, end) of inefficient runs that touch no span of ``base``, and else of such pieces between separators."""
        taken = sorted((a, b) for a, _, b in base)
        found, k, reach = [], 0, 0
        for m in self.run.finditer(text):
            a, b = m.span()
            while k < len(taken) and taken[k][0] < b:
                reach = max(reach, taken[k][1])
                k += 1
            if reach > a:
                continue
            if self.is_random(m.group(), text[max(0, a - 8) : a]):
                found.append((a, 3, b))
            elif not is_known(m.group(), text[max(0, a - 8) : a]):
                found += [(a + p.start(), 3, a + p.end()) for p in re.finditer(r"[^/_-]+", m.group()) if self.is_random(p.group())]
        return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, ranks_file: str, pattern: str, ratio: float = 2.2, least: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_assign, n_access, n_hex, base_sha256, spans, n_random), one for each row of ``docs``, whole texts.

    ``spans``: ``kind:start:end`` in code points, end exclusive, by start, then kind, joined by commas. Kinds assign, access and hex are fixed
    patterns. Kind random: runs of at least ``least`` letters, digits and ``+/_-`` with fewer than ``ratio`` characters for each token of
    the vocabulary in ``ranks_file`` (tiktoken ranks, split by ``pattern``), neither digests nor identifiers (``is_known``), outside all fixed spans.
    ``base_sha256`` is the digest of the fixed spans alone.

    A null text counts as empty; no span gives an empty string. Repeated rows and null ids keep a row each; an empty table gives none; other
    columns are dropped, whatever their names. A text of any length is held by one task, as Spark holds the row.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(ranks_file)
    name = ranks_file.rsplit("/", 1)[-1]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    no_span = hashlib.sha256(b"").hexdigest()

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = None
        for batch in batches:
            texts = batch.column("_text")
            asked = [pc.match_substring_regex(texts, sieve, ignore_case=kind == "assign").to_pylist() for kind, _, _, _, sieve in BASE]
            runs = pc.match_substring_regex(texts, f"[A-Za-z0-9+/_-]{{{least}}}").to_pylist()
            counts = [[0] * batch.num_rows for _ in KINDS]
            spans, digests = [""] * batch.num_rows, [no_span] * batch.num_rows
            for i, (*some, run) in enumerate(zip(*asked, runs, strict=True)):
                if not (run or any(some)):
                    continue
                scanner = scanner or Scanner(SparkFiles.get(name), pattern, ratio, least)
                text = texts[i].as_py()
                base = scanner.base(text, tuple(some)) if any(some) else []
                more = scanner.random(text, base) if run else []
                for _, k, _ in base + more:
                    counts[k][i] += 1
                spans[i], digests[i] = joined(sorted(base + more)), hashlib.sha256(joined(base).encode()).hexdigest()
            numbers = [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *numbers[:3], pa.array(digests, pa.string()), pa.array(spans, pa.string()), numbers[3]], names=["_id", *(c.split()[0] for c in SCHEMA.split(", "))])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(find, f"_id {kind}, {SCHEMA}").withColumnRenamed("_id", id_col)
