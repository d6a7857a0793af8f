"""Shared pieces: scratch tables, word spans and hashes over Arrow buffers, blocked pair search, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crucible.operators.graph import components  # noqa: F401
from crucible.scratch import scratch_path, written  # noqa: F401  the operators take them from here

#: A word is a maximal run of bytes other than these six; the same pattern as a regular expression for SQL.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- words -------------------------------------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column without copying each value; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the number of words) of all words in ``data``."""
    solid = ~space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    after = np.empty(len(data), dtype=bool)
    if len(data):
        before[0], after[-1] = True, True
        before[1:] = ~solid[:-1] | edge[1:-1]
        after[:-1] = ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20_240_229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_power: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power[0]) < n:
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _power[k] = np.cumprod(steps)
    return _power[0], _power[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over keyed bytes by prefix sums, then mixed. Works in slices of ``step`` bytes."""
    out = np.empty(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + step, "right")))
        s, e = int(starts[a]), int(ends[b - 1])
        up, down = _powers(e - s + 1)
        sums = np.zeros(e - s + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[s:e]] * up[: e - s], out=sums[1:])
        at = starts[a:b] - s
        out[a:b] = (sums[ends[a:b] - s] - sums[at]) * down[at]
        a = b
    return mix(out)


# --- bit maps ------------------------------------------------------------------------------------------------------


def bit_map(slots: DataFrame, bits: int) -> np.ndarray:
    """The slots (a column of numbers below 2**bits) as a bit map; at most 2**(bits - 6) rows come to the driver, whatever the input."""
    words = slots.select(F.shiftright("slot", 6).cast("int").alias("word"), F.pmod("slot", F.lit(64)).cast("int").alias("bit"))
    rows = words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def on_map(seen: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return np.flatnonzero((seen[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))


# --- pairs within keys, in bounded blocks ------------------------------------------------------------------------


def in_blocks(rows: DataFrame, keys: list[str], item: str, probe: str | None = None, block: int = 2048, payload: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Deal rows so that each two rows of a key meet in a block of bounded size.

    A key with at most ``block`` rows is one block. A larger one is cut into sub-blocks by a hash of ``item`` and each two of them
    meet in a block of their own, so no task holds a whole hot key. Rows marked by ``probe`` meet unmarked rows only.
    ``payload`` (a table, its key) is joined after the rows are dealt out, just before they move.
    Adds ``_block`` (a hash of key and block), ``_role`` (0 compares with all after it, 1 and 2 with role 0 only), ``_self``.
    """
    asked = F.col(probe) if probe else F.lit(False)
    sizes = rows.groupBy(*keys).agg(F.count_if(~asked).alias("_t"), F.count_if(asked).alias("_p"))
    big = written(sizes.where((F.col("_t") > 0) & (F.col("_t") + F.col("_p") > block)).select(*keys, F.ceil(F.col("_t") / block).cast("int").alias("_nt"), F.ceil(F.col("_p") / block).cast("int").alias("_np")), "hot-keys")
    one = F.array(F.struct(F.lit(2).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("j")))
    if big.isEmpty():
        dealt = rows.select("*", F.explode(one).alias("_b"), F.lit(0).alias("_own"))
    else:
        dealt = rows.join(big, keys, "left")
        own = F.pmod(F.xxhash64(item), F.when(asked, F.col("_np")).otherwise(F.col("_nt"))).cast("int")
        pair = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
        upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        tables = F.concat(
            F.transform(upto(F.col("_nt")), lambda x: pair(0, F.least(F.col("_own"), x), F.greatest(F.col("_own"), x))),
            F.transform(upto(F.col("_np")), lambda x: pair(1, F.col("_own"), x)),
        )
        probes = F.transform(upto(F.col("_nt")), lambda x: pair(1, x, F.col("_own")))
        dealt = dealt.withColumn("_own", F.coalesce(own, F.lit(0))).withColumn("_b", F.explode(F.when(F.col("_nt").isNull(), one).when(asked, probes).otherwise(tables))).drop("_nt", "_np")
    role = F.when(asked, 2).when((F.col("_b.kind") == 0) & (F.col("_own") != F.col("_b.i")), 1).otherwise(0)
    alone = (F.col("_b.kind") == 2) | ((F.col("_b.kind") == 0) & (F.col("_b.i") == F.col("_b.j")))
    dealt = dealt.select("*", F.xxhash64(*keys, "_b.kind", "_b.i", "_b.j").alias("_block"), role.cast("int").alias("_role"), alone.alias("_self")).drop("_b", "_own")
    if payload:
        dealt = dealt.join(payload[0], payload[1])
    return dealt.repartition("_block").sortWithinPartitions("_block", "_role")


def runs(batches: Iterable[pa.RecordBatch], key: str = "_block", rows: int = 60_000) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no key is cut in two; holds about ``rows`` rows and one key."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        whole = pa.Table.from_batches(held)
        k = whole.column(key).combine_chunks().to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut:
            yield whole.slice(0, cut)
            held = whole.slice(cut).combine_chunks().to_batches()
            n -= cut
        rows = max(rows, n + 1) if not cut else rows
    if held:
        yield pa.Table.from_batches(held)


def pairs(block: np.ndarray, role: np.ndarray, alone: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) to compare within runs of ``block``, at most about ``most`` at a time."""
    n = len(block)
    if not n:
        return
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    end = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n]))
    index = np.arange(n)
    count = np.where(role == 0, end - index - 1, 0)
    total = np.cumsum(count)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        c = count[a:b]
        if c.sum():
            i = np.repeat(index[a:b], c)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            good = alone[i] | (role[j] > 0)
            yield i[good], j[good]
        a = b


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes by the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def byte_slices(batch: pa.RecordBatch, text: str = "_text", most: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) in pieces of about ``most`` bytes; a longer text is a piece of its own, whole."""
    data, offsets = text_bytes(batch.column(text))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def held_out(doc_id: str = "doc_id", remainder: int = 0):
    """True where crc32 of the id as text leaves this remainder mod 5; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == remainder, F.lit(False))
