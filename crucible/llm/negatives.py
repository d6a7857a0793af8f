"""Hard-negative mining: pair scores in packed keys, sorted by the shuffle, read once by an iterator that opens a window for each positive."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crucible.llm.common import runs, written

_KEY = ">QQBQ"
_SIGN = 1 << 63
_MOST = (1 << 63) - 1
_NEVER = np.iinfo(np.int64).min
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


# --- keys ------------------------------------------------------------------------------------------------------------


def packed(anchor: np.ndarray, score: np.ndarray, negative: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Keys of 25 bytes whose byte order is: anchor, score from high to low, positives before negatives, id."""
    key = np.empty(len(anchor), dtype=[("a", ">u8"), ("s", ">u8"), ("n", "u1"), ("o", ">u8")])
    key["a"] = anchor.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)
    key["s"] = ~(score.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN))
    key["n"] = negative
    key["o"] = other.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)
    return key


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    a, s, n, o = struct.unpack(_KEY, key)
    return a - _SIGN, (s ^ ((1 << 64) - 1)) - _SIGN, n, o - _SIGN


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The scores between ``low`` and ``high`` per cent of a positive's, both included, in whole numbers."""
    return -(-low * score // 100), high * score // 100


def mined(keys: Iterable[bytes], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple]:
    """Rows from sorted keys. Only the open windows of one anchor are held, ``positives`` at most."""
    anchor, seen, open_ = None, 0, []
    for key in keys:
        a, score, negative, other = unpacked(key)
        if a != anchor:
            anchor, seen, open_ = a, 0, []
        if not negative:
            if seen < positives:
                seen += 1
                open_.append([other, score, *window(score, low, high), 0])
            continue
        for w in open_:
            if w[2] <= score <= w[3]:
                w[4] += 1
                yield a, w[0], w[4], other, w[1], score
        open_ = [w for w in open_ if w[4] < negatives and w[2] <= score]


# --- scores of a block -----------------------------------------------------------------------------------------------


def quantised(column: pa.Array, width: int, scale: float = 256.0) -> np.ndarray:
    """floor(scale * x) of a list column as a matrix of whole doubles; shorter vectors are filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), width))
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() :][: lengths.sum()].astype(np.float64)
    with np.errstate(over="ignore"):
        out[np.arange(width) < lengths[:, None]] = np.clip(np.floor(scale * flat), -(2.0**62), 2.0**62)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit numbers; those beyond 63 bits become the largest or smallest."""
    top = lambda x: np.abs(x).max(initial=0.0)
    if top(a) * top(b) * max(a.shape[1], 1) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T
    return np.clip(whole, -_MOST, _MOST).astype(np.int64)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row, of equal ones those of the first columns; ``_NEVER`` is no score."""
    k = min(k, scores.shape[1])
    if not k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    i, j = np.nonzero((scores >= least[:, None]) & (scores != _NEVER))
    order = np.lexsort((j, -scores[i, j], i))
    i, j = i[order], j[order]
    at = np.arange(len(i)) - np.searchsorted(i, i, "left")
    return i[at < k], j[at < k]


def block_pairs(block: pa.Table, wanted, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, ...]]:
    """For slices of a block's anchors: (anchor ids, row ids, score, row, column) of what ``wanted(anchors, scores, same label)`` picks."""
    asked = block.column("_anchor").combine_chunks().to_numpy(zero_copy_only=False)
    rows, anchors = block.filter(pa.array(~asked)), block.filter(pa.array(asked))
    if not rows.num_rows or not anchors.num_rows:
        return
    rows = rows.sort_by("_id")
    vectors = [t.column("_vec").combine_chunks() for t in (rows, anchors)]
    width = max(int(np.diff(v.offsets.to_numpy()).max(initial=0)) for v in vectors)
    b, a = (quantised(v, width) for v in vectors)
    ids, own = (t.column("_id").combine_chunks().to_numpy() for t in (rows, anchors))
    labels, codes = np.unique(np.concatenate([np.asarray(t.column("_label").to_pylist(), dtype=object) for t in (rows, anchors)]).astype(str), return_inverse=True)
    step = max(1, most // len(b))
    for s in range(0, len(a), step):
        part = slice(s, s + step)
        scores = products(a[part], b)
        same = codes[len(b) :][part][:, None] == codes[: len(b)]
        scores[own[part][:, None] == ids] = _NEVER
        i, j = wanted(anchors.slice(s, step), scores, same)
        yield own[part][i], ids[j], scores[i, j]


# --- the jobs --------------------------------------------------------------------------------------------------------


def dealt(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, row_block: int, anchor_block: int) -> DataFrame:
    """Each anchor meets each row in one block, of about ``row_block`` rows and ``anchor_block`` anchors."""
    down, across = max(1, -(-n_rows // row_block)), max(1, -(-n_anchors // anchor_block))
    own = lambda n: F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = rows.select("*", F.lit(False).alias("_anchor"), own(down).alias("_r")).withColumn("_a", each(across))
    b = anchors.select("*", F.lit(True).alias("_anchor"), own(across).alias("_a")).withColumn("_r", each(down))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_block", F.col("_r").cast("long") * across + F.col("_a")).drop("_r", "_a")
    return both.repartition("_block").sortWithinPartitions("_block")


def mine(
    vectors: DataFrame, anchor: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", row_block: int = 2048, anchor_block: int = 1024,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of vectors of floor(256 x); higher ones come first, of equal ones smaller ids. An anchor's positives are its
    first ``positives`` other rows of its label. For each, the first ``negatives`` rows of other labels whose score is from ``low`` to
    ``high`` per cent of the positive's. ``anchor``: which rows ask (None: all).

    Two passes over blocks of anchors and rows: the first finds the positives, the second scores again and packs, for each window, the
    block's first negatives into (anchor, score from high to low, id) keys; others can't be among the first of all. The shuffle sorts the
    keys (``repartitionAndSortWithinPartitions``), and an iterator emits the rows with no more than an anchor's open windows in memory.

    Rows with a null id or label, a null vector or a null or non-finite component take no part. Of rows with one id that with the least
    (label, vector) counts. Missing components of shorter vectors are zero; an empty vector scores 0 with all. Scores that 64 bits can't
    hold become the largest or smallest. Anchors without positives or negatives give no rows, nor does an empty table. Other columns are
    dropped, whatever their names.
    """
    session = vectors.sparkSession
    c = F.col(vector_col)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    fit = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & c.isNotNull() & finite)
    kind = "array<float>" if fit.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    asks = F.lit(True) if anchor is None else F.coalesce(anchor, F.lit(False))
    fit = fit.select(F.col(id_col).cast("long").alias("_id"), F.struct(F.col(label_col).cast("string").alias("_label"), c.cast(kind).alias("_vec"), asks.alias("_asks")).alias("_row"))
    rows = written(fit.groupBy("_id").agg(F.min("_row").alias("_row")).select("_id", "_row.*"), "vectors")
    anchors = rows.where("_asks").drop("_asks")
    rows = rows.drop("_asks")
    n_rows, n_anchors = rows.count(), anchors.count()

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = lambda _, scores, same: best(np.where(same, scores, _NEVER), positives)
        for block in blocks(batches):
            for a, o, s in block_pairs(block, pick):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(o), pa.array(s)], ["_id", "other", "score"])

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pick(part, scores, same):
            asked = part.column("_scores").to_pylist()
            others = np.where(same, _NEVER, scores)
            found = []
            for k in range(max(map(len, asked))):
                bounds = [window(x[k], low, high) if k < len(x) else (1, 0) for x in asked]
                lo, hi = (np.array([max(-_MOST, min(_MOST, b[e])) for b in bounds])[:, None] for e in (0, 1))
                i, j = best(np.where((others >= lo) & (others <= hi), others, _NEVER), negatives)
                found.append(i * scores.shape[1] + j)
            return np.divmod(np.unique(np.concatenate(found)), scores.shape[1])

        for block in blocks(batches):
            for a, o, s in block_pairs(block, pick):
                keys = packed(a, s, np.ones(len(a), np.uint8), o).tobytes()
                yield pa.RecordBatch.from_arrays([pa.FixedSizeBinaryArray.from_buffers(pa.binary(struct.calcsize(_KEY)), len(a), [None, pa.py_buffer(keys)]).cast(pa.binary())], ["key"])

    first = dealt(rows, anchors, n_rows, n_anchors, row_block, anchor_block).mapInArrow(nearest, "_id long, other long, score long")
    order = Window.partitionBy("_id").orderBy(F.desc("score"), "other")
    chosen = written(first.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= positives).drop("_k"), "positives")
    asking = anchors.join(chosen.groupBy("_id").agg(F.collect_list("score").alias("_scores")), "_id")
    again = dealt(rows, asking, n_rows, n_anchors, row_block, anchor_block).mapInArrow(windows, "key binary")
    of_positives = chosen.mapInArrow(as_keys, "key binary")
    pairs = again.unionByName(of_positives).rdd.map(lambda r: (bytes(r[0]), None))
    n = int(session.conf.get("spark.sql.shuffle.partitions"))
    ordered = pairs.repartitionAndSortWithinPartitions(n, lambda key: zlib.crc32(key[:8]))
    found = ordered.mapPartitions(lambda it: mined((key for key, _ in it), positives, negatives, low, high))
    return session.createDataFrame(found, OUT)


def as_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, o, s = (b.column(x).to_numpy(zero_copy_only=False) for x in ("_id", "other", "score"))
        keys = packed(a, s, np.zeros(len(a), np.uint8), o)
        yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary())], ["key"])


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One block after the other from batches sorted by block."""
    for table in runs(batches, rows=1):
        key = table.column("_block").combine_chunks().to_numpy()
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield table.slice(int(a), int(b - a))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""
