"""Ranked lexical search: each document's impacts fold into a hashed sketch of maxima, whose bounds decide what is scored exactly."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crucible.llm.common import LOWER, byte_slices, scratch_path, word_hashes, word_spans, written

#: A term is a maximal run of ASCII digits and letters and of all code points beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BREAK = np.ones(256, dtype=bool)
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Sketch cells hold impacts in steps of this size, rounded up: impacts are below a million, cells have 16 bits.
STEP = 16


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hashes, counts, first of each document, terms of each document): the distinct terms of each text, by hash."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets, _BREAK)
    h, n = word_hashes(low, starts, ends), np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[new], np.diff(np.r_[new, len(h)]), np.searchsorted(doc[new], np.arange(len(n) + 1)), n


def impacts(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * count // (1000 * count + 12 * m)


def width_of(distinct: np.ndarray) -> np.ndarray:
    """Cells of a document's sketch: a power of two, four for each distinct term at least."""
    return 1 << np.ceil(np.log2(np.maximum(4 * distinct, 64))).astype(np.int64)


def folded(h: np.ndarray, impact: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells, first cell of each document): the largest impact of the terms that share a cell, in steps rounded up."""
    distinct = np.diff(first)
    width = width_of(distinct)
    at = np.r_[0, np.cumsum(width)]
    doc = np.repeat(np.arange(len(distinct)), distinct)
    cells = np.zeros(at[-1], dtype=np.uint16)
    np.maximum.at(cells, at[doc] + (h & (width[doc] - 1).astype(np.uint64)).astype(np.int64), (-(-impact // STEP)).astype(np.uint16))
    return cells, at


def binaries(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """One binary for each run of ``values``."""
    bounds = pa.py_buffer((first * values.itemsize).astype(np.int64))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, bounds, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def values_of(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The reverse of ``binaries``."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(flat.tobytes(), dtype=dtype), (off - off[0]) // size


# --- index -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """``rows``: (_id, terms, counts, impacts, sketch) for each document with terms; ``n_docs`` of them with ``n_terms`` in all."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The corpus counts, then one pass that writes each document's terms, impacts and sketch to the shared folder."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.concatenate([np.diff(word_spans(data, offsets, _BREAK)[2]) for _, data, offsets in byte_slices(batch)] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["docs", "terms"])

    counted = docs.select(text.alias("_text")).mapInArrow(count, "docs long, terms long")
    n_docs, n_terms = (int(x or 0) for x in counted.agg(F.sum("docs"), F.sum("terms")).first())

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in byte_slices(batch):
                h, count, first, n = terms_of(data, offsets)
                m = np.array([75 + 25 * int(k) * n_docs // max(n_terms, 1) for k in n], dtype=np.int64)
                impact = impacts(count, np.repeat(m, np.diff(first)))
                cells, at = folded(h, impact, first)
                out = [rows.column("_id"), binaries(h, first), binaries(impact.astype(np.uint32), first), binaries(cells, at)]
                yield pa.RecordBatch.from_arrays(out, ["_id", "terms", "impacts", "sketch"]).filter(pa.array(n > 0))

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"))
    return Index(written(rows.mapInArrow(fold, "_id long, terms binary, impacts binary, sketch binary"), "max-sketches"), n_docs, n_terms)


# --- a block of queries ----------------------------------------------------------------------------------------------


class Queries:
    """Items of one block: ``slot`` and ``weight`` of their terms, one item after the other; ``known``: the block's distinct terms."""

    def __init__(self, item: np.ndarray, h: np.ndarray, times: np.ndarray):
        order = np.argsort(item, kind="stable")
        item, h, self.times = item[order], h[order], times[order]
        self.start = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        self.length = np.diff(np.r_[self.start, len(item)])
        self.item = item[self.start]
        self.known, self.slot = np.unique(h, return_inverse=True)
        self.hash = h

    def weigh(self, found: np.ndarray, n_docs: int) -> None:
        """``found``: documents that hold each known term."""
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in found], dtype=np.int64)
        self.weight = self.times * w[self.slot]
        self._cells: dict[int, np.ndarray] = {}

    def cells(self, width: int) -> np.ndarray:
        if width not in self._cells:
            self._cells[width] = (self.hash & np.uint64(width - 1)).astype(np.int64)
        return self._cells[width]

    def slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, slots) of the hashes that the block asks for."""
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hit = np.flatnonzero(self.known[at] == h)
        return hit, at[hit]

    def bounds(self, sketch: np.ndarray, at: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """What each document (row) can score at most for each item (column)."""
        width = np.diff(at)
        out = np.empty((len(width), len(self.item)), dtype=np.int64)
        step = max(1, most // len(self.slot))
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                met = sketch[at[part][:, None] + self.cells(int(w))] * self.weight
                out[part] = np.add.reduceat(met, self.start, axis=1)
        return out * STEP

    def exact(self, doc: np.ndarray, item: np.ndarray, keys: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """Scores of pairs; ``keys``: document * known terms + slot, in order, each with its impact."""
        n = self.length[item]
        ends = np.cumsum(n)
        entry = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(self.start[item], n)
        asked = np.repeat(doc, n) * len(self.known) + self.slot[entry]
        where = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
        part = np.where(keys[where] == asked, impact[where], 0) * self.weight[entry] if len(keys) else np.zeros(len(asked), np.int64)
        return np.add.reduceat(part, ends - n)


class Best:
    """The k best (score, id) of each item so far; ``least[item]``: what another document must reach."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.ones(n, dtype=np.int64)
        self.item, self.score, self.doc, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        some = score >= self.least[item]
        item, score, doc, null = (np.r_[a, b[some]] for a, b in ((self.item, item), (self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item, "left")
        kept = order[rank < self.k]
        full = rank == self.k - 1
        self.least[item[full]] = score[order][full]
        self.item, self.score, self.doc, self.null = item[rank < self.k], score[kept], doc[kept], null[kept]


def search_batch(q: Queries, best: Best, batch: pa.RecordBatch, chunk: int) -> None:
    """Bounds of all pairs of a batch; those that reach an item's threshold are scored from the highest bound on, until no bound reaches it."""
    h, first = values_of(batch.column("terms"), np.uint64)
    impact, _ = values_of(batch.column("impacts"), np.uint32)
    sketch, at = values_of(batch.column("sketch"), np.uint16)
    ids = batch.column("_id")
    doc_id, null = pc.fill_null(ids, 0).to_numpy(), np.asarray(ids.is_null())
    for a in range(0, batch.num_rows, chunk):
        b = min(a + chunk, batch.num_rows)
        bound = q.bounds(sketch[at[a] : at[b]], at[a : b + 1] - at[a])
        doc, item = np.nonzero(bound >= best.least)
        if not len(doc):
            continue
        value = bound[doc, item]
        order = np.lexsort((-value, item))
        doc, item, value = doc[order], item[order], value[order]
        wave = (np.arange(len(item)) - np.searchsorted(item, item, "left")) // best.k
        hit, slot = q.slots(h[first[a] : first[b]])
        keys = np.repeat(np.arange(b - a), np.diff(first[a : b + 1]))[hit] * len(q.known) + slot
        at_hit = impact[first[a] : first[b]][hit].astype(np.int64)
        for k in range(int(wave.max()) + 1):
            now = np.flatnonzero((wave == k) & (value >= best.least[item]))
            if not len(now):
                continue
            best.add(item[now], q.exact(doc[now], item[now], keys, at_hit), doc_id[a + doc[now]], null[a + doc[now]])


# --- search ----------------------------------------------------------------------------------------------------------


def item_terms(items: DataFrame) -> DataFrame:
    """Rows (_item, terms, times) of (_item, _text): an item's distinct terms and how often it has them."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in byte_slices(batch):
                h, count, first, n = terms_of(data, offsets)
                out = [rows.column("_item"), binaries(h, first), binaries(count.astype(np.int64), first), pa.array(np.diff(first))]
                yield pa.RecordBatch.from_arrays(out, ["_item", "terms", "times", "n"]).filter(pa.array(n > 0))

    return items.mapInArrow(split, "_item long, terms binary, times binary, n long")


def search(index: Index, items: DataFrame, k: int = 20, item_id: str = "item_id", text_col: str = "text", most_terms: int = 1 << 15) -> DataFrame:
    """Rows (item, rank, doc_id, score): the ``k`` documents of each item with the highest scores above 0, equal ones by ascending id.

    Items come in blocks of about ``most_terms`` distinct terms (one item's terms more at most), by hash; a block is what a task holds and is
    all that passes the driver. For each block one pass over the index counts the documents of its terms, and another bounds all pairs by the
    sketches; within a task pairs are scored exactly from the highest bound on, until none reaches the item's threshold, so each task leaves
    ``k`` rows an item, of which the best are ranked in two steps. Terms are compared by 64-bit hashes.

    Each row of ``items`` and each document is ranked by itself, also where ids repeat or are null; null document ids come last. Null texts
    and texts without terms have no rows; so have empty tables. Other columns are dropped, whatever their names.
    """
    spark = items.sparkSession
    asked = written(items.select(F.monotonically_increasing_id().alias("_item"), F.col(item_id).alias("_name"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")), "ranked-items")
    terms = written(item_terms(asked.select("_item", "_text")), "ranked-item-terms")
    n = terms.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_blocks = max(1, -(-n // most_terms))
    path = scratch_path(spark, "ranked-lists")
    found = "_item long, _doc long, score long"
    spark.createDataFrame([], found).write.parquet(path)
    for block in range(n_blocks if n and index.n_docs else 0):
        q = queries_of(terms.where(F.pmod(F.xxhash64("_item"), F.lit(n_blocks)) == block).select("_item", "terms", "times").toArrow())
        if q is None:
            continue
        q.weigh(documents_of(index, q), index.n_docs)
        shared = spark.sparkContext.broadcast(q)

        def look(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q = shared.value
            best = Best(len(q.item), k)
            chunk = 64
            for batch in batches:
                search_batch(q, best, batch, chunk)
                chunk = 256
            yield pa.RecordBatch.from_arrays([pa.array(q.item[best.item]), pa.array(best.doc, mask=best.null), pa.array(best.score)], ["_item", "_doc", "score"])

        lists = index.rows.select("_id", "terms", "impacts", "sketch").mapInArrow(look, found).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(64)))
        top(lists, ["_item", "_part"], k).drop("_part", "rank").write.mode("append").parquet(path)
        shared.unpersist()
    ranked = top(spark.read.schema(found).parquet(path), ["_item"], k)
    return ranked.join(asked.select("_item", "_name"), "_item").select(F.col("_name").alias(item_id), F.col("rank").cast("int"), F.col("_doc").alias("doc_id"), "score")


def top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("_doc"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def queries_of(rows: pa.Table) -> Queries | None:
    if not rows.num_rows:
        return None
    rows = rows.combine_chunks()
    h, first = values_of(rows.column("terms").combine_chunks(), np.uint64)
    times, _ = values_of(rows.column("times").combine_chunks(), np.int64)
    return Queries(np.repeat(rows.column("_item").to_numpy(), np.diff(first)), h, times)


def documents_of(index: Index, q: Queries) -> np.ndarray:
    """How many documents hold each of the block's terms: tasks count, and the sums of at most ``most_terms`` slots come to the driver."""
    shared = index.rows.sparkSession.sparkContext.broadcast(q)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        total = np.zeros(len(q.known), dtype=np.int64)
        for batch in batches:
            total += np.bincount(q.slots(values_of(batch.column("terms"), np.uint64)[0])[1], minlength=len(total))
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], ["slot", "n"])

    sums = index.rows.select("terms").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(q.known), dtype=np.int64)
    out[sums["slot"].to_numpy()] = sums["n"].to_numpy()
    shared.unpersist()
    return out


UPPER, PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
WITH x AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{PLAIN}'), '{TERM}')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM x GROUP BY r, doc_id, term),
n AS (SELECT r, count(*) AS n FROM x GROUP BY r),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
y AS (
  SELECT i, item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{PLAIN}'), '{TERM}')) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)),
q AS (
  SELECT i, item_id, term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM y JOIN df USING (term), c),
s AS (
  SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN n USING (r), c GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW w AS (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)
QUALIFY row_number() OVER w <= 20
"""
