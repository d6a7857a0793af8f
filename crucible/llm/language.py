"""Language identification by prediction by partial matching: frozen context trees over all 256 byte values, exact code lengths."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.llm.common import byte_slices, held_out, written

#: Stands before a text's start; no UTF-8 text holds it, so the other byte values are what is predicted.
START, VALUES = 0xFF, 255


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the three before it in its text and itself, as one number."""
    code = data.astype(np.uint32)
    for back in (1, 2, 3):
        before = np.full(len(data), START, dtype=np.uint32)
        before[back:] = data[:-back]
        for k in range(back):
            edge = offsets[:-1] + k
            before[edge[edge < len(data)]] = START
        code |= before << np.uint32(8 * back)
    return code


class ContextTree:
    """A language's contexts of 3, 2, 1 and 0 bytes that its texts hold, in sorted arrays: a level for each order.

    Escapes follow method C with exclusion: of the symbols that no longer context has shown, a context that holds d distinct ones n times in all
    gives c / (n + d) to each (seen c times) and d / (n + d) to the next shorter context. One that was never seen, or holds none of these
    symbols, passes on at no cost. Beyond order 0 all values left are alike.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        order = np.argsort(gram, kind="stable")
        key, count = gram[order].astype(np.uint32), n[order].astype(np.int64)
        self.levels = []
        levels = [(key, count)]
        for bytes_ in (3, 2, 1):
            low = levels[-1][0] & np.uint32((1 << 8 * bytes_) - 1)
            by = np.argsort(low, kind="stable")
            short, first = np.unique(low[by], return_index=True)
            levels.append((short, np.add.reduceat(levels[-1][1][by], first) if len(first) else np.zeros(0, np.int64)))
        for k, (key, count) in enumerate(levels):
            context, first = np.unique(key >> np.uint32(8), return_index=True)
            sums = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64)  # noqa: E731, B023
            kinds = np.diff(np.r_[first, len(key)])
            if k < 3:  # how often the shorter context shows the symbols that this one has shown
                below, times = levels[k + 1]
                shown = sums(times[np.searchsorted(below, key & np.uint32((1 << 8 * (3 - k)) - 1))])
            else:
                shown = np.zeros(len(context), np.int64)
            self.levels.append((key, count, context, sums(count), kinds, shown))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """The code length of the last byte of each gram after the others."""
        out, open_ = np.zeros(len(gram)), np.arange(len(gram))
        gone_n, gone_kinds = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)  # of this level's symbols, those excluded
        for k, (key, count, context, total, kinds, shown) in enumerate(self.levels):
            if not len(key) or not len(open_):
                break
            g = gram[open_] & np.uint32((1 << 8 * (4 - k)) - 1)
            c = np.minimum(np.searchsorted(context, g >> np.uint32(8)), len(context) - 1)
            known = context[c] == g >> np.uint32(8)
            n, d = total[c] - gone_n[open_], kinds[c] - gone_kinds[open_]
            at = np.minimum(np.searchsorted(key, g), len(key) - 1)
            hit = known & (key[at] == g)
            both = np.maximum(n + d, 1)
            out[open_[hit]] += np.log2(both[hit] / count[at[hit]])
            leaves = known & ~hit & (d > 0)
            out[open_[leaves]] += np.log2(both[leaves] / d[leaves])
            gone_n[open_] = np.where(known, shown[c], 0)
            gone_kinds[open_] = np.where(known, kinds[c], 0)
            open_ = open_[~hit]
        left = VALUES - gone_kinds[open_]
        out[open_] += np.log2(np.maximum(left, 1))
        return out


class Costs:
    """Code lengths of the grams that a task has met, under each tree; computed once for each."""

    def __init__(self, trees: list[ContextTree], most_cells: int = 1 << 23):
        self.trees, self.most = trees, most_cells // max(1, len(trees))
        self.key, self.bits = np.zeros(0, np.uint32), np.zeros((len(trees), 0), np.float32)

    def of(self, gram: np.ndarray) -> np.ndarray:
        """(trees, grams) of distinct sorted grams."""
        new = gram[~self._has(gram)]
        if len(self.key) + len(new) > self.most:
            self.key, self.bits, new = self.key[:0], self.bits[:, :0], gram
        if len(new):
            key = np.concatenate([self.key, new])
            order = np.argsort(key, kind="stable")
            fresh = np.array([t.bits(new) for t in self.trees], dtype=np.float32).reshape(len(self.trees), len(new))
            self.key, self.bits = key[order], np.concatenate([self.bits, fresh], axis=1)[:, order]
        return self.bits[:, np.searchsorted(self.key, gram)]

    def _has(self, gram: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(gram), dtype=bool)
        return self.key[np.minimum(np.searchsorted(self.key, gram), len(self.key) - 1)] == gram


def classify(docs: DataFrame, lang_col: str = "lang", fold: int = 0, most_grams: int = 20_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, held_out, lang_pred, score), one for each row of ``docs``.

    For each language seen outside fold ``fold`` of crc32(id) mod 5, a context tree of order 3 is counted over all its texts, byte by byte.
    A text goes to the language that codes it in the fewest bits (ties: first by name); score is that language's share of the total likelihood.
    Texts that are null or have no letter, and all texts if nothing was learnt, get ``und`` and score 0. Only the text is an input; its
    language, source and id are not. A very long text is read whole. Repeated rows keep a row each and count as often as they stand; rows
    with null ids are training texts; an empty table gives an empty result; other columns are not read.

    Trees are sparse: they hold what was seen. Those of languages with together about ``most_grams`` grams go to the tasks in one
    broadcast; where all languages have more, texts pass through several such groups, one after the other, and are written in between, so that
    no task holds more than one group. A group holds one language at least, whose grams its different four-byte strings bound.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    train = rows.where(~held_out("_id", fold) & F.col("_lang").isNotNull() & F.col("_text").isNotNull()).select("_lang", "_text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in byte_slices(batch, most=1 << 23):
                own = np.array(part.column("_lang").to_pylist(), dtype=object)
                every, sizes = grams(data, offsets), np.diff(offsets)
                for name in dict.fromkeys(own.tolist()):
                    g, n = np.unique(every[np.repeat(own == name, sizes)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * max(1, len(g)), pa.string()), pa.array(g.astype(np.int64) if len(g) else [None], pa.int64()), pa.array(n if len(g) else [0], pa.int64())], ["lang", "gram", "n"])

    counted = written(train.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    groups: list[list[str]] = []
    held = most_grams
    for r in sorted(counted.groupBy("lang").agg(F.count("gram").alias("n")).collect()):  # one row a language
        held += r["n"]
        if held > most_grams or not groups:
            groups.append([])
            held = r["n"]
        groups[-1].append(r["lang"])

    def predict(batches: Iterable[pa.RecordBatch], shared, kept: list[str]) -> Iterator[pa.RecordBatch]:
        names, trees = shared.value
        costs = Costs(trees)
        for batch in batches:
            for part, data, offsets in byte_slices(batch, most=1 << 22):
                gram, at = np.unique(grams(data, offsets), return_inverse=True)
                full = np.flatnonzero(np.diff(offsets))
                cost = np.zeros((len(names), part.num_rows))
                for k, bits in enumerate(costs.of(gram)):
                    if len(full):
                        cost[k, full] = np.add.reduceat(bits[at], offsets[full], dtype=np.float64)
                best = cost.argmin(axis=0)
                low = cost.min(axis=0)
                share = np.exp2(np.maximum(low - cost, -1000)).sum(axis=0)  # in units of the best's likelihood
                had = [part.column(c).to_numpy(zero_copy_only=False) for c in ("bits", "share")]
                better = ~(had[0] <= low)  # none before is NaN
                before = [names[b] if up else old for b, up, old in zip(best.tolist(), better.tolist(), part.column("lang_pred").to_pylist(), strict=True)]
                top = np.where(better, low, had[0])
                was = had[1] * np.exp2(np.maximum(np.where(np.isnan(had[0]), 0, top - had[0]), -1000))  # the share before the first group is 0
                out = [pa.array(before, pa.string()), pa.array(top), pa.array(was + share * np.exp2(np.maximum(top - low, -1000)))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *out], [*kept, "lang_pred", "bits", "share"])

    asked = rows.select("_id", "_text", F.coalesce(F.col("_text").rlike(r"\p{L}"), F.lit(False)).alias("_letter"), F.lit(None).cast("string").alias("lang_pred"), F.lit(float("nan")).alias("bits"), F.lit(0.0).alias("share"))
    for k, names in enumerate(groups):
        found = counted.where(F.col("lang").isin(names) & F.col("gram").isNotNull()).toArrow()
        of, gram, n = np.array(found["lang"].to_pylist(), dtype=object), found["gram"].to_numpy(), found["n"].to_numpy()
        shared = spark.sparkContext.broadcast((names, [ContextTree(gram[of == name], n[of == name]) for name in names]))
        kept = ["_id", "_letter"] + ["_text"] * (k + 1 < len(groups))  # the last group lets the text go
        schema = asked.select(*kept, "lang_pred", "bits", "share").schema
        asked = asked.mapInArrow(lambda batches, shared=shared, kept=kept: predict(batches, shared, kept), schema)
        if k + 1 < len(groups):
            asked = written(asked, "asked-languages")
            shared.destroy()  # so that tasks hold one group's trees at a time
    known = F.col("_letter") & F.col("lang_pred").isNotNull()
    return asked.select(F.col("_id").alias(id_col), held_out("_id", fold).alias("held_out"), F.when(known, F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(known, 1 / F.col("share")).otherwise(0.0).alias("score"))
