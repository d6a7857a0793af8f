"""Benchmark decontamination by spaced seeds: hashes under fixed masks are joined, then substitution-tolerant overlaps around the hits verified."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.llm.common import LOWER, bit_map, byte_slices, mix, on_map, runs, word_hashes, word_spans, written

#: 1 takes part in the hash, 0 is ignored: a substitution there doesn't hide the seed. Six words in a row that agree are found under any of them.
MASKS = ("111011", "110111", "1110011", "1101011", "1011101")
SHORTEST = min(map(len, MASKS))
#: Everything but letters, digits and non-ASCII bytes separates words here, so that punctuation doesn't matter.
_GAP = np.ones(256, dtype=bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FACTOR = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_DIGIT = 1 << 30


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each document) of lower-cased words."""
    starts, ends, first = word_spans(data, offsets, _GAP)
    return word_hashes(LOWER[data], starts, ends), first


def seeds(h: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) under a mask, for all places where it lies within one document."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[:n] == doc[len(mask) - 1 :])
    out = np.full(len(at), int(mask, 2), dtype=np.uint64)
    for k, taken in enumerate(mask):
        if taken == "1":
            out += h[at + k] * _FACTOR[k]
    return at, mix(out)


def best_stretches(same: np.ndarray, sizes: np.ndarray, penalty: int) -> np.ndarray:
    """Of rows laid end to end (``sizes`` places each, whether their words agree) the agreeing places of the best stretch of each.

    Places that agree count 1, the others -``penalty``; of equal stretches that with most agreeing places counts. Rows of about the same length go together, a few million places at a time.
    """
    matched, begin_of = np.zeros(len(sizes), dtype=np.int64), np.cumsum(sizes) - sizes
    order, a = np.argsort(sizes, kind="stable"), 0
    while a < len(order):
        longest = int(sizes[order[min(len(order), a + 4096) - 1]])
        rows = order[a : a + max(1, min(4096, (1 << 22) // max(1, longest)))]
        a += len(rows)
        width = int(sizes[rows].max())
        if not width:
            continue
        inside = np.arange(width) < sizes[rows, None]
        hit = inside & same[np.minimum(begin_of[rows, None] + np.arange(width), len(same) - 1)]
        # a step that agrees weighs one in the low digits too: of equal scores the one with most agreeing places counts
        total = np.cumsum(np.where(hit, _DIGIT + 1, -penalty * _DIGIT), axis=1)
        floor = np.minimum.accumulate(np.c_[np.zeros(len(rows), np.int64), total], axis=1)[:, :-1]
        matched[rows] = np.maximum((total - floor).max(axis=1), 0) % _DIGIT
    return matched


def long_binary(words: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of word hashes laid end to end, as binary values."""
    ends = np.r_[0, np.cumsum(sizes) * 8].astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(words.tobytes())]).cast(pa.binary())


def surroundings(h: np.ndarray, first: np.ndarray, at: np.ndarray, reach: int, nothing: int) -> pa.Array:
    """Half the hash of each word from ``reach`` before the seeds at ``at`` to ``reach`` after the longest mask; ``nothing`` beyond the text."""
    width = 2 * reach + max(map(len, MASKS))
    doc = np.searchsorted(first, at, "right") - 1
    place = at[:, None] - reach + np.arange(width)
    inside = (place >= first[doc, None]) & (place < first[doc + 1, None])
    out = np.where(inside, h[np.clip(place, 0, max(0, len(h) - 1))].astype(np.uint32) if len(h) else np.uint32(nothing), np.uint32(nothing)).astype(np.uint32)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * width), len(at), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


def needed(size: np.ndarray, words: int, share: float) -> np.ndarray:
    """How many words of items of ``size`` words must agree."""
    return np.maximum(np.minimum(words, np.ceil(share * size)), np.minimum(size, SHORTEST))


def crowded_lines(hits: DataFrame, entries: DataFrame, words: int, share: float, most_items: int = 256, most_hits: int = 16_384) -> DataFrame:
    """Rows (_doc, _mark, _item, size, shift): where seeds that many items hold meet, the pairs whose surroundings agree in enough words.

    ``hits``: (hash, _doc, _mark, at, around), ``entries``: (hash, _item, spot, size, around). Both sides of a hash are dealt to blocks of
    bounded size, in which surroundings are compared; only pairs that can count leave a task.
    """
    hits = written(hits.dropDuplicates(["hash", "_doc", "_mark", "at"]), "crowded-hits")
    cuts = entries.groupBy("hash").agg(F.ceil(F.count(F.lit(1)) / most_items).cast("int").alias("_ni"))
    cuts = written(cuts.join(hits.groupBy("hash").agg(F.ceil(F.count(F.lit(1)) / most_hits).cast("int").alias("_nh")), "hash"), "crowded-cuts")

    def dealt(rows: DataFrame, role: int, own: str, others: str, key: list[str]) -> DataFrame:
        mine, theirs = F.pmod(F.xxhash64(*key), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        rows = rows.join(cuts, "hash").withColumn("_own", mine).withColumn("_other", theirs)
        return rows.withColumns({"_block": F.xxhash64("hash", *(("_own", "_other") if role == 0 else ("_other", "_own"))), "_role": F.lit(role)})

    nil = F.lit(None).cast("long")
    sides = dealt(entries, 0, "_ni", "_nh", ["_item", "spot"]).select("_block", "_role", "hash", "_item", F.col("spot").cast("long").alias("at"), "size", nil.alias("_doc"), nil.alias("_mark"), "around")
    sides = sides.union(dealt(hits, 1, "_nh", "_ni", ["_doc", "_mark", "at"]).select("_block", "_role", "hash", nil, "at", F.lit(0), "_doc", "_mark", "around"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, rows=8192):
            block, role, key, at, size = (part.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("_block", "_role", "hash", "at", "size"))
            around = np.frombuffer(b"".join(part.column("around").to_pylist()), np.uint32).reshape(part.num_rows, -1)
            need = needed(size.astype(np.int64), words, share)
            edges = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                m = a + int(np.searchsorted(role[a:b], 1))
                step = max(1, (1 << 16) // max(1, m - a))
                for c in range(m, b, step) if m > a else ():
                    d = min(b, c + step)
                    same = np.zeros((m - a, d - c), dtype=np.int32)
                    for k in range(around.shape[1]):
                        same += around[a:m, k, None] == around[None, c:d, k]
                    i, j = np.nonzero((same >= need[a:m, None]) & (key[a:m, None] == key[None, c:d]))
                    i, j = pa.array(i + a), pa.array(j + c)
                    shift = pa.array(at[j] - at[i])
                    yield pa.RecordBatch.from_arrays([*(part.column(n).combine_chunks().take(w) for n, w in (("_doc", j), ("_mark", j), ("_item", i), ("size", i))), shift], ["_doc", "_mark", "_item", "size", "shift"])

    return sides.repartition("_block").sortWithinPartitions("_block", "_role").mapInArrow(compare, "_doc long, _mark long, _item long, size int, shift long")


def overlaps(docs: DataFrame, benchmark: DataFrame, words: int = 12, share: float = 0.6, penalty: int = 2, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", most_bits: int = 27, crowd: int = 64) -> DataFrame:
    """Rows (_doc, _mark, item_id, matched, item_words) of the overlaps that are long enough; _mark is xxhash64 of the document's text.

    1. Seeds of all items under all masks; a bit map of them (2**``most_bits`` bits at most) lets tasks drop most seeds of documents.
    2. The seeds left are joined with the items' by hash: each hit is a diagonal of a document and an item.
    3. Documents with hits are read again for the words along their diagonals, which meet the item's words in a join and are verified.
    Items shorter than the shortest mask are seeds as a whole, for each length that occurs.

    A seed that more than ``crowd`` places of items hold (a phrase of many questions) makes a diagonal only where enough words agree within
    ``reach`` words of it, found in blocks of bounded size. Of a counting overlap that ends within ``reach`` words of the seed on either side,
    ``words`` words agree there, since a best stretch loses nothing at its ends; an overlap that goes on beyond on both sides needs another seed.
    """
    spark = docs.sparkSession
    reach = -(-words * (1 + penalty) // max(1, penalty))
    kept = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull())
    kept = kept.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("_text")).distinct().select("*", F.xxhash64("item_id", "_text").alias("_item"))

    def items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in byte_slices(batch):
                h, first = plain_words(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column("_item"), part.column("item_id"), pa.array(np.diff(first).astype(np.int32)), long_binary(h, np.diff(first))], ["_item", "item_id", "size", "words"])

    item_rows = written(kept.mapInArrow(items, "_item long, item_id long, size int, words binary"), "items")

    def item_seeds(batches: Iterable[pa.RecordBatch], crowds=None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy().astype(np.int64)
            h, first = np.frombuffer(b"".join(batch.column("words").to_pylist()), dtype=np.uint64), np.r_[0, np.cumsum(sizes)]
            found = [seeds(h, first, m) for m in MASKS]
            for n in range(1, SHORTEST):
                at, hashes = seeds(h, first, "1" * n)
                whole = sizes[np.searchsorted(first, at, "right") - 1] == n
                found.append((at[whole], hashes[whole]))
            at, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
            if crowds:
                maybe = on_map(crowds.value, (hashes >> np.uint64(64 - bits)).astype(np.int64))
                at, hashes = at[maybe], hashes[maybe]
            item = np.searchsorted(first, at, "right") - 1
            rows = [pa.array(hashes.view(np.int64)), batch.column("_item").take(pa.array(item)), pa.array((at - first[item]).astype(np.int32)), batch.column("size").take(pa.array(item))]
            yield pa.RecordBatch.from_arrays([*rows, *([surroundings(h, first, at, reach, 1)] if crowds else [])], ["hash", "_item", "spot", "size", *(["around"] if crowds else [])])

    seeded = written(item_rows.select("_item", "size", "words").mapInArrow(item_seeds, "hash long, _item long, spot int, size int"), "item-seeds")
    bits = max(16, min(most_bits, seeded.count().bit_length() + 7))  # one in a hundred strangers passes
    sieve = bit_map(seeded.select(F.shiftrightunsigned("hash", 64 - bits).alias("slot")), bits)
    short = [r[0] for r in item_rows.where(F.col("size").between(1, SHORTEST - 1)).select("size").distinct().collect()]  # lengths, a few at most
    shared = spark.sparkContext.broadcast(sieve)
    held = written(seeded.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd).select("hash"), "crowded-seeds")
    crowds = None if held.isEmpty() else spark.sparkContext.broadcast(bit_map(held.select(F.shiftrightunsigned("hash", 64 - bits).alias("slot")), bits))
    masks = (*MASKS, *("1" * n for n in sorted(short)))
    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), F.xxhash64(F.col(text_col).cast("string")).alias("_mark"), F.col(text_col).cast("string").alias("_text"))

    def sieved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, shift = shared.value, np.uint64(64 - bits)
        for batch in batches:
            for part, data, offsets in byte_slices(batch):
                h, first = plain_words(data, offsets)
                for mask in masks:
                    at, hashes = seeds(h, first, mask)
                    maybe = on_map(seen, (hashes >> shift).astype(np.int64))
                    at, hashes = at[maybe], hashes[maybe]
                    doc = np.searchsorted(first, at, "right") - 1
                    rows = [part.column("_doc").take(pa.array(doc)), part.column("_mark").take(pa.array(doc)), pa.array((at - first[doc]).astype(np.int64)), pa.array(hashes.view(np.int64))]
                    around = pa.nulls(len(at), pa.binary())
                    if crowds and len(at):
                        full = np.zeros(len(at), dtype=bool)
                        full[on_map(crowds.value, (hashes >> shift).astype(np.int64))] = True
                        order = np.where(full, np.cumsum(full) - 1, 0)
                        around = surroundings(h, first, at[full], reach, 0).take(pa.array(order, mask=~full))
                    yield pa.RecordBatch.from_arrays([*rows, around], ["_doc", "_mark", "at", "hash", "around"])

    hits = texts.mapInArrow(sieved, "_doc long, _mark long, at long, hash long, around binary")
    line = F.col("_doc"), F.col("_mark"), F.col("_item"), F.col("size"), (F.col("at") - F.col("spot")).alias("shift")
    if crowds:
        hits = written(hits, "hits")
        entries = item_rows.select("_item", "size", "words").mapInArrow(lambda batches: item_seeds(batches, crowds), "hash long, _item long, spot int, size int, around binary")
        entries = written(entries.join(held, "hash", "left_semi"), "crowded-entries")
        near = crowded_lines(hits.join(held, "hash", "left_semi"), entries, words, share)
        lines = hits.drop("around").join(seeded.join(held, "hash", "left_anti"), "hash").select(*line).union(near)
    else:
        lines = hits.drop("around").join(seeded, "hash").select(*line)
    lines = written(lines.distinct(), "diagonals")
    asked = lines.groupBy(F.col("_doc").alias("_d"), F.col("_mark").alias("_m")).agg(F.collect_list(F.struct("_item", "size", "shift")).alias("lines"))
    asked = written(asked, "documents-with-hits")

    def along(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in byte_slices(batch):
                h, first = plain_words(data, offsets)
                lists = part.column("lines")
                n = np.diff(lists.offsets.to_numpy())
                line = lists.flatten()
                item, size, shift = (line.field(k) for k in range(3))
                doc, shift = np.repeat(np.arange(part.num_rows), n), shift.to_numpy()
                low, high = np.maximum(shift, 0), np.minimum(shift + size.to_numpy(), np.diff(first)[doc])
                for a in range(0, len(doc), 4096):
                    cut = slice(a, a + 4096)
                    length = (high - low)[cut]
                    ends = np.cumsum(length)
                    taken = h[np.repeat((first[doc] + low)[cut] - (ends - length), length) + np.arange(int(length.sum()))]
                    take = pa.array(doc[cut])
                    yield pa.RecordBatch.from_arrays([part.column("_doc").take(take), part.column("_mark").take(take), item.slice(a, len(length)), pa.array((low - shift)[cut]), long_binary(taken, length)], ["_doc", "_mark", "_item", "low", "found"])

    found = texts.join(asked, texts._doc.eqNullSafe(asked._d) & (texts._mark == asked._m)).select("_doc", "_mark", "_text", "lines").mapInArrow(along, "_doc long, _mark long, _item long, low long, found binary")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, item = batch.column("found").to_pylist(), batch.column("words").to_pylist()
            low = batch.column("low").to_numpy()
            sizes = np.array([len(x) // 8 for x in found], dtype=np.int64)
            own = b"".join(w[8 * a : 8 * a + len(x)] for x, w, a in zip(found, item, low.tolist(), strict=True))
            same = np.frombuffer(b"".join(found), np.uint64) == np.frombuffer(own, np.uint64)
            matched = best_stretches(same, sizes, penalty)
            whole = batch.column("size").to_numpy().astype(np.int64)
            good = pa.array(matched >= needed(whole, words, share))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).filter(good) for c in ("_doc", "_mark", "item_id")], pa.array(matched).filter(good), pa.array(whole).filter(good)], ["_doc", "_mark", "item_id", "matched", "item_words"])

    met = found.join(item_rows, "_item").select("_doc", "_mark", "low", "found", "item_id", "size", "words")
    return written(met.mapInArrow(verify, "_doc long, _mark long, item_id long, matched long, item_words long").where("matched > 0"), "overlaps")


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = 12, share: float = 0.6, id_col: str = "doc_id", text_col: str = "text", crowd: int = 64) -> DataFrame:
    """Rows (id, item_id, matched, item_words): each document and benchmark item whose overlap is long enough.

    An overlap counts if at least ``words`` of its words, or ``share`` of the item's where that is fewer, agree in place (substitutions cost
    two words each), and never fewer than six unless the item is shorter, when it must agree whole. Null texts and items, and items with null
    ids or without words, match nothing. Repeated rows give one row, items that share an id count as one, documents with null ids are reported
    together under a null id. Texts and items of any length are compared whole. Empty tables give an empty result; other columns are not read.
    """
    found = overlaps(docs, benchmark, words, share, id_col=id_col, text_col=text_col, crowd=crowd)
    best = found.groupBy("_doc", "item_id").agg(F.max(F.struct("matched", "item_words")).alias("best"))
    return best.select(F.col("_doc").alias(id_col), "item_id", "best.matched", "best.item_words")


def without_leaks(docs: DataFrame, benchmark: DataFrame, words: int = 12, share: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found (see ``leaks``), with all their columns, unchanged."""
    found = overlaps(docs, benchmark, words, share, id_col=id_col, text_col=text_col)
    found = written(found.select("_doc", "_mark").distinct(), "leaked")
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(found["_doc"]) & (F.xxhash64(docs[text_col].cast("string")) == found["_mark"]), "left_anti")
