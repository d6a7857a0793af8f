"""Substring deduplication: a compressed FM-index per shard, searched backwards by every segment that may repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.llm.common import bit_map, byte_slices, mix, on_map, runs, word_hashes, word_spans, written

LAST_ID = (1 << 63) - 1
_STEPS = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd factors for the places of a segment's words: enough for the longest, of ``most`` windows.
_POWERS = np.random.default_rng(8).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- segments: runs of windows that share an anchor ----------------------------------------------------------------


def segments(h: np.ndarray, first: np.ndarray, window: int, gram: int, most: int = 64):
    """(document, start, windows, anchor, periodic) of each run of windows with one anchor; ``h``: word hashes, ``first``: documents' first words.

    A window's anchor is the least hash of its word grams, so windows of equal words have equal anchors wherever they stand, and every
    window is in one segment. ``periodic`` marks segments that hold their anchor twice. Runs over ``most`` windows are cut.
    """
    n_grams = window - gram + 1
    n = len(h) - window + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, bool)
    g = np.zeros(len(h) - gram + 1, dtype=np.uint64)
    for k in range(gram):
        g += h[k : k + len(g)] * _STEPS[k]
    g = mix(g)
    low, width = g, 1
    while width * 2 <= n_grams:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < n_grams:
        low = np.minimum(low[: n + 0], low[n_grams - width : n_grams - width + n])
    low = low[:n]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = doc[:n] == doc[window - 1 :]
    new = np.ones(n, dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | ~whole[:-1]
    at = np.flatnonzero(new)
    run = np.arange(n) - np.repeat(at, np.diff(np.r_[at, n]))
    start = np.flatnonzero(whole & (run % most == 0))
    stop = np.ones(n + 1, dtype=bool)
    stop[:n] = ~whole | (run % most == 0)
    stops = np.flatnonzero(stop)
    count = stops[np.searchsorted(stops, start, "right")] - start
    hits = np.zeros(len(g) + 1, dtype=np.int64)
    anchors = low[start]
    # an anchor stands twice in a segment if its grams hold the value twice
    where = np.repeat(start, count + n_grams - 1) + (np.arange((count + n_grams - 1).sum()) - np.repeat(np.cumsum(count + n_grams - 1) - (count + n_grams - 1), count + n_grams - 1))
    same = g[where] == np.repeat(anchors, count + n_grams - 1)
    hits = np.add.reduceat(same, np.cumsum(count + n_grams - 1) - (count + n_grams - 1), dtype=np.int64) if len(start) else empty
    return doc[start], start - first[doc[start]], count, anchors, hits > 1


# --- the index -----------------------------------------------------------------------------------------------------


class Bits:
    """A bit vector with counts on two levels, 1.31 bits a bit: one number for each 512 bits, a small one for each 64."""

    def __init__(self, bit: np.ndarray):
        packed = np.packbits(bit.astype(np.uint8), bitorder="little")
        self.words = np.zeros((len(bit) // 512 + 1) * 8, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        each = np.bitwise_count(self.words).reshape(-1, 8).astype(np.int64)
        self.big = np.r_[0, np.cumsum(each.sum(axis=1))[:-1]].astype(np.uint32)
        self.small = (np.cumsum(each, axis=1) - each).astype(np.uint16).ravel()

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.big[at >> 9].astype(np.int64) + self.small[word] + np.bitwise_count(self.words[word] & mask)

    def nbytes(self) -> int:
        return self.words.nbytes + self.big.nbytes + self.small.nbytes


class WaveletTree:
    """Rank over a sequence of small integers: a bit vector for each level, as many levels as the alphabet needs."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.zeros = [], []
        now = values.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            self.bits.append(Bits(bit))
            self.zeros.append(int((bit == 0).sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, high = np.zeros(len(at), dtype=np.int64), at
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = (symbol >> level) & 1 == 1
            low, high = (np.where(one, self.zeros[k] + self.bits[k].rank(x), x - self.bits[k].rank(x)) for x in (low, high))
        return high - low


class FMIndex:
    """Backward search over symbols 1..; 0 ends each segment. Suffixes are sorted by their first ``threshold`` + 1 symbols, enough for patterns up to it.

    What stays after building: the wavelet tree of the transform, where each symbol begins, the stretches of suffixes with equal first
    ``threshold`` symbols as a bit vector and their first places, and each stretch's least ``position``. The suffixes themselves go.
    """

    def __init__(self, text: np.ndarray, threshold: int, position: np.ndarray):
        n, depth = len(text), threshold + 1
        rank, width = text.astype(np.int64), 1
        while True:
            nxt = np.zeros(n, dtype=np.int64)
            nxt[: n - width] = rank[width:] + 1
            key = rank * (nxt.max() + 1) + nxt if width < n else rank
            suffixes = np.argsort(key, kind="stable")
            ordered = key[suffixes]
            fresh = np.r_[False, ordered[1:] != ordered[:-1]]
            rank = np.empty(n, dtype=np.int64)
            rank[suffixes] = np.cumsum(fresh)
            width *= 2
            if width >= depth or width >= n:
                break
        self.threshold = threshold
        symbols = int(text.max()) + 1
        self.tree = WaveletTree(text[suffixes - 1], symbols)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols))]
        equal = np.ones(n, dtype=bool)
        for k in range(threshold):
            shifted = np.zeros(n, dtype=text.dtype)
            shifted[: n - k] = text[k:]
            s = shifted[suffixes]
            equal[1:] &= s[1:] == s[:-1]
        equal[0] = False
        self.opens = Bits(~equal)
        heads = np.flatnonzero(~equal)
        self.least = np.minimum.reduceat(position[suffixes], heads)
        self.heads = np.r_[heads, n].astype(np.uint32 if n < 1 << 32 else np.int64)

    def nbytes(self) -> int:
        return sum(b.nbytes() for b in [*self.tree.bits, self.opens]) + self.before.nbytes + self.heads.nbytes + self.least.nbytes

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that begin with a symbol and then what [low, high) begin with."""
        return self.before[symbol] + self.tree.rank(symbol, low), self.before[symbol] + self.tree.rank(symbol, high)

    def matches(self, starts: np.ndarray, lengths: np.ndarray, text: np.ndarray) -> np.ndarray:
        """For each position of the streamed segments the stretch of suffixes that match ``threshold`` symbols from there, else -1.

        Each segment is read from its end. Its match grows by one symbol to the left in a backward step; beyond the threshold it is
        shortened on the right, which widens the interval to its stretch. All segments take each step together.
        """
        found = np.full(len(text), -1, dtype=np.int64)
        live = np.argsort(-lengths, kind="stable")
        at = starts[live] + lengths[live] - 1
        low, high = np.zeros(len(live), dtype=np.int64), np.full(len(live), len(text), dtype=np.int64)
        ordered = -lengths[live]
        for step in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(ordered, -step, "left"))  # segments longer than step
            at, low, high = at[:n], low[:n], high[:n]
            low, high = self.extend(text[at], low, high)
            if step + 1 >= self.threshold:
                s = self.opens.rank(low + 1) - 1
                found[at] = s
                low, high = self.heads[s].astype(np.int64), self.heads[s + 1].astype(np.int64)
            at = at - 1
        return found


def earlier(words: np.ndarray, offsets: np.ndarray, order: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of segments (word hashes, offsets; order: 64-bit sort keys of their first words' positions) each window's (segment, offset, whether it starts earlier in some segment)."""
    lengths = np.diff(offsets)
    _, symbol = np.unique(words, return_inverse=True)
    text = np.zeros(len(words) + len(lengths), dtype=np.int64)
    place = np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)
    text[place] = symbol + 1
    starts = offsets[:-1] + np.arange(len(lengths))
    position = np.full(len(text), np.iinfo(np.int64).max)
    position[place] = np.repeat(order, lengths) + np.arange(len(words)) - np.repeat(offsets[:-1], lengths)
    index = FMIndex(text, window, position)
    found = index.matches(starts, lengths, text)
    at = np.flatnonzero(found >= 0)
    segment = np.searchsorted(starts, at, "right") - 1
    return segment, at - starts[segment], index.least[found[at]] < position[at]


# --- the job -------------------------------------------------------------------------------------------------------


def repeated_spans(docs: DataFrame, window: int = 20, gram: int = 5, block: int = 512, map_bits: int = 26) -> DataFrame:
    """Rows (_doc, _mark, spans) for ``docs`` (_doc, _mark, _text): spans are (first word, windows) of windows whose words also start earlier.

    1. Anchors of all segments are counted over the whole table. A bit map of fixed size (2**map_bits bits) keeps those that occur twice;
       where they are more than a sixteenth of its bits, segments are joined with them instead, and so are texts with what is searched in them.
    2. Segments whose anchor it shows are classed by anchor and words: of equal segments all but the earliest repeat it as a whole.
    3. The earliest segments of classes that share an anchor, or hold it twice, go to a shard by anchor, with their words. Each shard builds
       an FM-index over its segments and streams them through it. An anchor with over ``block`` classes is dealt to several shards, and
       the earliest places of its windows meet by hash after.
    A false hit of a bit map costs work, not correctness. Words are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    texts = docs.where(F.length("_text") >= 2 * window - 1)
    mask = (1 << map_bits) - 1

    def parts(batch: pa.RecordBatch):
        for rows, data, offsets in byte_slices(batch):
            starts, ends, first = word_spans(data, offsets)
            h = word_hashes(data, starts, ends)
            yield rows, h, first, segments(h, first, window, gram)

    def anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, (_, _, _, anchor, twice) in parts(batch):
                a, n = np.unique(anchor, return_counts=True)
                n = n + np.isin(a, anchor[twice])
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n.astype(np.int32))], ["anchor", "n"])

    twice = texts.select("_text").mapInArrow(anchors, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    twice = written(twice, "repeated-anchors")
    many = twice.count() > (1 << map_bits) // 16
    shared = None if many else spark.sparkContext.broadcast(bit_map(twice.select(F.shiftright("anchor", 3).bitwiseAND(mask).alias("slot")), map_bits))

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, h, first, (doc, start, count, anchor, twice) in parts(batch):
                keep = on_map(shared.value, (anchor.view(np.int64) >> 3) & mask) if shared else np.arange(len(doc))
                doc, start, count, anchor, twice = doc[keep], start[keep], count[keep], anchor[keep], twice[keep]
                size = count + window - 1
                ends = np.cumsum(size)
                within = np.arange(int(size.sum())) - np.repeat(ends - size, size)
                words = h[np.repeat(first[doc] + start, size) + within]
                digest = np.add.reduceat(words * _POWERS[within], ends - size) if len(keep) else np.zeros(0, np.uint64)
                digest = mix(digest ^ size.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("_doc").take(pa.array(doc)), rows.column("_mark").take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(twice)],
                    ["_doc", "_mark", "start", "n", "anchor", "digest", "twice"],
                )

    found = texts.select("_doc", "_mark", "_text").mapInArrow(candidates, "_doc long, _mark long, start int, n int, anchor long, digest long, twice boolean")
    found = written(found.join(twice, "anchor", "left_semi") if many else found, "segments")
    place = F.struct("_doc", "_mark", "start")
    classes = written(found.groupBy("anchor", "digest").agg(F.min(place).alias("first"), F.any_value("n").alias("n"), F.bool_or("twice").alias("twice"), F.count(F.lit(1)).alias("copies")), "segment-classes")
    sizes = written(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("in_all"), F.bool_or("twice").alias("any_twice")).where("in_all > 1 OR any_twice").select("anchor", "in_all"), "anchors")
    def pieces(h: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
        ends = np.cumsum(size)
        words = h[np.repeat(at - (ends - size), size) + np.arange(int(size.sum()))]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.r_[0, ends * 8].astype(np.int64)), pa.py_buffer(words.tobytes())]).cast(pa.binary())

    def by_map(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, asked = shared.value, searched.value
        for batch in batches:
            for rows, h, first, (doc, start, count, anchor, _) in parts(batch):
                ids, marks = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("_doc", "_mark"))
                keep = on_map(seen, (anchor.view(np.int64) >> 3) & mask)
                keep = keep[on_map(asked, (marks[doc[keep]] ^ ids[doc[keep]] ^ (start[keep] << 11)) & mask)]
                doc, start, count, anchor = doc[keep], start[keep], count[keep], anchor[keep]
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(marks[doc]), pa.array(start.astype(np.int32)), pa.array(anchor.view(np.int64)), pieces(h, first[doc] + start, count + window - 1)], ["_doc", "_mark", "start", "anchor", "words"])

    def by_join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in byte_slices(batch):
                starts, ends, first = word_spans(data, offsets)
                h = word_hashes(data, starts, ends)
                lists = rows.column("asked")
                n, each = np.diff(lists.offsets.to_numpy()), lists.flatten()
                start, count = (each.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                doc = np.repeat(np.arange(rows.num_rows), n)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([rows.column("_doc").take(take), rows.column("_mark").take(take), each.field(0), each.field(2), pieces(h, first[doc] + start, count + window - 1)], ["_doc", "_mark", "start", "anchor", "words"])

    content = "_doc long, _mark long, start int, anchor long, words binary"
    looked_up = classes.select("anchor", "first", "n").join(sizes.select("anchor"), "anchor")
    if many:
        asked = looked_up.groupBy("first._doc", "first._mark").agg(F.collect_list(F.struct("first.start", "n", "anchor")).alias("asked"))
        once = texts.select("_doc", "_mark", "_text").dropDuplicates(["_doc", "_mark"])
        rows = once.join(asked, ["_doc", "_mark"]).select("_doc", "_mark", "_text", "asked").mapInArrow(by_join, content)
    else:
        slot = F.col("first._mark").bitwiseXOR(F.col("first._doc")).bitwiseXOR(F.shiftleft(F.col("first.start").cast("long"), 11)).bitwiseAND(mask)
        searched = spark.sparkContext.broadcast(bit_map(looked_up.select(slot.alias("slot")), map_bits))
        rows = texts.select("_doc", "_mark", "_text").mapInArrow(by_map, content)
    hot = sizes.where(F.col("in_all") > block)
    if hot.isEmpty():
        dealt = rows.select("*", F.lit(False).alias("_split"), F.col("anchor").alias("_block"))
    else:
        salt = F.pmod(F.xxhash64("_doc", "_mark", "start"), F.ceil(F.col("in_all") / block))
        dealt = rows.join(hot, "anchor", "left").select("_doc", "_mark", "start", "anchor", "words", F.col("in_all").isNotNull().alias("_split"), F.xxhash64("anchor", F.coalesce(salt, F.lit(0).cast("long"))).alias("_block"))
    dealt = dealt.repartition("_block").sortWithinPartitions("_block")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, rows=20_000):
            part = part.combine_chunks()
            content = part.column("words").cast(pa.large_binary()).combine_chunks()
            _, offsets, data = content.buffers()
            off = np.frombuffer(offsets, dtype=np.int64)[content.offset : content.offset + len(content) + 1]
            words = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]].view(np.uint64)
            off = (off - off[0]) // 8
            doc, mark, start = (part.column(c).to_numpy() for c in ("_doc", "_mark", "start"))
            ids = np.zeros(len(doc), dtype=np.int64)
            by = np.lexsort((mark, doc))
            ids[by] = np.cumsum(np.r_[False, (doc[by][1:] != doc[by][:-1]) | (mark[by][1:] != mark[by][:-1])])
            segment, at, again = earlier(words, off, (ids << 32) + start, window)
            split = part.column("_split").combine_chunks().to_numpy(zero_copy_only=False)[segment]
            # a window of a split anchor may start earlier in another shard: its hash and place go out, one by one
            lone = np.flatnonzero(split & ~again)
            segment_, at_ = segment[lone], at[lone]
            h = np.zeros(len(lone), dtype=np.uint64)
            for k in range(window):
                h += words[off[segment_] + at_ + k] * _STEPS[k]
            # of the others those that start earlier, as runs of neighbours
            hit = np.flatnonzero(again)
            head = np.flatnonzero(np.r_[True, (segment[hit][1:] != segment[hit][:-1]) | (at[hit][1:] != at[hit][:-1] + 1)]) if len(hit) else np.zeros(0, np.int64)
            length = np.diff(np.r_[head, len(hit)])
            segment, at = np.r_[segment[hit][head], segment_], np.r_[at[hit][head], at_]
            take = pa.array(segment)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c).combine_chunks().take(take) for c in ("anchor", "_doc", "_mark")], pa.array((start[segment] + at).astype(np.int32)), pa.array(np.r_[length, np.ones(len(lone), np.int64)].astype(np.int32)), pa.array(np.r_[np.zeros(len(head), bool), np.ones(len(lone), bool)]), pa.array(np.r_[np.zeros(len(head), np.uint64), mix(h)].view(np.int64))],
                ["anchor", "_doc", "_mark", "start", "n", "open", "window"],
            )

    windows = written(dealt.mapInArrow(search, "anchor long, _doc long, _mark long, start int, n int, open boolean, window long"), "windows")
    late = windows.where("NOT open").select("_doc", "_mark", "start", "n")
    apart = windows.where("open")
    if not hot.isEmpty():
        least = written(apart.groupBy("anchor", "window").agg(F.min(place).alias("least")), "earliest-windows")
        late = late.union(apart.join(least, ["anchor", "window"]).where(F.col("least") < place).select("_doc", "_mark", "start", "n"))
    copied = classes.where("copies > 1").select("anchor", "digest", "first")
    copies = found.select("_doc", "_mark", "start", "n", "anchor", "digest").join(copied, ["anchor", "digest"]).where(place != F.col("first")).select("_doc", "_mark", "start", "n")
    return written(copies.union(late).groupBy("_doc", "_mark").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "repeated-spans")


def deduplicate(docs: DataFrame, window: int = 20, gram: int = 5, block: int = 512, map_bits: int = 26, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, *keep, n_words, n_removed, kept_sha256, kept_text), one for each row of ``docs``.

    A word goes if a window of ``window`` words over it also starts earlier: in a smaller id, or earlier in the same document. Windows are
    judged on the input. kept_text is the text itself where no word goes (null stays null), else its kept words joined by one space;
    kept_sha256 is always that of the joined words. Null ids count as the largest id; rows that share an id are told apart by a hash of the
    text, and rows with equal id and text are one document. Texts with fewer words than a window keep all; an empty table stays empty.
    Columns of ``keep`` that have the name of a result column are left out.
    """
    mark = F.xxhash64(F.col(text_col).cast("string"))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_doc"), mark.alias("_mark"), F.col(text_col).cast("string").alias("_text"))
    spans = repeated_spans(base, window, gram, block, map_bits)
    others = [c for c in dict.fromkeys(keep) if c not in (id_col, text_col, "n_words", "n_removed", "kept_sha256", "kept_text")]
    rows = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_keep_{c}") for c in others], F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_doc"), mark.alias("_mark"), F.col(text_col).cast("string").alias("_text"))
    joined = rows.join(spans.hint("shuffle_hash"), ["_doc", "_mark"], "left").drop("_doc", "_mark")
    names = ["_id", *[f"_keep_{c}" for c in others]]
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields}

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (text or b"").split()
                kept = text
                n = len(words)
                if spans:
                    gone = np.zeros(n + 1, dtype=np.int64)
                    at = np.array([(s["start"], s["start"] + s["n"] + window - 1) for s in spans])
                    np.add.at(gone, at[:, 0], 1)
                    np.add.at(gone, at[:, 1], -1)
                    words = [w for w, g in zip(words, np.cumsum(gone)[:n].tolist(), strict=True) if g == 0]
                line = b" ".join(words)
                if spans:
                    kept = line
                out.append((n, n - len(words), hashlib.sha256(line).hexdigest(), kept))
            n, gone, digest, kept = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], [*names, "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = joined.mapInArrow(cut, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_keep_{c}").alias(c) for c in others], "n_words", "n_removed", "kept_sha256", "kept_text")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS k FROM s),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM r WHERE n > 1),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
q AS (SELECT p.doc_id, count(*) FILTER (g.p IS NOT NULL) AS n_removed, string_agg(x, ' ' ORDER BY p.p) FILTER (g.p IS NULL) AS kept FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.p = g.p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN q ON d.doc_id = q.doc_id
"""
