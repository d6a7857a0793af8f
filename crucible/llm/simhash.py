"""SimHash near-duplicates by multi-index hashing: Hamming balls within fingerprint halves, table matches, full distances.

``near_duplicates`` links fingerprints. ``near_texts`` links texts by the Jaccard similarity of their shingles: multi-index hashing finds the close
ones, and as 64 bits can't tell all pairs near the threshold from others, an exact pass over rare shingles adds what lies beyond the balls.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.llm.common import LOWER, byte_slices, components, in_blocks, local_roots, mix, pairs, runs, word_hashes, word_spans, written

_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Least bits of the parity map of a set, which has two for each item at least: sets whose maps differ in so many bits differ in as many items
#: at least. A map folds to half its length, so maps of any two sets compare.
PARITY = 1024


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the six white-space bytes
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], seed) for a, b in spans), dtype=np.uint64, count=len(words) - k + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # a very long text stays in bounded memory
        part = h[at : at + (1 << 16)].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. A null text counts as empty."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", shingle, seed) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(fps)], ["_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(scan, "_id long, fp long")


def near_links(fps: DataFrame, distance: int = 3, block: int = 2048) -> DataFrame:
    """Links (a, b) that span each group of fingerprints within ``distance`` bits of each other, found by multi-index hashing.

    Two fingerprints within 2r+1 bits have a half within r bits. Each half is a table. A fingerprint probes it at its own value and at the
    values of the ball of radius r around it; as a link may be found from either end, only values that set further bits are probed.
    Within a block of equal keys complete distances are verified in bulk, and a spanning forest of the links found is returned.
    """
    if distance not in (0, 1, 2, 3):
        raise ValueError("halves with balls of radius 1 serve distances up to 3")
    spread = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # each row becomes up to 34: spread them before
    halves = fps.repartition(spread, "fp").select("fp", F.posexplode(F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF))).alias("half", "v"))
    flips = F.filter(F.transform(F.array(*[F.lit(1 << b) for b in range(32)]), lambda bit: F.when(F.col("v").bitwiseAND(bit) == 0, F.col("v").bitwiseOR(bit))), lambda x: x.isNotNull())
    near = F.transform(flips, lambda x: F.struct(x.alias("key"), F.lit(True).alias("probe")))
    own = F.array(F.struct(F.col("v").alias("key"), F.lit(False).alias("probe")))
    rows = halves.select("fp", "half", F.explode(F.concat(own, near) if distance > 1 else own).alias("k")).select("fp", "half", "k.key", "k.probe")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches):
            fp = part.column("fp").to_numpy().view(np.uint64)
            block_, role = part.column("_block").to_numpy(), part.column("_role").to_numpy()
            alone = part.column("_self").combine_chunks().to_numpy(zero_copy_only=False)
            left, right = [], []
            for i, j in pairs(block_, role, alone):
                good = np.bitwise_count(fp[i] ^ fp[j]) <= distance
                i, j = i[good], j[good]
                root = local_roots(len(fp), i, j)
                touched = np.flatnonzero(root != np.arange(len(fp)))
                left.append(fp[touched])
                right.append(fp[root[touched]])
            if left:
                a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return in_blocks(rows, ["half", "key"], "fp", "probe", block).select("fp", "_block", "_role", "_self").mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3, seed: int = 42, block: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fingerprint, component_id), one for each row of ``docs``.

    fingerprint: 16 lower-case hex digits. component_id: the smallest id whose fingerprint is reachable by links of at most ``distance`` bits.
    Texts without words, null ones included, have fingerprint zero and link like any other. Equal fingerprints are one class: they are
    collapsed before pairs are sought, so large groups of copies cost one row. Repeated ids keep a row each; rows with a null id get the
    component of their fingerprint. A text of any length counts whole. An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    marks = written(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    classes = written(marks.groupBy("fp").agg(F.min("_id").alias("least")), "fingerprint-classes")
    groups = components(near_links(classes.select("fp"), distance, block))
    members = groups.join(classes, groups.node == classes.fp).select("fp", "component", "least")
    least = written(members.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    linked = written(members.join(least, "component").select("fp", "component_id"), "fingerprint-groups")
    per_class = written(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "fingerprint-components")
    return marks.join(per_class, "fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- texts alike by their shingles -------------------------------------------------------------------------------------


def _chained(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row."""
    g = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        g = mix(g * _STEP + h[i : i + len(g)])
    return g


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct shingles; a shorter text is one shingle, one without words has none."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    grams = _chained(h, shingle) if len(h) >= shingle else h[:0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(grams[a : b - shingle + 1]) if b - a >= shingle else _chained(h[a:b], b - a) if b > a else h[:0]


def set_class(items: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set: equal sets are one class."""
    return int(np.uint64(xxhash.xxh64_intdigest(items.tobytes(), 7)).astype(np.int64))


def set_mark(items: np.ndarray) -> tuple[int, bytes]:
    """(SimHash of a set as a signed long, its parity map)."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(items), 1 << 16):
        ones += np.unpackbits(items[at : at + (1 << 16)].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    fp = np.packbits(ones * 2 > len(items)).view(np.int64)[0]
    bits = max(PARITY, 1 << max(0, 2 * len(items) - 1).bit_length())
    return int(fp), np.packbits(np.bincount((items >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """The differing bits of two parity maps, the longer one folded to the shorter."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):
        x, y = (x, y[: len(y) // 2] ^ y[len(y) // 2 :]) if len(x) < len(y) else (x[: len(x) // 2] ^ x[len(x) // 2 :], y)
    return int(np.bitwise_count(x ^ y).sum())


def differing_pairs(maps: list[bytes], i: np.ndarray, j: np.ndarray, step: int = 1 << 22) -> np.ndarray:
    """``differing`` of the maps at each pair of places, the maps of a length folded at once; ``step`` words are compared at a time."""
    words = np.fromiter(map(len, maps), np.int64, count=len(maps)) // 8
    out = np.empty(len(i), dtype=np.int64)
    level = np.minimum(words[i], words[j])
    for n in np.unique(level).tolist():
        here = np.flatnonzero(level == n)
        used = np.unique(np.r_[i[here], j[here]])
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(maps[k], np.uint64).reshape(-1, n), axis=0) for k in used.tolist()])
        x, y = np.searchsorted(used, i[here]), np.searchsorted(used, j[here])
        for a in range(0, len(here), max(1, step // n)):
            b = slice(a, a + max(1, step // n))
            out[here[b]] = np.bitwise_count(folded[x[b]] ^ folded[y[b]]).sum(axis=1, dtype=np.int64)
    return out


def similar_links(sets: list[np.ndarray], group: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of similar enough sets, as many as it takes to connect all that are linked; sets of one ``group`` are connected already."""
    size = np.fromiter(map(len, sets), np.int64, count=len(sets))
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(size) - size
    mark = np.zeros(int(item.max()) + 1, dtype=np.int64)
    root, left, right = group.copy(), [], []
    for i in range(len(sets) - 1):
        other = root[i + 1 :] != root[i]
        if not other.any():
            continue
        own = item[first[i] : first[i] + size[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[item[first[i + 1] :]], first[i + 1 :] - first[i + 1])
        mark[own] = 0
        for j in (i + 1 + np.flatnonzero(other & (both * (num + den) >= num * (size[i] + size[i + 1 :])))).tolist():
            if root[j] != root[i]:
                left.append(i)
                right.append(j)
                root[root == root[j]] = root[i]
    return np.array(left, np.int64), np.array(right, np.int64)


def near_texts(docs: DataFrame, similarity: tuple[int, int] = (4, 5), shingle: int = 5, distance: int = 3, block: int = 2048, most_items: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, component_id), one for each row of ``docs``: the smallest id reachable by links of at least this Jaccard similarity.

    ``similarity``: numerator and denominator. Texts whose fingerprints are at most ``distance`` bits apart are found by multi-index hashing
    (``near_links``) and verified. The pairs that lie beyond are found by their rarest shingles: in any fixed order of the shingles, two sets that
    are similar enough share one among the first n - ceil(similarity n) + 1 of each, and the first they share leaves room for the overlap
    they need. Shingles that are frequent in a sample of the texts come last in the order; this saves work and decides nothing. Each shingle's
    rows meet its least set first; only those still in different components then meet in blocks. So no pair is missed, whatever its distance.

    Candidates are weighed by the parity maps of their sets, which bound the overlap from above, and those left are verified on whole sets.
    Blocks send no pairs out, but each row's first candidate and the groups of rows that candidates connect; groups that the first candidates
    leave in several components are compared whole, each in a task, and give as many links as it takes to connect them. So rows
    grow with a group's size, not with its square.
    Equal sets are one class; texts without words are alike. Rows with a null id get the component of their text, repeated ids keep a row each,
    an empty table gives an empty result, other columns are not read. Words, shingles and sets are compared by 64-bit hashes.
    """
    spark, (num, den) = docs.sparkSession, similarity
    if not 0 < num <= den:
        raise ValueError("a similarity above 0, up to 1")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in byte_slices(batch):
                found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(data, offsets, shingle)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["key", "n"])

    some = rows.where(F.pmod(F.xxhash64("_id"), F.lit(16)) == 0)
    often = max(8, some.count() // 2000)  # so the list stays short at any size
    late = some.mapInArrow(sampled, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= often).select("key").toArrow()
    shared = spark.sparkContext.broadcast(np.sort(late["key"].to_numpy().view(np.uint64)))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            for part, data, offsets in byte_slices(batch):
                classes, sizes, marks, keys, rare = [], [], [], [], []
                for items in shingle_sets(data, offsets, shingle):
                    n = len(items)
                    first = n - -(-num * n // den) + 1 if n else 0
                    if n and len(hot):
                        last = hot[np.minimum(np.searchsorted(hot, items), len(hot) - 1)] == items
                        head = np.concatenate([items[~last][:first], items[last][:first]])[:first]
                        rare.append(min(first, n - int(last.sum())))
                    else:
                        head = items[:first]
                        rare.append(first)
                    classes.append(set_class(items))
                    sizes.append(n)
                    marks.append(set_mark(items))
                    keys.append(head.view(np.int64))
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                flat = pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(classes, pa.int64()), pa.array(sizes, pa.int32()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(rare, pa.int32())],
                    ["_id", "cls", "size", "fp", "parity", "keys", "rare"],
                )

    marks = written(rows.mapInArrow(scan, "_id long, cls long, size int, fp long, parity binary, keys array<long>, rare int"), "set-marks")
    kinds = written(marks.groupBy("cls").agg(F.min("_id").alias("least")), "set-classes")
    leading = marks.join(kinds.withColumnRenamed("cls", "_c"), (F.col("cls") == F.col("_c")) & F.col("_id").eqNullSafe(F.col("least")))  # a row a class, or more where ids repeat
    classes = written(leading.select("cls", "least", "size", "fp", "parity").dropDuplicates(["cls"]), "class-marks")

    def fits(n, m, i, j):
        """Whether sets of n and m items whose first common item has places i and j can share enough."""
        return F.least(n - i, m - j).cast("long") * (num + den) >= (n + m).cast("long") * num

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            apart = np.fromiter(map(differing, batch.column("pa").to_pylist(), batch.column("pb").to_pylist()), np.int64, count=len(n))
            most = (n - apart) // 2
            yield batch.select(["a", "b"]).filter(pa.array(most * (num + den) >= num * n))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                n = len(both)
                both.sort(kind="stable")
                overlap = int((both[1:] == both[:-1]).sum())
                good.append(overlap * den >= num * (n - overlap))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in byte_slices(batch):
                items = list(shingle_sets(data, offsets, shingle))
                yield pa.RecordBatch.from_arrays([pa.array([set_class(x) for x in items], pa.int64()), pa.array([x.tobytes() for x in items], pa.binary())], ["cls", "items"])

    def whole_sets(nodes: DataFrame) -> DataFrame:
        wanted = nodes.join(kinds, "cls").select(F.col("least").alias("_want")).distinct()
        texts = rows.join(wanted, rows._id.eqNullSafe(wanted._want), "left_semi").select("_text")
        return written(texts.mapInArrow(sets, "cls long, items binary").join(nodes, "cls", "left_semi").dropDuplicates(["cls"]), "sets")

    def verified(found: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes whose whole sets are similar enough."""
        light = lambda c: classes.select(F.col("cls").alias(c), F.col("size").alias("n" + c), F.col("parity").alias("p" + c))
        maybe = found.distinct().join(light("a"), "a").join(light("b"), "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(weigh, "a long, b long")
        maybe = written(maybe, "set-pairs")
        items = whole_sets(written(maybe.select(F.col("a").alias("cls")).union(maybe.select("b")).distinct(), "set-nodes"))
        full = maybe.join(items.select(F.col("cls").alias("a"), F.col("items").alias("x")), "a").join(items.select(F.col("cls").alias("b"), F.col("items").alias("y")), "b")
        return written(full.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "set-links")

    # by fingerprints: links of near fingerprints, between the least class of each; classes of one fingerprint meet its least
    lead = written(classes.groupBy("fp").agg(F.min("cls").alias("lead")), "fingerprint-leads")
    near = near_links(lead.select("fp"), distance, block)
    ends = near.join(lead.select(F.col("fp").alias("a"), F.col("lead").alias("x")), "a").join(lead.select(F.col("fp").alias("b"), F.col("lead").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    equal = classes.select("cls", "fp").join(lead, "fp").where("cls != lead").select(F.col("lead").alias("a"), F.col("cls").alias("b"))
    links = verified(ends.union(equal))
    known = written(components(links), "near-components")

    # by rare shingles: the rows of those that two classes have. Shingles that are not frequent have few rows each, and meet in one shuffle
    every = leading.select("cls", "size", "rare", F.posexplode("keys").alias("at", "key"))
    plain = every.where(F.col("at") < F.col("rare")).select("key", "cls", (F.shiftleft(F.col("size").cast("long"), 32) + F.col("at")).alias("spot"))

    def repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "key"):
            key, cls, spot = (part.column(c).combine_chunks().to_numpy() for c in ("key", "cls", "spot"))
            same = key[1:] == key[:-1]
            again = np.r_[False, same & (cls[1:] == cls[:-1])]
            key, cls, spot = key[~again], cls[~again], spot[~again]
            same = key[1:] == key[:-1]
            good = np.r_[False, same] | np.r_[same, False] if len(key) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(key[good]), pa.array(cls[good]), pa.array((spot[good] >> 32).astype(np.int32)), pa.array((spot[good] & 0xFFFFFFFF).astype(np.int32))], ["key", "cls", "size", "at"])

    met = plain.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(repeated, "key long, cls long, size int, at int")
    shared_keys = written(met.union(every.where(F.col("at") >= F.col("rare")).select("key", "cls", "size", "at").distinct()), "shared-keys")
    rows_of = shared_keys.join(known.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", "size", "at", F.coalesce("component", "cls").alias("component"))
    leads = rows_of.groupBy("key").agg(F.min(F.struct("cls", "size", "at", "component")).alias("lead"), F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high").select("key", "lead")
    heads = written(rows_of.join(written(leads, "leads"), "key"), "prefix-rows")
    star = heads.where((F.col("component") != F.col("lead.component")) & fits(F.col("size"), F.col("lead.size"), F.col("at"), F.col("lead.at")))
    links = written(links.union(verified(star.select(F.least("lead.cls", "cls").alias("a"), F.greatest("lead.cls", "cls").alias("b")))), "links-so-far")
    known = written(components(links), "star-components")
    placed = written(heads.drop("component", "lead").join(known.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", "size", "at", F.coalesce("component", "cls").alias("component")), "placed")
    open_ = placed.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high").select("key")
    rest = written(placed.join(open_, "key", "left_semi"), "open-rows")

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(group, a, b): a class and its candidate of the least class, where group is null, or a group (a hash of its rows) and a row's class."""
        for part in runs(batches, rows=20_000):
            get = lambda c: part.column(c).combine_chunks().to_numpy(zero_copy_only=False)  # noqa: E731, B023
            cls, size, at, component = get("cls"), get("size").astype(np.int64), get("at").astype(np.int64), get("component")
            parity, each = part.column("parity").to_pylist(), np.arange(len(cls))
            root, least = each.copy(), cls.copy()
            for i, j in pairs(get("_block"), get("_role"), get("_self")):
                good = (component[i] != component[j]) & (np.minimum(size[i] - at[i], size[j] - at[j]) * (num + den) >= (size[i] + size[j]) * num)
                i, j = i[good], j[good]
                good = (size[i] + size[j] - differing_pairs(parity, i, j)) // 2 * (num + den) >= (size[i] + size[j]) * num
                i, j = i[good], j[good]
                np.minimum.at(least, i, cls[j])
                np.minimum.at(least, j, cls[i])
                joined = np.flatnonzero(root != each)
                root = local_roots(len(cls), np.r_[joined, i], np.r_[root[joined], j])
            follows = np.flatnonzero(least < cls)
            groups, ends = [], [0]
            inside = np.flatnonzero(np.bincount(root, minlength=len(cls))[root] > 1)
            inside = inside[np.lexsort((cls[inside], size[inside], root[inside]))]
            for rows_ in np.split(inside, np.flatnonzero(np.diff(root[inside])) + 1) if len(inside) else []:
                share = np.cumsum(size[rows_]) // most_items  # of a group with very large sets, each two shares meet
                for x, y in combinations(np.unique(share).tolist(), 2) if share[0] != share[-1] else [(share[0], share[0])]:
                    groups.append(cls[rows_[(share == x) | (share == y)]])
                    ends.append(ends[-1] + len(groups[-1]))
            names = np.array([set_class(np.sort(g)) for g in groups], dtype=np.int64)
            n, m = len(follows), ends[-1]
            of = np.r_[np.zeros(n, np.int64), np.repeat(names, np.diff(ends))]
            a, b = np.r_[least[follows], np.zeros(m, np.int64)], np.concatenate([cls[follows], *groups])
            yield pa.RecordBatch.from_arrays([pa.array(of, mask=np.r_[np.ones(n, bool), np.zeros(m, bool)]), pa.array(a), pa.array(b)], ["grp", "a", "b"])

    def connect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "grp", rows=4096):
            name, cls, component = (part.column(c).combine_chunks().to_numpy() for c in ("grp", "cls", "component"))
            items = part.column("items")
            edges = np.flatnonzero(np.r_[True, name[1:] != name[:-1], True])
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                i, j = similar_links([np.frombuffer(v, np.uint64) for v in items.slice(x, y - x).to_pylist()], component[x:y], num, den)
                yield pa.RecordBatch.from_arrays([pa.array(cls[x:y][i]), pa.array(cls[x:y][j])], ["a", "b"])

    dealt = in_blocks(rest, ["key"], "cls", block=block, payload=(classes.select("cls", "parity"), "cls"))
    met = written(dealt.select("cls", "size", "at", "component", "parity", "_block", "_role", "_self").mapInArrow(meet, "grp long, a long, b long"), "met")
    links = written(links.union(verified(met.where("grp is null").select("a", "b"))), "links-so-far")
    known = written(components(links), "candidate-components")
    grouped = written(met.where("grp is not null").select("grp", F.col("b").alias("cls")).distinct().join(known.withColumnRenamed("node", "cls"), "cls", "left").select("grp", "cls", F.coalesce("component", "cls").alias("component")), "groups")
    several = grouped.groupBy("grp").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high").select("grp")
    grouped = written(grouped.join(several, "grp", "left_semi"), "open-groups")
    whole = grouped.join(whole_sets(written(grouped.select("cls").distinct(), "set-nodes")), "cls").select("grp", "cls", "component", "items")
    linked = components(links.union(written(whole.repartition("grp").sortWithinPartitions("grp", "cls").mapInArrow(connect, "a long, b long"), "group-links")))
    members = linked.join(kinds.select("cls", "least"), F.col("node") == F.col("cls")).select("cls", "component", "least")
    least = written(members.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    of_class = members.join(least, "component").select("cls", "component_id")
    per_class = written(kinds.select("cls", "least").join(of_class, "cls", "left").select("cls", F.coalesce("component_id", "least").alias("component_id")), "set-components")
    return marks.select("_id", "cls").join(per_class, "cls").select(F.col("_id").alias(id_col), "component_id")
