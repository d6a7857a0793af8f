"""Threshold search on fingerprints: an index by sizes and sets of rarest tokens, so that only rows that can reach the threshold are scored."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crucible.llm.common import bit_map, mix, on_map
from crucible.operators import ranking
from crucible.scratch import written

_SLACK = 1e-9
#: The Jaccard similarity that each metric's threshold stands for.
JACCARD_OF = {"jaccard": lambda t: t, "dice": lambda t: t / (2 - t), "sokal_sneath": lambda t: 2 * t / (1 + t), "kulczynski1": lambda t: t / (1 + t)}
#: Each metric from the positions that agree (c) and those that differ (d); a quotient by zero as ``similarity`` has it.
_SCORE = {
    "jaccard": lambda c, d: 1 - d / (c + d),
    "dice": lambda c, d: 1 - d / (2 * c + d),
    "sokal_sneath": lambda c, d: 1 - 2 * d / (c + 2 * d),
    "kulczynski1": lambda c, d: F.when(d == 0, float("inf")).otherwise(c / d),
}
#: Jaccard similarities at which a search for the best looks before it goes down to its own threshold.
_LEVELS = (0.8, 0.6, 0.45)
#: Most tokens that a posting's key holds, and most keys of one width that a vector has.
_MOST, _KEYS = 8, 4096
#: Most tokens whose counts order them; they go to each task. Those beyond come first, in the order of their positions.
_KNOWN = 1 << 18
#: Bits of the map of the queries' keys, at most.
_MAP = 27
#: Keys that are made at once.
_AT_ONCE = 1 << 18
#: Tokens that a posting carries along, on average and at most; with more its pairs fetch them.
_CARRIED = 12
#: What a query's posting, a row's posting and a meeting of the two take, beside each other.
_OWN, _THERE, _MEETING = 10.0, 1.0, 25.0


def tokens(fp: Column | str) -> Column:
    """The non-zero positions of a count vector, with their counts, as numbers; a vector without any has one token of its own."""
    fp = F.col(fp) if isinstance(fp, str) else fp
    some = F.filter(F.transform(fp, lambda x, k: F.when(x != 0, k.cast("long") * (1 << 20) + x.cast("long"))), lambda x: x.isNotNull())
    return F.when(F.size(some) == 0, F.array(F.lit(-1).cast("long"))).otherwise(some)


def _place(token: Column) -> Column:
    return F.shiftright(token, 20)


def _tokens_of(lists: pa.Array) -> pa.Array:
    """``tokens`` of an array of whole numbers."""
    x = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    at = np.flatnonzero(x)
    row = np.searchsorted(ends, at, "right")
    some = np.bincount(row, minlength=len(ends))
    empty = some == 0
    out = np.full(len(at) + int(empty.sum()), -1, np.int64)
    out[np.arange(len(at)) + np.cumsum(empty)[row]] = (at - np.r_[0, ends][row]) * (1 << 20) + x[at]
    sizes = np.r_[0, np.cumsum(some + empty)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(out), type=pa.list_(pa.field("element", pa.int64())))


def _token_rows(df: DataFrame, key: str, fp: str, block: list[str]) -> DataFrame:
    rows = df.where(F.col(fp).isNotNull())
    for c in block:
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.select(key, *block, F.col(fp).alias("tokens"))
    kind = rows.schema["tokens"].dataType
    if not isinstance(kind.elementType, T.IntegralType):
        return written(rows.withColumn("tokens", tokens("tokens")), "token-rows")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _tokens_of(batch.columns[-1])], names=batch.schema.names)

    return written(rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("tokens", T.ArrayType(T.LongType()))])), "token-rows")


def _alike(a: DataFrame, b: DataFrame, block: list[str]) -> DataFrame:
    """Rows of equal block columns and tokens; the hash comes first, so that sorts seldom compare arrays."""
    hashed = lambda df: df.withColumn("_h", F.xxhash64(*block, "tokens"))
    return hashed(a).join(hashed(b), ["_h", *block, "tokens"])


def _classes(rows: DataFrame, key: str, block: list[str]) -> DataFrame:
    """(cls, n, tokens, block columns) of rows (key, tokens, block columns): equal ones are a class, named by its least key."""
    return written(rows.groupBy(*block, "tokens").agg(F.min(key).alias("cls"), F.count(F.lit(1)).alias("n")), "token-classes")


@dataclass(frozen=True)
class FingerprintIndex:
    """``rows``: (db_id, block columns, tokens); ``classes``: (cls, n, block columns, tokens); ``counts``: classes of each token; ``least``: the lowest threshold served."""

    rows: DataFrame
    classes: DataFrame
    counts: DataFrame
    least: float
    metric: str
    block: tuple[str, ...]


def build(db: DataFrame, least: float, metric: str = "jaccard", block: list[str] | None = None) -> FingerprintIndex:
    """Index (db_id, fp, block columns) for thresholds of ``least`` and above; ids must be distinct. Written once, used by many searches.

    ``fp``: arrays of counts. ``metric``: one of ``JACCARD_OF``. Searches stay within equal ``block`` columns, a scaffold or a tag. Rows of equal
    vectors and block columns are one class.
    """
    if metric not in JACCARD_OF or not 0 < least <= 1:
        raise ValueError("a threshold above 0, up to 1, of jaccard, dice, sokal_sneath or kulczynski1")
    block = block or []
    rows = _token_rows(db, "db_id", "fp", block)
    classes = _classes(rows, "db_id", block)
    counts = written(classes.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("of")), "token-counts")
    return FingerprintIndex(rows, classes, counts, least, metric, tuple(block))


def _sizes(classes: DataFrame) -> dict[int, int]:
    """How many classes have each number of tokens; vectors are no longer than their positions, so these are few."""
    return {r["m"]: r["n"] for r in classes.groupBy(F.size("tokens").alias("m")).agg(F.count(F.lit(1)).alias("n")).collect()}


@dataclass(frozen=True)
class _Tokens:
    """What a search knows of all tokens: ``known`` ones in order, their ranks from the rarest, the number of tokens ``alike`` frequent ones would be, and
    whether each position has one token only (``plain``, as sets have)."""

    known: np.ndarray
    rank: np.ndarray
    alike: float
    plain: bool

    def ranks(self, token: np.ndarray) -> np.ndarray:
        """One order of all tokens, together with their positions."""
        if not len(self.known):
            return np.full(len(token), -1, np.int32)
        at = np.minimum(np.searchsorted(self.known, token), len(self.known) - 1)
        return np.where(self.known[at] == token, self.rank[at], np.int32(-1))

    def shared(self, n: int, m: int, t: float) -> int:
        """Tokens that sets of n and m must share to reach ``t``. Where positions have several tokens, those that differ may still be at one position."""
        return max(1, math.ceil((t * (n + m) / (1 + t) if self.plain else t * max(n, m)) - _SLACK))


def _tokens_known(index: FingerprintIndex, asked: DataFrame) -> _Tokens:
    total, squares = index.counts.agg(F.sum(F.col("of").cast("double")), F.sum(F.col("of").cast("double") * F.col("of"))).first()
    first = index.counts.orderBy(F.desc("of"), F.desc("token")).limit(_KNOWN).toArrow()  # a bounded number
    token = first["token"].to_numpy().astype(np.int64)
    order = np.argsort(token)
    all_ = index.counts.select("token").union(asked.select(F.explode("tokens"))).distinct()
    several = all_.groupBy(_place(F.col("token"))).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _Tokens(token[order], np.arange(len(token), 0, -1, dtype=np.int32)[order], max(1.0, (total or 0.0) ** 2 / (squares or 1.0)), several.isEmpty())


def _band(size: int) -> int:
    """Sizes of one band have keys in common: each small size alone, larger ones within some 15 %."""
    return size if size <= 16 else 16 + math.ceil(math.log(size / 16) / math.log(1.15))


#: (band of the row's size, width, leading tokens) of the keys that a vector has, by its size.
_Plan = dict[int, list[tuple[int, int, int]]]


def _plans(own: dict[int, int], there: dict[int, int], t: float, known: _Tokens, width: int | None = None) -> tuple[_Plan, _Plan]:
    """The keys of queries and of rows, from the numbers of both by size.

    Of each band of the rows' sizes that width is taken that makes postings and their meetings least, were tokens as many as alike frequent ones
    would be. Results don't depend on it. ``width``: take this one, or as many tokens as must be shared if these are fewer.
    """
    bands: dict[int, list[int]] = {}
    for m in sorted(there):
        bands.setdefault(_band(m), []).append(m)
    keys: _Plan = {}
    held: _Plan = {}
    for band, sizes in bands.items():
        meet = {n: [(m, o) for m in sizes if (o := known.shared(n, m, t)) <= min(n, m)] for n in own}
        meet = {n: some for n, some in meet.items() if some}
        if not meet:
            continue
        least = {n: min(o for _, o in some) for n, some in meet.items()}
        best = None
        for w in [width] if width else range(1, min(_MOST, max(least.values())) + 1):
            cost, mine, lead, wide = 0.0, {}, {}, False
            for n, some in meet.items():
                k = min(w, least[n])
                mine[n] = (band, k, n - least[n] + k)
                ways, pairs = math.comb(n - least[n] + k, k), max(1.0, math.comb(math.ceil(known.alike), k))
                wide |= k > 1 and ways > _KEYS
                cost += _OWN * own[n] * ways
                for m, o in some:
                    lead[m, k] = max(lead.get((m, k), 0), m - o + k)
                    cost += _MEETING * own[n] * ways * there[m] * math.comb(m - o + k, k) / pairs
            for (m, k), p in lead.items():
                wide |= k > 1 and math.comb(p, k) > _KEYS
                cost += _THERE * there[m] * math.comb(p, k)
            if best is None or cost < best[0] and not wide:
                best = cost, mine, lead
        for n, key in best[1].items():
            keys.setdefault(n, []).append(key)
        for (m, k), p in best[2].items():
            held.setdefault(m, []).append((band, k, p))
    return keys, held


def _postings(classes: DataFrame, plan: _Plan, known: _Tokens, block: list[str], carry: bool, keep: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``classes`` (with block columns, and their tokens if they ``carry`` them) with a row for each set of tokens that ``plan`` looks up: ``key``, a hash of band, block columns and set, ``size``, and ``room``,
    the set's tokens and those after its last one, from the rarest on. ``keep``: places of the keys that count."""
    known_ = classes.sparkSession.sparkContext.broadcast(known)
    rows = classes.withColumn("_b", F.xxhash64(*block) if block else F.lit(0).cast("long"))
    kept = [f for f in classes.schema.fields if carry or f.name != "tokens"]
    names = [f.name for f in kept]
    combos: dict[tuple[int, int], np.ndarray] = {}

    def keys_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """(key, size, room, row) by pieces of bounded size."""
        lists = batch.column("tokens")
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
        begin = np.cumsum(sizes) - sizes
        rank, hashed, b = known_.value.ranks(flat), mix(flat.view(np.uint64) + np.uint64(1)), batch.column("_b").to_numpy().view(np.uint64)
        for size in np.unique(sizes).tolist():
            every = np.flatnonzero(sizes == size) if size in plan else ()
            for band, width, lead in plan[size] if len(every) else ():
                if (lead, width) not in combos:
                    combos[lead, width] = np.array([*itertools.combinations(range(lead), width)], np.int32)
                sets = combos[lead, width]
                salt, step = mix(np.array([band * 16 + width], np.uint64)), max(1, _AT_ONCE // len(sets))
                for a in range(0, len(every), step):
                    some = every[a : a + step]
                    places = begin[some, None] + np.arange(size)
                    order = np.argsort(rank[places], axis=1, kind="stable")[:, :lead]  # of those not known, by position
                    own = hashed[np.take_along_axis(places, order, axis=1)]
                    key = own[:, sets[:, 0]]
                    for k in range(1, width):
                        key += own[:, sets[:, k]]
                    key = mix(key ^ (b[some, None] + salt)).ravel()
                    taken = np.arange(len(key)) if keep is None else keep(key)
                    yield key[taken].view(np.int64), np.full(len(taken), size, np.int32), np.int32(size + width - 1) - sets[taken % len(sets), -1], some[taken // len(sets)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            for part in itertools.chain(keys_of(batch) if batch.num_rows else (), [None]):
                if part is not None:
                    parts.append(part)
                if parts and (part is None or sum(len(x[0]) for x in parts) >= _AT_ONCE):
                    key, size, room, row = (np.concatenate(x) for x in zip(*parts, strict=True))
                    parts = []
                    taken = batch.select(names).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*taken.columns, *map(pa.array, (key, size, room))], names=[*names, "key", "size", "room"])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("key", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("room", T.IntegerType())]))


def _met(index: FingerprintIndex, asked: DataFrame, sizes: tuple[dict[int, int], dict[int, int]], t: float, known: _Tokens, width: int | None = None) -> DataFrame | None:
    """(query_cls, _q, cls, n, _t: the tokens of both), perhaps more than once, of those that can reach the Jaccard similarity ``t``.

    Two vectors alike at t share o tokens at least, by their sizes (``shared``). In one order of all tokens, rare first, the first w that they
    share are then among the leading n - o + w of both, and leave room for the others. So sets of w tokens are looked up, w being o at most.
    A bit map of the queries' keys, of bounded size, tells tasks which of the rows' keys can meet any.
    """
    keys, held = _plans(*sizes, t, known, width)
    if not keys:
        return None
    block, spark = list(index.block), asked.sparkSession
    posted = lambda of, plan, each=lambda m: 1: sum(each(m) * of[m] * math.comb(p, w) for m, all_ in plan.items() for _, w, p in all_)
    carry = posted(sizes[1], held, lambda m: m) <= _CARRIED * posted(sizes[1], held)
    own = written(_postings(asked.select(F.col("cls").alias("query_cls"), *block, "tokens"), keys, known, block, carry), "query-keys")
    n = posted(sizes[0], keys)
    bits = min(_MAP, max(16, math.ceil(math.log2(8 * n))))
    seen = spark.sparkContext.broadcast(bit_map(own.select(F.shiftrightunsigned("key", 64 - bits).alias("slot")), bits))
    there = _postings(index.classes, held, known, block, carry, lambda key: on_map(seen.value, (key >> np.uint64(64 - bits)).astype(np.int64)))
    # a merge, since nothing tells beforehand how many keys there are
    met = own.withColumnsRenamed({"tokens": "_q", "room": "_room", "size": "_size"}).join(there.withColumnRenamed("tokens", "_t").hint("merge"), ["key", *block])
    shared = F.ceil((t / (1 + t) * (F.col("_size") + F.col("size")) if known.plain else t * F.greatest("_size", "size")) - 2 * _SLACK)
    met = met.where(F.least("_room", "room") >= shared)
    if carry:
        return met.select("query_cls", "_q", "cls", "n", "_t")
    pairs = met.select("query_cls", "cls").distinct()
    return pairs.join(index.classes.select("cls", "n", F.col("tokens").alias("_t")), "cls").join(asked.select(F.col("cls").alias("query_cls"), F.col("tokens").alias("_q")), "query_cls")


def _asked(index: FingerprintIndex, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, query_cls) and the classes of the queries."""
    block = list(index.block)
    rows = _token_rows(queries, "query_id", "query_fp", block)
    classes = _classes(rows, "query_id", block)
    return written(_alike(rows, classes, block).select("query_id", F.col("cls").alias("query_cls")), "class-rows"), classes


def _served(index: FingerprintIndex, least: float) -> float:
    if least < index.least:
        raise ValueError(f"the index serves thresholds of {index.least} and above")
    return JACCARD_OF[index.metric](least)


def candidates(index: FingerprintIndex, queries: DataFrame, least: float, width: int | None = None) -> DataFrame:
    """Distinct (query_id, db_id) that can reach ``least``; ``width``: most tokens of a key, by default those that take least work."""
    t = _served(index, least)
    rows, classes = _asked(index, queries)
    met = _met(index, classes, (_sizes(classes), _sizes(index.classes)), t, _tokens_known(index, classes), width)
    if met is None:
        return rows.select("query_id").crossJoin(index.rows.select("db_id")).where("false")
    there = _alike(index.rows, index.classes, list(index.block)).select("db_id", "cls")
    return met.select("query_cls", "cls").distinct().join(rows, "query_cls").join(there, "cls").select("query_id", "db_id")


def _first_rows(index: FingerprintIndex, best: DataFrame, k: int) -> DataFrame:
    """(cls, db_id): the first k rows of the classes (cls, n) of ``best``; one that is alone in its class gave it its name."""
    block = list(index.block)
    found = written(best.select("cls", "n").distinct(), "found-classes")
    several = index.classes.join(found.where("n > 1").select("cls"), "cls", "left_semi").select("cls", *block, "tokens")
    rows = ranking.top(_alike(index.rows, several, block).select("cls", "db_id"), ["cls"], [F.col("db_id")], k, "_r").drop("_r")
    return rows.union(found.where("n = 1").select("cls", F.col("cls").alias("db_id")))


def search(index: FingerprintIndex, queries: DataFrame, k: int, least: float, strict: bool = True, itself: bool = False) -> DataFrame:
    """(query_id, db_id, score, rank): the k rows most similar to each query (query_id, query_fp, block columns), above ``least`` (or at it).

    Equal to a scan with ``similarity``; ties by id. A row is not its own neighbour unless ``itself``. Equal queries are looked up once. The search goes
    down from equal vectors in levels of similarity: a query that has found k + 1 rows at a level has its best among them, and only the
    others go on to the next, so a table that holds many alike rows is not met at the lowest threshold.
    """
    t, block = _served(index, least), list(index.block)
    rows, open_ = _asked(index, queries)
    there = known = None
    found = []
    for level in (1.0, *[x for x in _LEVELS if x > t], t):
        if level == 1.0 and t < 1.0:
            met = _alike(open_.select(F.col("cls").alias("query_cls"), *block, "tokens"), index.classes, block)
            scored = met.select("query_cls", "cls", "n", F.lit(1.0).alias("_c"), F.lit(0.0).alias("_d"))
        else:
            if known is None:
                there, known = _sizes(index.classes), _tokens_known(index, open_)
            both = _met(index, open_, (_sizes(open_), there), level, known)
            if both is None:
                continue
            agree = F.size(F.array_intersect("_q", "_t"))
            place = lambda c: F.transform(c, _place)
            shared = agree if known.plain else F.size(F.array_intersect(place("_q"), place("_t")))
            union = F.size("_q") + F.size("_t") - shared
            scored = both.select("query_cls", "cls", "n", agree.cast("double").alias("_c"), (union - agree).cast("double").alias("_d"))
        c, d = F.col("_c"), F.col("_d")
        good = scored.where(c >= level * (c + d) - _SLACK).withColumn("score", _SCORE[index.metric](c, d)).select("query_cls", "cls", "n", "score")
        good = good.repartition("query_cls").dropDuplicates(["query_cls", "cls"])
        # of the first k + 1 rows, each one's class is among the first k + 1 by its least row
        best = written(ranking.top(good, ["query_cls"], [F.desc("score"), F.col("cls")], k + 1, "_r").drop("_r"), "best-classes")
        if level == t:
            found.append(best)
            break
        full = written(best.groupBy("query_cls").agg(F.sum("n").alias("_n")).where(F.col("_n") > k).select("query_cls"), "full-classes")
        found.append(best.join(full, "query_cls", "left_semi"))
        open_ = written(open_.join(full.withColumnRenamed("query_cls", "cls"), "cls", "left_anti"), "open-queries")
        if open_.isEmpty():
            break
    if not found:
        return rows.select("query_id").crossJoin(index.rows.select("db_id")).where("false").select("query_id", "db_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    best = written(best.where(F.col("score") > least if strict else F.col("score") >= least), "best-classes")
    first = _first_rows(index, best, k + 1)
    listed = ranking.top(best.join(first, "cls").select("query_cls", "db_id", "score"), ["query_cls"], [F.desc("score"), F.col("db_id")], k + 1, "_r")
    pairs = rows.join(listed, "query_cls").select("query_id", "db_id", "score")
    if not itself:
        pairs = pairs.where(F.col("query_id") != F.col("db_id"))
    return ranking.top(pairs, ["query_id"], [F.desc("score"), F.col("db_id")], k)
