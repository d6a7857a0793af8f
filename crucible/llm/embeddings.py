"""Embedding near-duplicates: randomised-rotation binary codes with correction factors; their bounds decide what is computed exactly."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.llm.common import components, in_blocks, local_roots, pairs, runs, written


def rotations(dims: int, number: int, seed: int = 5) -> np.ndarray:
    """Orthogonal matrices, uniform over rotations: QR of Gaussian ones with the signs made unique."""
    rng = np.random.default_rng([seed, dims])
    out = []
    for _ in range(number):
        q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
        out.append(q * np.sign(np.diag(r)))
    return np.array(out)


def plan(most: int, dims: int, threshold: float, miss: float = 1e-6) -> tuple[int, int]:
    """(bits in a key, tables) for labels of up to ``most`` vectors: a pair at the threshold is missed with probability ``miss`` at most.

    A bit of two codes differs with probability angle / pi. Keys of log2(most) + 3 bits hold few strangers; tables make up for what they part.
    """
    same = 1 - math.acos(threshold) / math.pi
    bits = max(4, min(48, math.ceil(math.log2(max(2, most))) + 3))
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same**bits)))


#: Bit planes of a quantised vector, the other side of an estimate.
PLANES = 6
CODED = "cid long, label long, keys array<long>, packed binary, factor double, low double, step double, total double"


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    n, d = bits.shape
    wide = np.zeros((n, -(-d // 64) * 64), dtype=np.uint8)
    wide[:, :d] = bits
    return np.packbits(wide, axis=1).view(np.uint64).reshape(n, -1)


@dataclass
class Codes:
    """Codes of rotated vectors: a sign bit for each coordinate, the factor that corrects for it, and the vector in ``PLANES`` bit planes.

    With c the code as a unit vector, f = <c, x>: <c, y> / f is an unbiased estimate of <x, y>, off by more than sqrt(1 / f^2 - 1) ``sure`` /
    sqrt(dims - 1) with vanishing probability. y itself is in planes: values low + step q, whose rounding adds step / sqrt(12) at random.
    """

    dims: int
    words: np.ndarray  # (n, 1 + PLANES, words): the code, then the planes
    factor: np.ndarray
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray  # sum of the rotated vector's coordinates

    @classmethod
    def of(cls, y: np.ndarray) -> Codes:
        n, d = y.shape
        low = y.min(axis=1)
        step = np.maximum((y.max(axis=1) - low) / ((1 << PLANES) - 1), 1e-300)
        q = np.rint((y - low[:, None]) / step[:, None]).astype(np.int64)
        words = np.stack([pack(y > 0), *(pack((q >> b) & 1) for b in range(PLANES))], axis=1)
        return cls(d, words, np.abs(y).sum(axis=1) / math.sqrt(d), low, step, y.sum(axis=1))

    @classmethod
    def read(cls, part: pa.Table, dims: int) -> Codes:
        words = np.frombuffer(b"".join(part.column("packed").to_pylist()), np.uint64).reshape(part.num_rows, 1 + PLANES, -1)
        return cls(dims, words, *(part.column(c).to_numpy() for c in ("factor", "low", "step", "total")))

    def arrays(self) -> list[pa.Array]:
        n = len(self.factor)
        kind = pa.binary(self.words[0].nbytes if n else 8)
        packed = pa.FixedSizeBinaryArray.from_buffers(kind, n, [None, pa.py_buffer(np.ascontiguousarray(self.words).tobytes())]).cast(pa.binary())
        return [packed, *map(pa.array, (self.factor, self.low, self.step, self.total))]

    def upper(self, i: np.ndarray, j: np.ndarray, sure: float) -> np.ndarray:
        """The upper bounds of the inner products of rows i and j, by popcounts."""
        code = self.words[i, 0]
        hits = sum((np.bitwise_count(code & self.words[j, 1 + b]).sum(axis=1, dtype=np.int64) << b for b in range(PLANES)), np.zeros(len(i), np.int64))
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        dot = (2 * (self.low[j] * ones + self.step[j] * hits) - self.total[j]) / math.sqrt(self.dims)
        slack = np.sqrt(np.maximum(1 / self.factor[i] ** 2 - 1, 0)) / math.sqrt(max(1, self.dims - 1)) + self.step[j] / (math.sqrt(12) * self.factor[i])
        return dot / self.factor[i] + sure * slack


def near_links(classes: DataFrame, dims: int, threshold: float, most: int, block: int = 2048, sure: float = 6.0) -> DataFrame:
    """Rows (node, links, root) whose links add up to each class's number of linked vectors outside it; (node, root) span the groups.

    ``classes``: (cid, label, x: array<double> of unit length, copies). Keys are stretches of the sign bits under several rotations. Where keys
    meet, packed codes alone tell which rows have a partner whose bound reaches the threshold; only these fetch their vectors, for that
    block, and there the cosines of the pairs within the bound are computed exactly. A pair that meets in several tables counts in the first.
    """
    bits, tables = plan(most, dims, threshold)
    turns = rotations(dims, -(-bits * tables // dims))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            y = np.einsum("nd,rde->nre", x, turns).reshape(len(x), -1)
            keys = ((y[:, : bits * tables] > 0).reshape(len(x), tables, bits).astype(np.int64) << np.arange(bits)).sum(axis=2)
            listed = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("label"), listed, *Codes.of(y[:, :dims]).arrays()], ["cid", "label", "keys", "packed", "factor", "low", "step", "total"])

    coded = written(classes.select("cid", "label", "x").mapInArrow(encode, CODED), "codes")
    spread = coded.select("cid", "label", F.posexplode("keys").alias("table", "key"))
    shared = written(spread.groupBy("label", "table", "key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "shared-keys")
    rows = written(spread.join(shared, ["label", "table", "key"]), "met-keys")
    code = ["packed", "factor", "low", "step", "total"]

    def candidates(part: pa.Table, codes: Codes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in pairs(part.column("_block").to_numpy(), part.column("_role").to_numpy(), part.column("_self").combine_chunks().to_numpy(zero_copy_only=False), most=1 << 17):
            maybe = codes.upper(i, j, sure) >= threshold
            yield i[maybe], j[maybe]

    def sift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, rows=20_000):
            kept = np.zeros(part.num_rows, dtype=bool)
            for i, j in candidates(part, Codes.read(part, dims)):
                kept[i] = kept[j] = True
            yield from part.select(["cid", "table", "_block", "_role", "_self"]).filter(pa.array(kept)).combine_chunks().to_batches()

    dealt = in_blocks(rows, ["label", "table", "key"], "cid", block=block, payload=(coded.select("cid", *code), "cid"))
    sifted = dealt.select("cid", "table", *code, "_block", "_role", "_self").mapInArrow(sift, "cid long, table int, _block long, _role int, _self boolean")
    sifted = written(sifted, "met-rows")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, rows=20_000):
            n = part.num_rows
            cid, copies, table = (part.column(c).to_numpy() for c in ("cid", "copies", "table"))
            x = part.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, dims)
            keys = part.column("keys").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, tables)
            links = np.zeros(n, dtype=np.int64)
            a, b = [], []
            for i, j in candidates(part, Codes.read(part, dims)):
                fresh = ~((keys[i] == keys[j]) & (np.arange(tables) < table[i][:, None])).any(axis=1)
                i, j = i[fresh], j[fresh]
                near = np.einsum("nd,nd->n", x[i], x[j]) >= threshold
                i, j = i[near], j[near]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                root = local_roots(n, i, j)
                moved = np.flatnonzero(root != np.arange(n))
                a.append(moved)
                b.append(root[moved])
            hit = np.flatnonzero(links)
            a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(cid[np.r_[hit, a]]), pa.array(np.r_[links[hit], np.zeros(len(a), np.int64)]), pa.array(cid[np.r_[hit, b]])], ["node", "links", "root"])

    whole = sifted.join(coded.select("cid", "keys", *code), "cid").join(classes.select("cid", "x", "copies"), "cid")
    return whole.repartition("_block").sortWithinPartitions("_block", "_role").select("cid", "table", "keys", *code, "x", "copies", "_block", "_role", "_self").mapInArrow(verify, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (id, n_links, component_id, kept), one for each row of ``vectors``.

    Rows with equal, non-null labels link if the cosine of their vectors, in double precision, is at least ``threshold``. n_links: other rows
    linked directly. component_id: the smallest id reachable by links, itself included. kept: the id is its component's. Vectors that are null,
    zero or of no components, or hold null or non-finite components, link with nothing; nor do vectors of different lengths. Very large and very
    small components count like others. Equal vectors are
    one class (by a 64-bit hash) and are counted, not paired; repeated rows count as often as they stand. Null ids are ignored as component ids.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    square = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x)
    most = F.array_max(F.transform("_v", F.abs))
    good = F.coalesce(F.col("label").isNotNull() & (F.size("_v") > 0) & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x)) & (most > 0) & (most < float("inf")), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("label"), v.alias("_v"))
    rows = rows.select("_id", "label", F.when(good, F.xxhash64("label", "_v")).alias("cid"), "_v", most.alias("_most"))
    # powers of two round nothing off, and keep the squares of any finite components within doubles; two steps reach the smallest ones
    half = F.pow(F.lit(2.0), -F.floor(F.log2("_most") / 2))
    rows = rows.withColumn("_half", half).withColumn("_v", F.when(F.col("cid").isNotNull(), F.transform("_v", lambda x: x * F.col("_half") * F.col("_half")))).withColumn("_square", square).drop("_most", "_half")
    marks = written(rows.select("_id", "cid"), "vectors")
    unit = F.transform("_v", lambda x: x / F.sqrt(F.col("_square")))
    classes = written(rows.where(F.col("cid").isNotNull()).groupBy("cid").agg(F.any_value(F.xxhash64("label")).alias("label"), F.any_value(unit).alias("x"), F.count(F.lit(1)).alias("copies"), F.min("_id").alias("least")), "vector-classes")
    found = None
    sizes = classes.groupBy(F.size("x").alias("dims"), "label").agg(F.count(F.lit(1)).alias("n")).groupBy("dims").agg(F.max("n").alias("n")).where("n > 1").collect()  # a row for each vector length
    for r in sorted(sizes):
        links = near_links(classes.where(F.size("x") == r["dims"]), r["dims"], threshold, r["n"], block)
        found = links if found is None else found.union(links)
    if found is None:
        found = spark.createDataFrame([], "node long, links long, root long")
    found = written(found, "vector-links")
    counts = written(found.groupBy("node").agg(F.sum("links").alias("others")), "link-counts")
    groups = components(found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    members = written(groups.join(classes.select("cid", "least"), groups.node == F.col("cid")).select("cid", "component", "least"), "vector-groups")
    least = written(members.groupBy("component").agg(F.min("least").alias("smallest")), "group-ids")
    named = members.join(least, "component").select("cid", "smallest")
    per_class = written(classes.select("cid", "copies", "least").join(counts, classes.cid == counts.node, "left").join(named, "cid", "left").select("cid", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("component_id")), "vector-components")
    out = marks.join(per_class, "cid", "left").select("_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "_id").alias("component_id"))
    return out.select(F.col("_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (
  SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a JOIN c ON vec_id = c.node
"""
