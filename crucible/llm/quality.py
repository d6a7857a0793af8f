"""Quality classifier: a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.llm.common import byte_slices, held_out, word_hashes, word_spans, written

FEATURES = ("words", "word_length", "length_spread", "upper", "digits", "punctuation", "symbols", "loud", "bars", "distinct", "repeats", "line_length")


def _mask(codes: str | range) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) if isinstance(c, str) else c for c in codes]] = True
    return out


_UPPER, _LETTER = _mask(range(65, 91)), _mask([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGIT, _PLAIN, _ODD = _mask("0123456789"), _mask(".,;:'\"()-?!"), _mask("#$%&*@~^_=+<>{}[]\\/`")
_LOUD, _BAR = _mask("!"), _mask("|")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each document: logarithms of shares, so that rare marks count by their ratio."""
    starts, ends, first = word_spans(data, offsets)
    n_docs = len(offsets) - 1
    n = np.diff(first).astype(float)
    size = np.diff(offsets).astype(float)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    length = (ends - starts).astype(float)
    safe_n, safe = np.maximum(n, 1), np.maximum(size, 1)

    def share(mask: np.ndarray, of: np.ndarray = safe) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(mask[data], out=sums[1:])
        return np.log((np.diff(sums[offsets]) + 0.5) / (of + 20))

    mean = np.bincount(doc, length, n_docs) / safe_n
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, n_docs) / safe_n - mean**2, 0))
    h = word_hashes(data, starts, ends)
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    repeats = np.bincount(doc, again, n_docs)
    key = np.sort((doc.astype(np.uint64) << np.uint64(42)) | (h >> np.uint64(22)))
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] >> np.uint64(42)).astype(np.int64), minlength=n_docs)
    letters = np.exp(share(_LETTER)) * (safe + 20)
    lines = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(data == 10, out=lines[1:])
    return np.column_stack([
        np.log1p(n), np.log1p(mean), np.log1p(spread), share(_UPPER, letters), share(_DIGIT), share(_PLAIN), share(_ODD), share(_LOUD), share(_BAR),
        np.log((distinct + 1) / (n + 1)) / np.log(n + 2), np.log((repeats + 0.5) / (n + 20)), np.log((n + 1) / (np.diff(lines[offsets]) + 1)),
    ])


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every whole text; a null text counts as empty."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in byte_slices(batch):
                x = features(data, offsets)
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([rows.column("_id"), values], ["_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(scan, "_id long, x array<double>")


@dataclass
class Discriminant:
    """Class means, cached inverse Cholesky factors and log determinants in standardised space."""

    prior: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    logdets: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """The posterior probability of class 1; the prior alone if one class was never seen."""
        if self.means is None:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        logs = [-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        odds = logs[1] - logs[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(features_: DataFrame, labels: DataFrame, label_col: str, shrink: float = 0.1, ridge: float = 1e-3, id_col: str = "doc_id") -> Discriminant:
    """Class moments over all labelled rows (one aggregate in Spark, d squared numbers to the driver), shrunk to the pooled covariance."""
    d = len(FEATURES)
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y"))
    x = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i in range(d) for j in range(i, d)]
    rows = {r["_y"]: r for r in features_.join(known, "_id").groupBy("_y").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    n = np.array([rows[c]["n"] if c in rows else 0 for c in (0, 1)], dtype=float)
    prior = float((n[1] + 0.5) / (n.sum() + 1))
    if (n < 2).any():
        return Discriminant(prior)
    means, covs = [], []
    for c in (0, 1):
        m = np.array([rows[c][f"s{i}"] for i in range(d)]) / n[c]
        q = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                q[i, j] = q[j, i] = rows[c][f"q{i}_{j}"] / n[c]
        means.append(m)
        covs.append(q - np.outer(m, m))
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    centre = (n[0] * means[0] + n[1] * means[1]) / n.sum()
    whole = pooled / np.outer(scale, scale)
    factors, logdets = [], []
    for c in (0, 1):
        own = covs[c] / np.outer(scale, scale)
        low = np.linalg.cholesky((1 - shrink) * own + shrink * whole + ridge * np.eye(d))
        factors.append(np.linalg.inv(low))
        logdets.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(prior, centre, scale, (np.array(means) - centre) / scale, np.array(factors), np.array(logdets))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.3, fold: int = 0, shrink: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, held_out, score, predicted), one for each row of ``docs``.

    Moments are learnt from all labelled rows outside fold ``fold`` of crc32(id) mod 5; only the text is an input. Texts that are null or
    empty get the score of an empty text. Labels other than 0 and 1, null ids and labels of absent documents teach nothing; repeated rows
    count as often as they stand. With fewer than two rows of either class the score is the smoothed share of class 1. A text of any length
    counts whole; an empty table gives an empty result; other columns are not read, whatever their names.
    """
    found = written(feature_table(docs, id_col, text_col), "quality-features").withColumn("held_out", held_out("_id", fold))
    model = fit(found.where(~F.col("held_out")), labels, label_col, shrink, id_col=id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("held_out"), pa.array(shared.value.score(x))], ["_id", "held_out", "score"])

    out = found.select("_id", "held_out", "x").mapInArrow(score, "_id long, held_out boolean, score double")
    return out.select(F.col("_id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
