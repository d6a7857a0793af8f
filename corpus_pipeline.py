"""A training corpus from raw documents: reject junk, near copies, repeated passages and leaks, then mix the sources.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of documents.
``run`` writes each stage's result to the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crucible.llm import leaks, mixing, quality, simhash, substrings
from crucible.llm.common import table, written

#: Two stages decide by a fitted model and by fingerprints that SQL lacks.
ORACLE_SQL = None


def by_id(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``decided``; ids may be null, and rows that share an id go or stay together."""
    ids = decided.select(F.col("doc_id").alias("_id")).distinct().hint("shuffle_hash")
    return docs.join(ids, docs.doc_id.eqNullSafe(ids._id), "left_semi")


def reject_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among ``docs``, predicts to be good.

    Null and empty texts are judged as empty ones. Rows that share an id stay if one of them is good. An empty table stays empty; other
    columns, whatever their names, pass unchanged, in this stage and the next.
    """
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return by_id(docs, written(scored.where("predicted = 1").select("doc_id"), "good-ids"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by Jaccard similarity of five-word shingles, 0.8 at least.

    Candidates are near SimHash fingerprints, by multi-index hashing, and what lies beyond them by rare shingles; all are verified. Texts
    without words, null ones among them, are one group. Rows that share the smallest id of a group all stay; a group without any id goes
    but for rows of its like: null ids count as equal.
    """
    groups = simhash.near_texts(docs, similarity=(4, 5), shingle=5)
    return by_id(docs, written(groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"), "kept-ids"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 20 words that also start earlier; texts without any stay as they are, null ones null.

    ``n_chars``, where there is such a column, is that of the new text where it changed. Other columns pass unchanged.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*[docs[c] for c in rest] or [F.lit(0).alias("_")]).alias("_rest"))
    kept = substrings.deduplicate(packed, keep=("_rest",))
    cut = F.col("n_removed") > 0

    def column(c: str) -> Column:
        if c in ("doc_id", "text"):
            return F.col("kept_text" if c == "text" else c).alias(c)
        own = F.col("_rest")[c]
        return (F.when(cut, F.length("kept_text")).otherwise(own).cast(docs.schema[c].dataType) if c == "n_chars" else own).alias(c)

    return kept.select(*map(column, docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items; null texts hold none. All columns pass unchanged."""
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: (doc_id, source, size, source_size, target, taken); null texts have size 0."""
    return mixing.mix(docs, mixing.quality_weights(table(spark, sf_dir, "labels")), keep=("source",))


STAGES = [
    ("quality", reject_junk),
    ("near_duplicates", one_of_each_group),
    ("repeated_passages", cut_repeats),
    ("benchmark_leaks", drop_leaks),
    ("mixture", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
