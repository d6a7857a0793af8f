"""Token counts through a digest cache: equal contents are encoded once for each tokenizer version, later runs not at all."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.llm.common import scratch_path, written

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"
_SEGMENT = re.compile("[ ▁]*[^ ▁]+|[ ▁]+$")


class PieceCounter:
    """Counts a sentencepiece model's tokens.

    Where no piece of the model goes on past a word mark inside it, merges never cross the start of a run of spaces, so a text's count is
    the sum over its space-led segments; each distinct segment is given to the library once and remembered, at most ``most`` of them.
    Other models get whole texts.
    """

    def __init__(self, model_file: str, most: int = 400_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.most = most
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        # and spaces are kept as they are, with one put before the text
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.encode("  a  b", out_type=str) == self.model.encode("  a", out_type=str) + self.model.encode(" b", out_type=str)
        # a single space at the end is a segment without text, which the library would take for no input
        self.lone = 1 if self.model.piece_to_id("▁") != self.model.unk_id() else len("▁".encode())
        self.seen: dict[str, int] = {"": self.lone}

    def segments(self, text: str) -> list[str]:
        if text[0] != " " and text[-1] != " " and "  " not in text and "▁" not in text:
            return text.split(" ")
        return [s[1:] for s in _SEGMENT.findall(f" {text}")]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        out = []
        for text in texts:
            if not text:
                out.append(0)
                continue
            parts = self.segments(text)
            fresh = [p for p in dict.fromkeys(parts) if p not in self.seen]
            if len(self.seen) + len(fresh) > self.most:
                self.seen = {"": self.lone}
                fresh = [p for p in dict.fromkeys(parts) if p]
            self.seen.update(zip(fresh, map(len, self.model.encode(fresh, num_threads=1)), strict=True))
            out.append(sum(map(self.seen.__getitem__, parts)))
        return out


def tokenizer_digest(model_file: str) -> str:
    import sentencepiece

    with open(model_file, "rb") as f:
        return hashlib.sha256(f.read() + f"\0sentencepiece {sentencepiece.__version__}".encode()).hexdigest()


def count_tokens(docs: DataFrame, model_file: str, cache: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit), one for each row of ``docs``; over_limit: more than ``limit`` tokens.

    ``cache`` is a Parquet table of (content, tokenizer, n_tokens), by SHA-256 digests of the text and of the model file with the library's
    version. Contents that it lacks are encoded once, however many rows hold them, and appended; None starts a new one in the shared
    folder. A null text counts as empty, with 0 bytes and tokens. Repeated and null ids keep a row each.
    A text of any length is encoded whole; an empty table gives an empty result; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(model_file)
    cache = cache or scratch_path(spark, "token-cache")
    if not _exists(spark, cache):
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(cache)
    spark.sparkContext.addFile(model_file)
    name = model_file.rsplit("/", 1)[-1]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.sha2(text.cast("binary"), 256).alias("content"), text.alias("_text"))
    marks = written(rows.select("_id", "content", F.octet_length("_text").cast("long").alias("n_bytes")), "content-digests")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    once = marks.groupBy("content").agg(F.min("_id").alias("_first"))
    missing = written(once.join(stored, "content", "left_anti"), "content-misses")
    asked = missing.select(F.col("content").alias("_c"), "_first").hint("shuffle_hash")
    texts = rows.join(asked, (F.col("content") == F.col("_c")) & F.col("_id").eqNullSafe(F.col("_first")), "left_semi").select("content", "_text")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(SparkFiles.get(name))
        for batch in batches:
            counts = counter.counts(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    fresh = texts.mapInArrow(encode, "content string, n_tokens long").dropDuplicates(["content"])
    fresh.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).select("content", "n_tokens")
    return marks.join(known, "content").select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
