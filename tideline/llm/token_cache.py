"""Token counts with a digest cache.

A cache is a Parquet table (tokenizer, digest, n_tokens). ``digest`` is the SHA-256 of the
normalised content; ``tokenizer`` is a digest of the vocabulary file, the library's version and the
options, so that another tokenizer never meets old counts. Only digests and counts meet in joins;
the texts move once, to bring one row of each missing content to the encoder.

Counts must be exact, so the default normalisation changes nothing but null, which counts as an
empty text; another one can be given where counts of the normalised text are wanted.

Defined results: rows that repeat a text or an id each get the count; an empty text has no tokens;
texts of any length are encoded whole; an empty table gives an empty result and an unchanged cache.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SCHEMA = "tokenizer string, digest string, n_tokens bigint"
#: Characters that go to the tokenizer in one call (a longer text goes alone); bounds a task's memory.
CALL_CHARS = 400_000


def identity(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def tokenizer_digest(path: str) -> str:
    """Stands for the vocabulary, the library with its version, and the options of ``counter``."""
    import sentencepiece
    import tokenizers

    library = f"tokenizers {tokenizers.__version__}" if path.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"\n{library} plain".encode()).hexdigest()


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of whole texts, without begin, end or added special tokens, truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in s.encode(texts, num_threads=1)]


def encode(misses: DataFrame, path: str) -> DataFrame:
    """(digest, content) -> (digest, n_tokens)."""

    def run(batches):
        count = counter(path)
        for b in batches:
            digests, texts = b.column(0), b.column(1)
            sizes = pa.compute.utf8_length(texts).to_pylist()
            out, start, held = [], 0, 0
            for i, n in enumerate(sizes):
                if held and held + n > CALL_CHARS:
                    out += count(texts[start:i].to_pylist())
                    start, held = i, 0
                held += n
            out += count(texts[start:].to_pylist())
            yield pa.RecordBatch.from_arrays([digests, pa.array(out, pa.int64())], names=["digest", "n_tokens"])

    return misses.select("digest", "content").mapInArrow(run, "digest string, n_tokens bigint")


def read_cache(spark, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer; empty where no cache has been written yet.

    Runs that append at the same time can store a digest twice, with the same count.
    """
    try:
        rows = spark.read.schema(SCHEMA).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], SCHEMA)
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def misses(docs: DataFrame, cached: DataFrame, normalise=identity) -> DataFrame:
    """One (digest, content) for each content that ``cached`` lacks.

    A leader, the smallest doc_id, stands for equal contents; the digests choose it before any text
    moves. Rows that repeat a leader's id and text meet again when the counts are stored.
    """
    rows = docs.select("doc_id", normalise(F.col("text")).alias("content")).withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))
    leaders = rows.groupBy("digest").agg(F.min("doc_id").alias("leader")).join(cached.select("digest"), "digest", "left_anti")
    lead = leaders.select(F.col("digest").alias("__digest"), "leader").hint("shuffle_hash")
    return rows.join(lead, (F.col("digest") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("leader")), "left_semi").select("digest", "content")


def count_tokens(docs: DataFrame, path: str, cache: str, normalise=identity) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs``, which needs doc_id and text.

    Stores the counts of contents that ``cache`` lacks, then looks all rows up in it.
    """
    spark, key = docs.sparkSession, tokenizer_digest(path)
    fresh = encode(misses(docs, read_cache(spark, cache, key), normalise), path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.select(F.lit(key).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    rows = docs.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"),
        F.sha2(normalise(F.col("text")).cast("binary"), 256).alias("digest"),
    )
    return rows.join(read_cache(spark, cache, key), "digest", "left").select("doc_id", "n_bytes", "n_tokens")
