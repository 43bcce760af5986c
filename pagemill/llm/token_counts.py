"""Token counts with a digest cache (operator 9).

Each text is normalised (null: empty; runs of ASCII white space: one space, none at the ends, which this kind of
tokenizer ignores) and named by SHA-256. A cache table maps (content digest, tokenizer digest) to a count. Only digests
that the cache lacks are encoded, once each, and are appended to it.

Cases: null and empty texts have 0 tokens; repeated rows and copies are looked up alike, each row returns one row; a
null ``doc_id`` is carried; an empty table returns no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.wordtokens import chunk_table, read_tokenizer
from pagemill.session import materialise, ship_code

CACHE_SCHEMA = "content_digest binary, n_tokens long, tokenizer_digest string"


def normalised(text):
    """Text without the white space that the tokenizer ignores."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))


def read_cache(spark, path: str) -> DataFrame:
    """The cache at ``path``, one row for each pair of digests; empty if nothing was stored yet."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], CACHE_SCHEMA)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    return stored.groupBy("content_digest", "tokenizer_digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs`` (doc_id, text); appends to the cache."""
    spark = docs.sparkSession
    ship_code(spark)
    version, tokenizer_json = read_tokenizer(tokenizer_path)
    shared = spark.sparkContext.broadcast(tokenizer_json)

    digest = F.unhex(F.sha2(normalised(F.col("text")), 256))
    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), digest.alias("content_digest"))
    rows = materialise(rows, "token-digests")
    known = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version)
    wanted = rows.groupBy("content_digest").agg(F.min("doc_id").alias("doc_id"))
    misses = wanted.join(known.select("content_digest"), "content_digest", "left_anti").select(F.col("doc_id").alias("miss_id")).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(version, shared.value)
        for batch in batches:
            counts = [sum(map(len, map(table.__getitem__, (t or "").encode().split()))) // 4 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["content_digest", "n_tokens"])

    texts = docs.select("doc_id", "text").join(misses.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("miss_id")), "left_semi")
    encoded = texts.select(digest.alias("content_digest"), "text").mapInArrow(count, "content_digest binary, n_tokens long")
    encoded = encoded.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    encoded.withColumn("tokenizer_digest", F.lit(version)).write.mode("append").option("compression", "zstd").parquet(cache_path)

    known = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")
    return rows.join(known, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
