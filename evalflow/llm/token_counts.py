"""Token counts through a digest cache.

A text is known by the digest of its content, a tokenizer by the digest of its file. The cache is a Parquet
table of (tokenizer, digest, n_tokens) that only grows. Documents are reduced to distinct digests (combined
before the shuffle, so a large group of copies costs one row per task), those in the cache are left out by an
anti join, the rest is encoded and appended, and the counts are joined back to the documents.

Normalising must not change a count, so the content is the text itself with NULL as the empty text.

Defined results: every row of the input comes back once, rows with equal texts with equal counts. A NULL id
stays NULL. An empty table gives an empty result. Two runs that append the same digest at the same time leave
two equal entries, which are read as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalflow.llm.common import fresh, table
from evalflow.llm.pieces import token_counter
from evalflow.staging import stage_path

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024

_CACHE = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def cached_counts(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    try:
        known = spark.read.schema(_CACHE).parquet(cache)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], _CACHE)
    return known.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str, text: str = "text") -> DataFrame:
    """All columns but the text, with `n_bytes` and `n_tokens`."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(content, 256))
    wanted = docs.select(digest.alias("digest"), content.alias("content")).dropDuplicates(["digest"])
    misses = wanted.join(cached_counts(spark, cache, version), "digest", "left_anti")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(tokenizer_path)
        for batch in batches:
            yield pd.DataFrame(
                {"tokenizer": version, "digest": batch["digest"], "n_tokens": [count(t) for t in batch["content"]]}
            )

    misses.mapInPandas(encode, _CACHE).write.mode("append").parquet(cache)
    own, known = fresh(docs, "digest"), fresh(docs, "known")
    rows = docs.drop("n_bytes", "n_tokens").withColumns({own: digest, "n_bytes": F.octet_length(content).cast("bigint")})
    counts = cached_counts(spark, cache, version).withColumnRenamed("digest", known)
    return rows.drop(text).join(counts, F.col(own) == F.col(known)).drop(own, known)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts of all documents by a cache of this run, which starts empty."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path(TOKENIZER), stage_path(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
