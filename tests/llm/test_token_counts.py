import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

from evalflow.llm import token_counts as T
from evalflow.staging import stage_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_are_those_of_the_library(spark, awkward, no_documents):
    cache = stage_path(spark, "cache-test")
    got = T.token_counts(awkward, PATH, cache)
    library = tokenizers.Tokenizer.from_file(PATH)
    texts = {r["doc_id"]: r["text"] or "" for r in awkward.collect()}
    rows = got.collect()
    assert len(rows) == awkward.count() and set(got.columns) == set(awkward.columns) - {"text"} | {"n_bytes", "n_tokens"}
    for r in rows:
        text = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
    assert T.token_counts(no_documents, PATH, cache).count() == 0


def test_names_of_helpers_may_be_taken(spark):
    docs = spark.createDataFrame([(1, "some words", 7, 8, 9, 10)], "doc_id long, text string, _digest int, digest int, _known int, known int")
    row = T.token_counts(docs, PATH, stage_path(spark, "cache-test")).first()
    assert (row["_digest"], row["digest"], row["_known"], row["known"], row["n_bytes"]) == (7, 8, 9, 10, 10)


def test_only_distinct_misses_are_encoded(spark, awkward, tmp_path):
    cache = stage_path(spark, "cache-test")
    T.token_counts(awkward, PATH, cache)
    entries = spark.read.parquet(cache)
    distinct = awkward.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert entries.count() == distinct == entries.select("digest").distinct().count()
    more = awkward.unionByName(spark.createDataFrame([(500, "a new text"), (501, "a new text")], "doc_id long, text string"), allowMissingColumns=True)
    assert T.token_counts(more, PATH, cache).count() == more.count()
    assert spark.read.parquet(cache).count() == distinct + 1
    # Another tokenizer version has entries of its own; what is cached is believed.
    other = tmp_path / "other.json"
    other.write_text(open(PATH).read() + "\n")
    T.token_counts(awkward, str(other), cache)
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2
    planted = spark.read.parquet(cache).withColumn("n_tokens", F.lit(7).cast("long"))
    believed = stage_path(spark, "cache-test")
    planted.write.parquet(believed)
    assert {r["n_tokens"] for r in T.token_counts(awkward, PATH, believed).collect()} == {7}
