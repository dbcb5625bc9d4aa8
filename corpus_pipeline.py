"""From raw documents to balanced shards: five stages, each an operator of querytrail.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querytrail.llm.decontamination import find_leaks
from querytrail.llm.jaccard import jaccard_join
from querytrail.llm.language import UNDETERMINED, identify_languages
from querytrail.llm.mixing import mix
from querytrail.llm.sharding import prefix_sum_shards, text_bytes
from querytrail.llm.tables import col, read
from querytrail.session import stored

LEAST_SCORE = 0.5  # share of the best language below which a text is of no language
ID, DIGEST = "__id", "__digest"


def _fingerprint(text: str = "text"):
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _decided(docs: DataFrame, decisions: DataFrame, how: str) -> DataFrame:
    """Documents joined to decisions by doc_id (NULL equals NULL) and text digest."""
    marked = docs.withColumn(DIGEST, _fingerprint())
    keys = decisions.select(F.col("doc_id").alias(ID), F.col("digest").alias("__d")).distinct()
    on = F.col("doc_id").eqNullSafe(F.col(ID)) & (F.col(DIGEST) == F.col("__d"))
    return marked.join(keys, on, how)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or of no clear language (operator 3).

    The prediction rides along with the rows, so nothing is joined or shuffled.
    """
    carried = identify_languages(docs, keep=docs.columns)
    return carried.where((F.col("__lang_pred") != UNDETERMINED) & (
        F.col("__score") >= LEAST_SCORE)).select(*[col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least doc_id of each near-duplicate group (operator 6).

    Only what goes is joined, and rows equal in doc_id and text are reduced to one.
    """
    joined = stored(jaccard_join(docs))
    kept = _decided(docs, joined.where(~F.col("first")), "left_anti")
    again = stored(joined.where("first").groupBy("doc_id", "digest").count().where("count > 1"))
    if again.isEmpty():
        return kept.select(*[col(c) for c in docs.columns])
    # Rows equal in key and text are the same document; one of each is taken.
    single = _decided(kept, again, "left_anti")
    repeated = _decided(kept, again, "left_semi").dropDuplicates(["doc_id", DIGEST])
    return single.union(repeated).select(*[col(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage (operator 1)."""
    leaks = stored(find_leaks(docs, read(spark, sf_dir, "benchmark")))
    return _decided(docs, leaks, "left_anti").select(*[col(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents by probabilities raked to source, language and topic (operator 4)."""
    drawn = mix(docs, keep=docs.columns)
    return drawn.where("kept").select(*[col(c) for c in docs.columns])


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot, contiguous by doc_id and of near equal bytes (operator 5)."""
    return prefix_sum_shards(docs, text_bytes(F.col("text")), ["doc_id", "n_chars"])


STAGES = [("language", language), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

# Fitted models, hashes and MinHash are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
