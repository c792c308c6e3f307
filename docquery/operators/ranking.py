"""Fusion, reranking and caps on ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: how much ranks count in the fusion.
RRF_K = 60


def _best(ranked: DataFrame, by: str, key: str, name: str) -> DataFrame:
    return ranked.groupBy(by, key).agg(F.min("rank").alias(name), F.max("score").alias(f"{name}_score"))


def rrf(lexical: DataFrame, dense: DataFrame, by: str = "query_id", key: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion: the sum of 1 / (k + rank) over two lists; a repeated key keeps its best rank.

    Ties: in both lists first, then the better best rank, the higher lexical score, the smaller key.
    """
    both = _best(lexical, by, key, "a").join(_best(dense, by, key, "b"), [by, key], "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    both = both.withColumn("score", F.round(part("a") + part("b"), 12))
    twice = (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")
    order = Window.partitionBy(by).orderBy(F.desc("score"), twice.desc(), F.least("a", "b"), F.col("a_score").desc_nulls_last(), key)
    return both.select(by, key, "score", F.row_number().over(order).alias("rank"))


def cap_per_document(ranked: DataFrame, n: int, by: str = "query_id", doc: str = "doc_id", keys: tuple[str, ...] = ("rank",)) -> DataFrame:
    """At most n rows of a document for each query, in order of the keys."""
    order = Window.partitionBy(by, doc).orderBy(*keys)
    return ranked.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n).drop("nth")


def rerank(ranked: DataFrame, scores: DataFrame, by: str = "query_id", key: str = "doc_id") -> DataFrame:
    """A provider's scores replace the old ones; rows without one follow in their old order. A key scored twice counts once, at its best."""
    new = scores.groupBy(by, key).agg(F.max("provider_score").alias("provider_score"))
    joined = ranked.join(new, [by, key], "left")
    order = Window.partitionBy(by).orderBy(F.col("provider_score").isNull(), F.desc("provider_score"), "rank")
    return joined.select(by, key, F.coalesce("provider_score", F.lit(0.0)).alias("score"), F.row_number().over(order).alias("rank"))


def capped_count(ranked: DataFrame, n: int, by: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Rows that a cap of n for each document leaves of each query."""
    return ranked.groupBy(by, doc).agg(F.least(F.count("*"), F.lit(n)).alias("n")).groupBy(by).agg(F.sum("n").alias("capacity"))
