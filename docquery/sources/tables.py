"""Tables of the engine over the given Parquet files: documents as files, conversations as chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: rel_path, project (source), tags (lang and source), size in bytes, content hash."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select(
        "doc_id", path.alias("rel_path"), F.col("source").alias("project"), F.array("lang", "source").alias("tags"),
        F.octet_length("text").alias("size"), F.sha2("text", 256).alias("content_hash"), "text", "lang", "source",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as chunks: a conversation is a document, a turn one of its chunks."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.col("role").alias("heading_path"), "text")


def chunk_id(doc: str = "doc_id", seq: str = "seq"):
    """Document and sequence number in one long."""
    return F.shiftleft(F.col(doc).cast("long"), 32) + F.col(seq)
