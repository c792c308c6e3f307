"""Indexes of the given tables, written to the shared folder once for each session and table."""

from __future__ import annotations

import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.functions import analyzer
from docquery.functions.text import simple_tokens
from docquery.operators import vectors
from docquery.operators.index import Index, delete, merge, upsert, write
from docquery.plans import search
from docquery.session import shared_root
from docquery.sources.tables import docs, table

#: Fields of a turn and what each counts: its text, and its role as the title.
TURN_BOOSTS = {"text": 1.0, "title": 2.0}


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as chunks with search fields: chunk_id, doc_id, headings, lines, text, title."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        (F.shiftleft(F.col("conv_id").cast("long"), 32) + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.array("role").alias("headings"),
        (F.col("turn") + 1).cast("int").alias("line_start"), (F.col("turn") + 1).cast("int").alias("line_end"), "text", F.col("role").alias("title"),
    )


def _version(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """What the table's files are: path, length and time of each, so that changed files are another table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((str(s.getPath()), s.getLen(), s.getModificationTime()) for s in files.listStatus(path)))


@cache
def _root(app: str, sf_dir: str, name: str, shared: str, version: tuple) -> str:
    spark = SparkSession.getActiveSession()
    root = f"{shared}/docquery-index/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
    if name == "embeddings":
        vectors.build(spark, root, table(spark, sf_dir, "embeddings"))
    elif name == "documents":
        write(spark, root, table(spark, sf_dir, "documents").select("doc_id", "text"))
    elif name == "chunks":
        _, chunks = search.build(docs(spark, sf_dir).select("doc_id", "rel_path", "text"))
        chunks.write.parquet(f"{root}/chunks", compression="zstd")
        search.write_index(spark.read.schema(chunks.schema).parquet(f"{root}/chunks"), f"{root}/index")
    else:
        rows = turns(spark, sf_dir).select(F.col("chunk_id").alias("doc_id"), "text", "title")
        tokens = analyzer.lattice if name == "analyzed turns" else simple_tokens
        write(spark, root, rows, {f: tokens(f) for f in TURN_BOOSTS})
    return root


#: Tables of the indexes that are not named as their tables are.
TABLES = {"analyzed turns": "conversations", "chunks": "documents"}


def _stored(spark: SparkSession, sf_dir: str, name: str) -> str:
    return _root(spark.sparkContext.applicationId, sf_dir, name, shared_root(spark), _version(spark, sf_dir, TABLES.get(name, name)))


def index(spark: SparkSession, sf_dir: str, name: str = "documents") -> Index:
    """The stored index of `documents` or `conversations`, or the analyzer's of `analyzed turns`; the first call of a session writes it."""
    return Index(spark, _stored(spark, sf_dir, name))


def chunk_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Index]:
    """The stored chunks of `documents` and the analyzer's index of their fields; the first call of a session writes both."""
    root = _stored(spark, sf_dir, "chunks")
    return spark.read.parquet(f"{root}/chunks"), Index(spark, f"{root}/index")


def vector_index(spark: SparkSession, sf_dir: str) -> vectors.VectorIndex:
    """The stored index of `embeddings`; the first call of a session writes it."""
    return vectors.VectorIndex(spark, _stored(spark, sf_dir, "embeddings"))


def updated(spark: SparkSession, sf_dir: str) -> Index:
    """documents as an index that was made of old texts (half as long for one source) and of others, then brought up to date.

    One source's documents come anew, another's are deleted, further ones come in parts, and the small segments are merged.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    root = f"{shared_root(spark)}/docquery-index/updated-{uuid.uuid4().hex}"
    late = F.col("source").isin("src4", "src5", "src6")
    old = F.expr("CASE WHEN source = 'src3' THEN left(text, length(text) DIV 2) ELSE text END")
    write(spark, root, docs.filter(~F.coalesce(late, F.lit(False))).select("doc_id", old.alias("text")))
    upsert(spark, root, docs.filter("source = 'src3'"))
    delete(spark, root, docs.filter("source = 'src7'"))
    for source in ("src4", "src5", "src6"):
        upsert(spark, root, docs.filter(F.col("source") == source))
    merge(spark, root)
    return Index(spark, root)
