"""Exact cosine search: query vectors against every row, in the tasks that read the rows."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquery.session import shared_root

#: Query vectors of a block; larger query sets are searched block after block.
BLOCK_QUERIES = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    ok = np.isfinite(norm) & (norm > 0)
    return np.where(ok, x / np.where(ok, norm, 1), 0.0)


def _query_blocks(paths: list[str]):
    """Ids and unit vectors of the stored queries, some at a time."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    for uri in paths:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=BLOCK_QUERIES):
                yield batch.column(0).to_numpy(), _unit(_matrix(batch.column(1)))


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, exclude_self: bool = True, digits: int = 9) -> DataFrame:
    """query_id, vec_id, score and rank of the k nearest rows of each query (query_id, embedding).

    Zero and non-finite vectors score 0; null vectors are left out; other dimensions than the queries' are an error.
    Ties go to the smaller id. Rows stay where they are: each task reads the queries from the shared folder, block by
    block, and returns its k best of each.
    """
    spark = vectors.sparkSession
    folder = f"{shared_root(spark)}/docquery-queries/{uuid.uuid4().hex}"
    queries.filter(F.col("embedding").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "embedding").write.parquet(folder)
    paths = spark.read.parquet(folder).inputFiles()

    def search(batches):
        held = [(batch.column(0).to_numpy(), _unit(_matrix(batch.column(1)))) for batch in batches if batch.num_rows]
        for ids, q in _query_blocks(paths) if held else ():
            best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for vec, x in held:
                score = np.round(q @ x.T, digits)
                if exclude_self:
                    score[ids[:, None] == vec[None, :]] = -np.inf
                n = min(k, len(vec))
                least = np.partition(score, len(vec) - n, axis=1)[:, len(vec) - n]  # ties with the k-th stay for now
                who, what = np.nonzero((score >= least[:, None]) & np.isfinite(score))
                best.append((who, vec[what], score[who, what]))
            who, vec, score = (np.concatenate(c) for c in zip(*best, strict=True))
            order = np.lexsort((vec, -score, who))
            who, vec, score = who[order], vec[order], score[order]
            keep = np.arange(len(who)) - np.searchsorted(who, who) < k
            yield pa.RecordBatch.from_arrays([pa.array(ids[who[keep]]), pa.array(vec[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])

    rows = vectors.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    found = rows.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def embed_missing(texts: DataFrame, known: DataFrame, embed, dim: int) -> DataFrame:
    """chunk_hash and vector of every distinct text: known ones as they are, the others by embed (a list of texts to a list of vectors).

    A vector of another length than dim is an error before anything is returned for its batch.
    """
    distinct = texts.select(F.sha2("text", 256).alias("chunk_hash"), "text").dropDuplicates(["chunk_hash"])
    missing = distinct.join(known.select("chunk_hash"), "chunk_hash", "left_anti")

    def run(batches):
        for batch in batches:
            new = embed(batch.column(1).to_pylist())
            if len(new) != batch.num_rows or any(len(v) != dim for v in new):
                raise ValueError("an embedding has the wrong length")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.list_(pa.float32()))], names=["chunk_hash", "vector"])

    made = missing.mapInArrow(run, "chunk_hash string, vector array<float>")
    return known.select("chunk_hash", "vector").join(distinct.select("chunk_hash"), "chunk_hash", "left_semi").unionByName(made)


def embed_all(texts: DataFrame, known: DataFrame, embed, dim: int) -> DataFrame:
    """doc_id and vector of every text: each distinct one is embedded once, and its vector goes to all that share it."""
    found = embed_missing(texts, known, embed, dim)
    return texts.select("doc_id", F.sha2("text", 256).alias("chunk_hash")).join(found, "chunk_hash").select("doc_id", "vector")
