"""A stored vector index: inverted lists by cells, residual codes, probing, exact rescoring, and which tier a search takes.

Cells are the centres of k-means on unit vectors, summed up by Spark in every round. A vector lies in the list of its
nearest cell with a code of what the centre leaves over: for each part of the vector the nearest word of that part's
book. A search reads the codes of the cells nearest to a query, takes the best by the decoded vectors, and scores those
exactly. How many cells are probed is measured when the index is built, so that it reaches the recall asked for.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.operators.dense import _matrix, _unit, cosine_top_k
from docquery.session import shared_root
from docquery.sources import store
from docquery.sources.store import Part

#: Cells at most; there are about as many as the square root of the rows.
MOST_CELLS = 4096
#: Rows that the centres and books are trained on for each cell, and in all at least.
TRAIN_EACH, TRAIN_LEAST = 64, 16384
ROUNDS = 10
#: Components of a part, and words of its book (one byte names a word).
PART_DIMS, WORDS = 4, 256
#: Folders that lists are dealt to.
FOLDERS = 64
#: Rows that are asked for when the number of probes is measured, and the share of their true neighbours that must be met.
ASKED, RECALL = 256, 0.95
#: Candidates that are scored exactly, for each result.
RESCORED = 16
#: Queries, and scores, that a task holds at once.
BLOCK_QUERIES, BLOCK_SCORES = 1024, 1 << 21
BROADCAST_ROWS = 200_000
# Vectors from which an index is used, and up to which; bytes of a component.
MIN_VECTORS, MAX_VECTORS, COMPONENT_BYTES = 4096, 1_000_000, 4

LISTS = "vec_id long, cell int, code binary, embedding array<float>, folder int"


def _bounded(rows: DataFrame, n: int) -> DataFrame:
    """The n rows whose ids hash lowest: the same in every run."""
    return rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n)


def _near(x: np.ndarray, centres: np.ndarray, rows: int = 4096) -> np.ndarray:
    return np.concatenate([(x[i : i + rows] @ centres.T).argmax(axis=1) for i in range(0, len(x), rows)]) if len(x) else np.zeros(0, int)


def _closest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The nearest word of each row by distance."""
    return _near(np.c_[x, np.ones(len(x))], np.c_[2 * words, -(words**2).sum(axis=1)])


def train_cells(sample: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres by k-means: each task sums its rows by cell, Spark adds the sums, and the driver holds the centres alone.

    sample (vec_id, embedding) is read once in each round. A cell without rows keeps its centre.
    """
    centres = _unit(np.array([r.embedding for r in _bounded(sample, cells).collect()], float))
    context = sample.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c = shared.value
            total = np.zeros_like(c)
            for batch in batches:
                x = _unit(_matrix(batch.column(1)))
                np.add.at(total, _near(x, c), x)
            cell, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(at), pa.array(total[cell, at])], names=["cell", "at", "total"])

        moved = np.zeros_like(centres)
        found = sample.select("vec_id", "embedding").mapInArrow(sums, "cell long, at long, total double").groupBy("cell", "at").agg(F.sum("total").alias("total")).toPandas()  # cells times dimensions
        moved[found["cell"].to_numpy(int), found["at"].to_numpy(int)] = found["total"].to_numpy(float)
        moved = np.where(np.abs(moved).sum(axis=1, keepdims=True) > 0, _unit(moved), centres)
        shared.destroy()
        if np.abs(moved - centres).max(initial=0) < 1e-6:
            break
        centres = moved
    return centres


def train_books(sample: DataFrame, centres: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """For each part of the vectors, WORDS words for what the centres leave over: k-means, one part to a task."""
    shared = sample.sparkSession.sparkContext.broadcast(centres)
    dim = centres.shape[1]
    parts = -(-dim // PART_DIMS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column(1)))
            left = np.pad(x - shared.value[_near(x, shared.value)], ((0, 0), (0, parts * PART_DIMS - dim))).reshape(len(x), parts, PART_DIMS)
            for p in range(parts):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), pa.array(left[:, p].tolist(), pa.list_(pa.float64()))], names=["part", "x"])

    def learn(key: tuple, rows: pa.Table) -> pa.Table:
        x = np.array(rows.column("x").to_pylist(), float)
        x = x[np.lexsort(x.T)]
        words = x[np.linspace(0, len(x) - 1, WORDS).astype(int)]
        for _ in range(rounds):
            near = _closest(x, words)
            n = np.bincount(near, minlength=WORDS)
            total = np.zeros_like(words)
            np.add.at(total, near, x)
            words = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], words)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([words.ravel().tolist()], pa.list_(pa.float64()))})

    learned = sample.select("vec_id", "embedding").mapInArrow(cut, "part int, x array<double>").groupBy("part").applyInArrow(learn, "part int, words array<double>").collect()
    return np.array([r.words for r in sorted(learned, key=lambda r: r.part)]).reshape(parts, WORDS, PART_DIMS)


def _decode(codes: np.ndarray, books: np.ndarray, dim: int) -> np.ndarray:
    return books[np.arange(len(books)), codes].reshape(len(codes), -1)[:, :dim]


def build(spark: SparkSession, root: str, vectors: DataFrame, k: int = 10, recall: float = RECALL, cells: int | None = None) -> int:
    """Write the index of vectors (vec_id, embedding) and publish it as the root's next generation.

    Every row with an embedding is indexed; centres and books are trained on the rows that hash lowest (TRAIN_EACH for
    each cell). Zero and non-finite vectors are listed and score 0, repeated rows are listed each, null vectors are left
    out, vectors of several lengths are an error. probes is the fewest cells in which ASKED rows find that share of
    their true k nearest.
    """
    rows = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    n, least, most = rows.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if least != most:
        raise ValueError("vectors of several lengths")
    if not n:
        parts = [*store.put(spark, root, {"lists": spark.createDataFrame([], LISTS)}), Part("cells", "", "", None, {"rows": 0})]
        return store.publish(spark, root, lambda now: store.replaced(now, parts))
    cells = min(MOST_CELLS, n, cells or max(1, round(n**0.5)))
    # the sample is bounded by the number of cells, and read in every round
    (kept,) = store.put(spark, root, {"sample": _bounded(rows, max(TRAIN_LEAST, TRAIN_EACH * cells)).repartition(8)})
    sample = store.written(spark, kept)
    centres = train_cells(sample, cells)
    books = train_books(sample, centres)
    shared = spark.sparkContext.broadcast((centres, books))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, words = shared.value
        parts = len(words)
        for batch in batches:
            x = _unit(_matrix(batch.column(1)))
            cell = _near(x, c)
            left = np.pad(x - c[cell], ((0, 0), (0, parts * PART_DIMS - x.shape[1]))).reshape(len(x), parts, PART_DIMS)
            codes = np.stack([_closest(left[:, p], words[p]) for p in range(parts)], axis=1).astype(np.uint8)
            columns = [batch.column(0), pa.array(cell.astype(np.int32)), pa.array([r.tobytes() for r in codes], pa.binary()), batch.column(1), pa.array((cell % FOLDERS).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cell", "code", "embedding", "folder"])

    # a cell with very many rows, such as copies of one vector, is some files
    lists = rows.mapInArrow(listed, LISTS).repartition("folder", F.pmod(F.xxhash64("vec_id"), F.lit(8))).sortWithinPartitions("folder", "cell", "vec_id")
    (part,) = store.put(spark, root, {"lists": lists}, {"lists": ["folder"]})
    (learned,) = store.put(spark, root, {"cells": spark.createDataFrame([("centres", i, r.tolist()) for i, r in enumerate(centres)] + [("books", i, r.ravel().tolist()) for i, r in enumerate(books)], "kind string, at int, x array<double>")})

    asked = _bounded(rows.dropDuplicates(["vec_id"]), ASKED).select(F.col("vec_id").alias("query_id"), "embedding")
    truth = cosine_top_k(rows, asked, k).select("query_id", "vec_id").join(store.written(spark, part).select("vec_id", "cell"), "vec_id").distinct().toPandas()  # ASKED times k rows
    order = {r.query_id: np.argsort(np.argsort(-(_unit(np.array([r.embedding], float)) @ centres.T)[0], kind="stable")) for r in asked.collect()}
    ranks = np.sort([order[q][c] for q, c in zip(truth["query_id"], truth["cell"], strict=True)])
    probes = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1 if len(ranks) else 1
    facts = {"rows": n, "dim": most, "probes": probes, "cells": len(centres)}
    return store.publish(spark, root, lambda now: store.replaced(now, [part, replace(learned, facts=facts)]))


class VectorIndex:
    """One generation of a stored vector index."""

    def __init__(self, spark: SparkSession, root: str, at: int | None = None):
        self.spark, self.root = spark, root
        now = store.snapshot(spark, root, at)
        self.generation = now.generation
        (cells,), (lists,) = now.of("cells"), now.of("lists")
        self.rows, self.probes = cells.facts["rows"], cells.facts.get("probes", 0)
        self.lists = store.written(spark, lists)
        if self.rows:
            learned = store.written(spark, cells).orderBy("kind", "at").collect()  # the cells and the books
            self.centres = np.array([r.x for r in learned if r.kind == "centres"])
            self.books = np.array([r.x for r in learned if r.kind == "books"]).reshape(-1, WORDS, PART_DIMS)

    def vectors(self) -> DataFrame:
        return self.lists.select("vec_id", "embedding")

    def _probed(self, queries: DataFrame, probes: int) -> str:
        """A folder with each query once for each cell that it probes, by the folders of the lists."""
        shared = self.spark.sparkContext.broadcast(self.centres)

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _unit(_matrix(batch.column(1)))
                cells = np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :probes]
                row = np.repeat(np.arange(len(x)), cells.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(cells.ravel().astype(np.int32)), pa.array((cells.ravel() % FOLDERS).astype(np.int32)), pa.array(x[row].tolist(), pa.list_(pa.float64()))], names=["query_id", "cell", "folder", "q"]
                )

        path = f"{shared_root(self.spark)}/docquery-queries/{uuid.uuid4().hex}"
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").mapInArrow(nearest, "query_id long, cell int, folder int, q array<double>")
        asked.repartition("folder").sortWithinPartitions("folder", "cell").write.partitionBy("folder").parquet(path)
        return path

    def candidates(self, queries: DataFrame, n: int, probes: int) -> DataFrame:
        """query_id, folder, cell and vec_id of the n best of each query by the decoded vectors of the cells it probes."""
        path = self._probed(queries, probes)
        shared = self.spark.sparkContext.broadcast((self.centres, self.books))

        def asking(folder: int, cells: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            """The queries that probe these cells of a folder, cell by cell, some at a time."""
            from pyarrow import dataset, fs

            system, at = fs.FileSystem.from_uri(f"{path}/folder={folder}")
            if system.get_file_info(at).type == fs.FileType.NotFound:
                return
            wanted = dataset.field("cell").isin(np.unique(cells).tolist())
            for batch in dataset.dataset(at, filesystem=system, format="parquet").to_batches(columns=["query_id", "cell", "q"], filter=wanted, batch_size=BLOCK_QUERIES):
                at_cell = batch.column(1).to_numpy()
                ids, q = batch.column(0).to_numpy(), _matrix(batch.column(2)) if batch.num_rows else None
                for cell in np.unique(at_cell):
                    yield cell, ids[at_cell == cell], q[at_cell == cell]

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, books = shared.value
            for batch in batches:
                vec, cell, folder = (batch.column(i).to_numpy() for i in (0, 1, 3))
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(vec), -1)
                for f in np.unique(folder):
                    for c, ids, q in asking(int(f), cell[folder == f]):
                        rows = np.flatnonzero((cell == c) & (folder == f))
                        x = centres[c] + _decode(codes[rows], books, centres.shape[1])
                        for low in range(0, len(q), max(1, BLOCK_SCORES // len(rows))):
                            part = slice(low, low + max(1, BLOCK_SCORES // len(rows)))
                            score = q[part] @ x.T
                            best = np.argpartition(-score, min(n, len(rows)) - 1, axis=1)[:, :n]
                            who = np.repeat(np.arange(len(score)), best.shape[1])
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(ids[part][who]), pa.array(np.full(len(who), f, np.int32)), pa.array(np.full(len(who), c, np.int32)), pa.array(vec[rows][best.ravel()]), pa.array(score[who, best.ravel()])],
                                names=["query_id", "folder", "cell", "vec_id", "near"],
                            )

        found = self.lists.select("vec_id", "cell", "code", "folder").mapInArrow(search, "query_id long, folder int, cell int, vec_id long, near double")
        order = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
        return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n).select("query_id", "folder", "cell", "vec_id").distinct()

    def top_k(self, queries: DataFrame, k: int = 10, exclude_self: bool = True, digits: int = 9, probes: int | None = None, rescored: int = RESCORED) -> DataFrame:
        """query_id, vec_id, score, rank and tier of about the k nearest rows of each query (query_id, embedding).

        Scores are exact. A query that finds fewer than k rows in the cells it probes is searched again in all rows (tier
        `exact`, else `ann`). Null query vectors are left out; ties go to the smaller id.
        """
        queries = queries.filter(F.col("embedding").isNotNull())
        if not self.rows:
            return queries.select(F.col("query_id").cast("long")).filter(F.lit(False)).selectExpr("query_id", "query_id vec_id", "0D score", "0 rank", "'exact' tier")
        found = self.candidates(queries, rescored * k + 1, probes or self.probes)
        path = f"{shared_root(self.spark)}/docquery-queries/{uuid.uuid4().hex}"
        found.write.parquet(path)
        found = self.spark.read.parquet(path)
        few = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("q"))
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
        size = lambda a: F.sqrt(dot(a, a))
        whole = lambda x: (x > 0) & (x < float("inf"))
        cosine = F.when(whole(size("q")) & whole(size("embedding")), dot("q", "embedding") / (size("q") * size("embedding"))).otherwise(0.0)
        pairs = self.lists.select("folder", "cell", "vec_id", "embedding").join(few, ["folder", "cell", "vec_id"]).join(asked, "query_id")
        if exclude_self:
            pairs = pairs.filter("vec_id != query_id")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = pairs.select("query_id", "vec_id", F.round(cosine, digits).alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        path = f"{shared_root(self.spark)}/docquery-queries/{uuid.uuid4().hex}"
        best.write.parquet(path)
        best = self.spark.read.schema(best.schema).parquet(path)
        full = best.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") == k)
        short = queries.withColumn("query_id", F.col("query_id").cast("long")).join(full, "query_id", "left_anti")
        approximate = best.join(full.select("query_id"), "query_id", "left_semi").withColumn("tier", F.lit("ann"))
        if not short.limit(1).count():
            return approximate
        return approximate.unionByName(cosine_top_k(self.vectors(), short, k, exclude_self, digits).withColumn("tier", F.lit("exact")))


def tiers(counts: DataFrame, min_vectors: int = MIN_VECTORS, max_vectors: int = MAX_VECTORS, max_bytes: int = 1 << 30) -> DataFrame:
    """counts (project, chunks, vectors, dim) with tier and degraded: how a search of each project is answered.

    Too many vectors, or too many bytes of them, are streamed (`stream`, degraded `exact_fallback`). Enough vectors, each
    chunk having one, and an index within the bytes are searched by cells (`ann`); fewer exactly (`exact`). Where chunks
    lack a vector the search is exact and degraded `partial_coverage`.
    """
    size = F.col("vectors") * F.col("dim") * COMPONENT_BYTES
    # lists hold the vectors, their codes and ids
    index_size = F.col("vectors") * (F.col("dim") * COMPONENT_BYTES + F.ceil(F.col("dim") / PART_DIMS) + 12)
    large: Column = (F.col("vectors") > max_vectors) | (size > max_bytes)
    whole = F.col("vectors") >= F.col("chunks")
    tier = F.when(large, "stream").when((F.col("vectors") >= min_vectors) & whole & (index_size <= max_bytes), "ann").otherwise("exact")
    degraded = F.when(large, "exact_fallback").when(~whole, "partial_coverage")
    return counts.withColumn("tier", tier).withColumn("degraded", degraded)
