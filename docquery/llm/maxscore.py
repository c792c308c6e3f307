"""Exact top-k search by inner product with MaxScore over postings of integer weights.

A dimension is a term and its postings are the weights of a shard's vectors, laid out by term, in blocks that know their
largest and smallest weight. A term's bound for a query is the most that any of its postings can give. The terms with
the smallest bounds, as long as these sum to no more than the query's threshold, are non-essential: only the essential
terms' postings are traversed, in the blocks whose bounds can still reach the threshold, and the other terms are
probed for those vectors alone whose score so far is still competitive. A first shard gives every query a threshold
to start from; no candidate is moved, and the shards' lists are merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.llm import common, ranks

SHARD_ROWS = 8192
BLOCK_ROWS = 128
#: Queries that a task holds at once.
BLOCK_QUERIES = 2048
#: Shards that a task holds at once.
HELD_SHARDS = 8
#: Vectors with a weight of this size or more are in shards of their own, so that no other sum needs wide numbers.
WIDE = 1 << 26


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Whole-numbered rows of a list column as doubles, shorter ones filled with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _number_type(largest_query: float, largest_weight: float, width: int):
    """The smallest type whose sums of these products are exact; Python's own numbers where 64 bits may not do."""
    most = int(largest_query) * int(largest_weight) * max(1, width)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def _as(kind, x: np.ndarray) -> np.ndarray:
    return np.frompyfunc(int, 1, 1)(x) if kind is object else x.astype(kind)


class Postings:
    """A shard's weights by term. Vectors are ordered by their strongest term, so that a block's weights are alike."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        order = np.argsort(np.abs(weights).argmax(axis=1), kind="stable") if weights.size else np.arange(len(ids))
        self.ids, self.largest = ids[order], float(np.abs(weights).max(initial=0))
        self.lists = np.ascontiguousarray(weights[order].T)
        self.edges = np.arange(0, len(ids), BLOCK_ROWS)
        self.high = np.maximum.reduceat(self.lists, self.edges, axis=1)
        self.low = np.minimum.reduceat(self.lists, self.edges, axis=1)
        self._typed: dict = {}

    def typed(self, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if kind not in self._typed:
            self._typed = {kind: tuple(_as(kind, x) for x in (self.lists, self.high, self.low))}
        return self._typed[kind]


def search(postings: Postings, query_id: int, query: np.ndarray, k: int, found: tuple[np.ndarray, np.ndarray], threshold: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, vec_id) of those found and of the shard's vectors but the query's own.

    threshold: a score that the k best of all shards are known to reach, if there is one.
    """
    scores, ids = found
    if len(scores) == k:
        threshold = int(scores[-1]) if threshold is None else max(threshold, int(scores[-1]))
    kind = _number_type(float(np.abs(query).max(initial=0)), postings.largest, len(query))
    lists, high, low = postings.typed(kind)
    q = _as(kind, query)
    by_block = np.maximum(q[:, None] * high, q[:, None] * low)
    bound = by_block.max(axis=1)
    if threshold is None:
        essential, probed, left = np.arange(len(q)), np.zeros(0, np.int64), 0
        live = np.arange(len(postings.ids))
    else:
        order = np.argsort(bound, kind="stable")
        sums = np.cumsum(np.maximum(bound[order], 0))
        n = int(np.searchsorted(sums, threshold, side="right")) if threshold > 0 else 0
        probed, essential = order[:n], np.sort(order[n:])
        left = sums[n - 1] if n else 0
        blocks = np.flatnonzero(by_block[essential].sum(axis=0) + left >= threshold)
        if not len(blocks):
            return found
        live = None if len(blocks) == len(postings.edges) else _rows_of(postings.edges[blocks], len(postings.ids))
    part = lists[essential] if live is None or len(live) == len(postings.ids) else lists[np.ix_(essential, live)]
    live = np.arange(len(postings.ids)) if live is None else live
    score = q[essential] @ part
    if threshold is not None:
        near = np.flatnonzero(score + left >= threshold)
        live, score = live[near], score[near]
        if len(probed):
            score = score + q[probed] @ lists[np.ix_(probed, live)]
            near = np.flatnonzero(score >= threshold)
            live, score = live[near], score[near]
    own = postings.ids[live] != query_id
    score = score[own]
    scores = np.concatenate([scores, score if kind in (object, np.int64) else np.rint(score).astype(np.int64)])
    ids = np.concatenate([ids, postings.ids[live[own]]])
    if scores.dtype == object:
        best = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
        return _narrow(scores[best]), ids[best]
    if len(scores) > 4 * k:  # those that cannot be among the k best go before the rest is sorted
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[keep], ids[keep]
    best = np.lexsort((ids, -scores))[:k]
    return scores[best], ids[best]


def _narrow(scores: np.ndarray) -> np.ndarray:
    """As 64-bit integers, where all fit."""
    return scores.astype(np.int64) if all(-(1 << 63) <= x < 1 << 63 for x in scores) else scores


def _rows_of(edges: np.ndarray, n: int) -> np.ndarray:
    rows = (edges[:, None] + np.arange(BLOCK_ROWS)).ravel()
    return rows[rows < n]


def vectors(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id and whole weights floor(scale * x), as doubles, which hold them exactly. Left out: null vectors, and those with a component that is null or not finite; a repeated vec_id counts once, with its smallest vector."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # from 2^52 on doubles are whole; floor of smaller ones is a long
    whole = lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)
    weights = F.transform("embedding", lambda x: whole(x.cast("double") * scale))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    return rows.groupBy("vec_id").agg(F.min(weights).alias("weights"))


def _stored_blocks(paths: list[str], width: int, columns: list[str], rows: int) -> Iterator[tuple]:
    """Ids, weights and further columns of stored rows, some at a time."""
    for uri in paths:
        system, path = common.file_at(uri)
        with system.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=rows, columns=["vec_id", "weights", *columns]):
                yield batch.column(0).to_numpy(), _matrix(batch.column(1), width), *[batch.column(2 + i).to_pylist() for i in range(len(columns))]


def _shards(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[Postings]:
    """Shards of about SHARD_ROWS rows, those with wide weights apart."""
    waiting: dict[bool, list] = {False: [], True: []}
    for ids, weights in blocks:
        wide = np.abs(weights).max(axis=1, initial=0) >= WIDE
        for kind in (False, True):
            if (wide == kind).any():
                waiting[kind].append((ids[wide == kind], weights[wide == kind]))
                if sum(len(w[0]) for w in waiting[kind]) >= SHARD_ROWS:
                    yield Postings(*(np.concatenate(x) for x in zip(*waiting[kind], strict=True)))
                    waiting[kind] = []
    for kind in (False, True):
        if waiting[kind]:
            yield Postings(*(np.concatenate(x) for x in zip(*waiting[kind], strict=True)))


def _found(queries: Iterator[tuple[int, np.ndarray, int | None]], shards: list[Postings], k: int) -> pa.RecordBatch:
    out = [(np.zeros(0, np.int64),) * 3]
    for query_id, query, threshold in queries:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for shard in shards:
            found = search(shard, query_id, query, k, found, threshold)
        if found[0].dtype == object:
            raise ValueError(f"a score of vector {query_id} leaves the range of a long")
        out.append((np.full(len(found[0]), query_id), found[1], found[0]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score long"


def _search_first(queries: DataFrame, shard: DataFrame, k: int, width: int) -> DataFrame:
    """The k best rows of one shard, which each task reads from its files, for every query; the queries are dealt to tasks."""
    paths = shard.inputFiles()

    def run(batches):
        shards = list(_shards(_stored_blocks(paths, width, [], SHARD_ROWS)))
        for batch in common.slices(batches):
            yield _found(zip(batch.column(0).to_pylist(), _matrix(batch.column(1), width), [None] * batch.num_rows, strict=True), shards, k)

    return queries.select("vec_id", "weights").repartition(ranks.tasks_for(queries.count(), BLOCK_QUERIES)).mapInArrow(run, FOUND)


def _search_all(rows: DataFrame, queries: DataFrame, k: int, width: int) -> DataFrame:
    """query_id, vec_id and score of the k best rows of some shards of each task for every query; rows stay where they are, and each task reads the queries from their files."""
    paths = queries.inputFiles()

    def run(batches):
        blocks = ((part.column(0).to_numpy(), _matrix(part.column(1), width)) for part in common.slices(batches, SHARD_ROWS))
        shards = _shards(blocks)
        while held := list(islice(shards, HELD_SHARDS)):
            for ids, weights, thresholds in _stored_blocks(paths, width, ["threshold"], BLOCK_QUERIES):
                yield _found(zip(ids.tolist(), weights, thresholds, strict=True), held, k)

    return rows.select("vec_id", "weights").mapInArrow(run, FOUND)


def top_k(embeddings: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k highest inner products; ties go to the smaller vec_id.

    Queries are the rows for which the condition is_query on vec_id holds; candidates are all rows but the query's
    own. A query with fewer candidates gets all of them; an empty table gives no rows. Vectors with null or non-finite
    components take no part, and a repeated vec_id counts once. Sums are exact at any size; where one of the k best does
    not fit a long, that is an error. Other columns are ignored.
    """
    rows = common.stored(vectors(embeddings, scale), "vectors")
    n, width = rows.agg(F.count("*"), F.max(F.size("weights"))).first()
    asked = rows.filter(is_query)
    first = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // SHARD_ROWS))) == 0
    # about SHARD_ROWS rows of any table: the k-th score among them is one that the k best of all rows reach
    sample = common.stored(_search_first(asked, common.stored(rows.filter(first), "first-shard"), k, width or 0), "first-scores")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    reached = sample.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("threshold"))
    queries = common.stored(asked.join(reached, "vec_id", "left").select("vec_id", "weights", "threshold"), "queries")
    found = sample.union(_search_all(rows.filter(~first), queries, k, width or 0))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other vectors for every 20th. Nulls, ties, repeated rows, empty tables and extra columns: as top_k states."""
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT))) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i])) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 20
"""
