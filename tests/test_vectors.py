import numpy as np
import pytest
from pyspark.sql import functions as F

from docquery.operators import vectors
from docquery.operators.dense import cosine_top_k

SCHEMA = "vec_id long, embedding array<float>"


def recall(spark, found, truth, k=10):
    want = {(r.query_id, r.vec_id) for r in truth.collect()}
    got = {(r.query_id, r.vec_id) for r in found.collect()}
    return len(want & got) / len(want)


def test_recall_on_the_given_vectors(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors.build(spark, f"file://{tmp_path}/v", rows)
    built = vectors.VectorIndex(spark, f"file://{tmp_path}/v")
    assert built.lists.count() == rows.filter("embedding IS NOT NULL").count()
    queries = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found, truth = built.top_k(queries), cosine_top_k(rows, queries)
    assert recall(spark, found, truth) >= 0.9
    # scores of what was found are the exact ones
    exact = {(r.query_id, r.vec_id): r.score for r in truth.collect()}
    assert all(abs(r.score - exact[r.query_id, r.vec_id]) < 1e-6 for r in found.collect() if (r.query_id, r.vec_id) in exact)


def clustered(n=3000, dim=18, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    x = centres[rng.integers(0, 40, n)] + 0.15 * rng.normal(size=(n, dim))
    return [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]


def test_clusters_need_few_probes(spark, tmp_path):
    data = clustered() + [(5000 + i, [1.0] * 18) for i in range(50)] + [(6000, [0.0] * 18), (6001, None), (None, [1.0] * 18)]
    rows = spark.createDataFrame(data, SCHEMA)
    vectors.build(spark, f"file://{tmp_path}/v", rows, recall=0.99)
    built = vectors.VectorIndex(spark, f"file://{tmp_path}/v")
    assert built.rows == 3051 and built.probes <= 8 < len(built.centres)
    queries = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    assert recall(spark, built.top_k(queries), cosine_top_k(rows.filter("vec_id IS NOT NULL"), queries)) > 0.95


def test_too_few_in_the_cells_is_searched_exactly(spark, tmp_path):
    rows = spark.createDataFrame(clustered(200), SCHEMA)
    vectors.build(spark, f"file://{tmp_path}/v", rows, cells=40)
    built = vectors.VectorIndex(spark, f"file://{tmp_path}/v")
    queries = rows.filter("vec_id < 9").select(F.col("vec_id").alias("query_id"), "embedding")
    got = built.top_k(queries, 30, probes=1).drop("tier").collect()
    want = cosine_top_k(built.vectors(), queries, 30).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r.tier for r in built.top_k(queries, 30, probes=1).collect()} == {"exact"}
    # with every cell probed and all candidates scored, both tiers agree
    assert sorted((r.query_id, r.rank, r.vec_id) for r in built.top_k(queries, 5, probes=40, rescored=60).collect()) == sorted((r.query_id, r.rank, r.vec_id) for r in cosine_top_k(rows, queries, 5).collect())


def test_nothing_and_odd_lengths(spark, tmp_path):
    root = f"file://{tmp_path}/v"
    assert vectors.build(spark, root, spark.createDataFrame([], SCHEMA)) == 1
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")
    assert vectors.VectorIndex(spark, root).top_k(queries).count() == 0
    assert vectors.build(spark, root, spark.createDataFrame([(1, [1.0]), (2, [2.0])], SCHEMA)) == 2
    assert vectors.VectorIndex(spark, root).top_k(queries, 1).select("vec_id").collect() == [(2,)] and vectors.VectorIndex(spark, root, 1).rows == 0
    with pytest.raises(ValueError):
        vectors.build(spark, root, spark.createDataFrame([(1, [1.0]), (2, [2.0, 1.0])], SCHEMA))


def test_tiers(spark):
    rows = [("few", 10, 10, 4), ("many", 90, 90, 4), ("holes", 91, 90, 4), ("over", 300, 300, 4), ("wide", 90, 90, 999)]
    got = vectors.tiers(spark.createDataFrame(rows, "project string, chunks long, vectors long, dim int"), 50, 200, 100_000).collect()
    assert {r.project: (r.tier, r.degraded) for r in got} == {"few": ("exact", None), "many": ("ann", None), "holes": ("exact", "partial_coverage"), "over": ("stream", "exact_fallback"), "wide": ("stream", "exact_fallback")}
