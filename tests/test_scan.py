"""Searches and phrases by document: what moves does not grow with the number of queries."""

import random

import pytest

from docquery.operators import index, lexical, scan
from docquery.plans import registry


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40)))) for i in range(300)]
    rows += [(300 + i, "a b c " + "x" * 1700 * (i % 2)) for i in range(30)]  # copies, long and short
    root = str(tmp_path_factory.mktemp("scan"))
    index.write(spark, root, spark.createDataFrame(rows, "doc_id long, text string"))
    index.delete(spark, root, spark.createDataFrame([(7,), (301,)], "doc_id long"))
    return index.Index(spark, root)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, ["h", "q"]), (4, ["nothing"])], "query_id long, terms array<string>")


def test_best_of_each_task_are_the_best(spark, built, queries, monkeypatch):
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    scope = spark.range(0, 320, 3).withColumnRenamed("id", "doc_id")
    for limit in (3, 25, 500):
        for inside in (None, scope):
            want = rows(lexical.top(lexical.bm25(built, queries, inside), limit))
            assert want and rows(lexical.bm25_top(built, queries, limit, inside)) == want
    want = rows(lexical.top(lexical.matched_terms(built, queries).selectExpr("query_id", "doc_id", "double(n) AS score"), 40))
    assert rows(lexical.matched_top(built, queries, 40)) == want
    monkeypatch.setattr(lexical, "HELD_CLAUSES", 0)
    assert rows(lexical.matched_top(built, queries, 40)) == want


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_scoped_topk", "rrf_fuse", "dedupe_per_source"])
def test_no_pairs_of_query_and_document_move(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "times#" not in plan


def test_places_of_phrases(spark, built):
    rng = random.Random(6)
    phrases = [(i, [rng.choice("abcdefghq") for _ in range(rng.randrange(1, 5))]) for i in range(60)] + [(60, ["a", "a"]), (61, ["a", "b", "c"])]
    table = spark.createDataFrame(phrases, "phrase_id long, terms array<string>")
    sized = table.selectExpr("phrase_id", "size(terms) AS size", "posexplode(terms) AS (nth, term)").selectExpr("*", "nth AS offset")
    rows = lambda df: sorted((r.phrase_id, r.doc_id, r.field, r.tf, r.dl, r.n_chars) for r in df.collect())
    want = rows(lexical._joined_places(built, sized, 200))
    found = lexical.phrase_places(built, table)
    assert want and rows(found) == want
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_neighbouring_postings_are_one_block(spark, built):
    (segment,) = built.segments
    from docquery.sources import store

    blocks = store.written(spark, segment)
    assert blocks.count() < 100 < index.opened(blocks).count()


def test_alike_sets_move_no_other_tokens(spark):
    from docquery.operators import evaluate

    rng = random.Random(8)
    sets = lambda n, words: [(i, rng.sample(words, rng.randrange(0, 9))) for i in range(n)]
    left, right = sets(25, "abcdefghijkl"), sets(120, "abcdefghijklmnopqrstuv")
    want = {(a, b): round(len({*x} & {*y}) / len({*x} | {*y}) if x or y else 1.0, 6) for a, x in left for b, y in right if not (x or y) or len({*x} & {*y}) >= 0.3 * len({*x} | {*y})}
    frame = lambda rows: spark.createDataFrame(rows, "id long, tokens array<string>")
    found = evaluate.jaccard(frame(left), frame(right), 0.3)
    assert want and {(r.left_id, r.right_id): r.similarity for r in found.collect()} == want
    # the order of tokens comes from the left sets alone
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString().replace("Union false, false", "", 1)
