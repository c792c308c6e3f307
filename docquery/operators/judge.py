"""Judging ranked citations: line ranges, traps, comparisons of runs, and the checks that fail a run."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.operators.evaluate import gain

# Tolerances of the comparison, the latency budget, the resampling, and the bounds of a query set.
NDCG_DROP, EPSILON = 0.02, 1e-9
LATENCY_FACTOR, LATENCY_SLACK_MS, LATENCY_MOST_MS = 1.5, 5.0, 500.0
RESAMPLES, SEED = 1000, 0x9E3779B97F4A7C15
LEAST_K, MOST_K, CASES_PER_SLICE = 3, 20, 8


def touches(low: Column, high: Column, start: Column, stop: Column) -> Column:
    """Whether two inclusive line ranges meet; a null first range is the whole document."""
    return low.isNull() | (F.greatest(low, start) <= F.least(high, stop))


def _on_hits(hits: DataFrame, judged: DataFrame) -> DataFrame:
    """Hits (case_id, rank, path, start, stop) with the judgements (case_id, path, low, high, ...) that they meet."""
    return hits.join(judged, ["case_id", "path"]).filter(touches(F.col("low"), F.col("high"), F.col("start"), F.col("stop")))


def cited_metrics(hits: DataFrame, expected: DataFrame, absent: DataFrame, k: int) -> DataFrame:
    """hit, recall, mrr, ndcg, citation_overlap, forbidden_hit and duplicate_path_ratio of each case at k.

    expected: case_id, nth (its order in the case), path, low, high, grade; absent: case_id, path, low, high (traps).
    A hit takes the first expectation that it meets and no hit before took. A trap counts at rank 1 alone.
    """
    shown = hits.filter(F.col("rank") <= k)
    cases = hits.select("case_id").union(expected.select("case_id")).distinct()
    met = _on_hits(shown, expected).groupBy("case_id", "rank").agg(F.array_sort(F.collect_list(F.struct("nth", "grade"))).alias("offers"))
    ordered = met.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "offers"))).alias("hits"), F.count("*").alias("overlap"))
    none = F.array().cast("array<struct<nth:int,grade:int,rank:int>>")

    def take(taken: Column, hit: Column) -> Column:
        free = F.filter(hit.offers, lambda o: ~F.exists(taken, lambda t: t.nth == o.nth))
        one = F.transform(F.slice(free, 1, 1), lambda o: F.struct(o.nth.cast("int").alias("nth"), o.grade.cast("int").alias("grade"), hit["rank"].cast("int").alias("rank")))
        return F.concat(taken, one)

    taken = ordered.select("case_id", "overlap", F.aggregate("hits", none, take).alias("taken"))
    each = taken.select("case_id", F.explode("taken").alias("t")).groupBy("case_id").agg(
        F.sum(gain(F.col("t.grade"), F.col("t.rank"))).alias("dcg"), F.count("*").alias("found"), F.min(F.when(F.col("t.grade") >= 1, F.col("t.rank"))).alias("first")
    )
    graded = expected.groupBy("case_id").agg(F.sort_array(F.collect_list("grade"), asc=False).alias("g"))
    ideal = graded.select("case_id", F.size("g").alias("wanted"), F.aggregate(F.transform("g", lambda g, i: gain(g, i + 1)), F.lit(0.0), lambda a, b: a + b).alias("idcg"))
    trap = _on_hits(shown.filter("rank = 1"), absent).select("case_id", F.lit(True).alias("trap")).distinct()
    repeated = shown.groupBy("case_id").agg(F.count("*").alias("returned"), F.countDistinct("path").alias("paths"))
    joined = cases.join(taken.drop("taken"), "case_id", "left").join(each, "case_id", "left").join(ideal, "case_id", "left").join(trap, "case_id", "left").join(repeated, "case_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda part: F.round(F.when(zero("returned") == 0, 0.0).otherwise(part / F.col("returned")), 6)
    return joined.select(
        "case_id", F.col("first").isNotNull().alias("hit"), F.round(F.when(zero("wanted") == 0, 1.0).otherwise(zero("found") / F.col("wanted")), 6).alias("recall"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.when(zero("idcg") == 0, 1.0).otherwise(zero("dcg") / F.col("idcg")), 6).alias("ndcg"),
        share(zero("overlap")).alias("citation_overlap"), F.coalesce("trap", F.lit(False)).alias("forbidden_hit"), share(F.col("returned") - F.col("paths")).alias("duplicate_path_ratio"),
    )


def slice_reports(reports: DataFrame) -> DataFrame:
    """Macro averages of each configuration and slice: cases, hit_rate, forbidden_rate, recall, mrr, ndcg."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return reports.groupBy("config", "slice").agg(F.count("*").alias("cases"), rate("hit").alias("hit_rate"), rate("forbidden_hit").alias("forbidden_rate"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")])


def regressions(base: DataFrame, current: DataFrame) -> DataFrame:
    """config, slice, case_id and kind of every failure of the current reports against the base's.

    Reports: config, slice, case_id, hit, ndcg, forbidden_hit (and the other metrics). Only regressions fail; a
    configuration, slice or case on one side alone is drift (a base's configuration that is gone: missing).
    """
    key = ["config", "case_id"]
    both = base.select(*key, F.col("hit").alias("b_hit"), F.col("ndcg").alias("b_ndcg")).join(current.select(*key, "slice", "hit", "ndcg", "forbidden_hit"), key)
    flags = F.array_compact(F.array(
        F.when(F.col("forbidden_hit"), "ForbiddenHit"), F.when(F.col("b_hit") & ~F.col("hit"), "HitDrop"), F.when(F.col("b_ndcg") - F.col("ndcg") > NDCG_DROP + EPSILON, "NdcgDrop"),
    ))
    cases = both.select("config", "slice", "case_id", F.explode(flags).alias("kind"))
    a, b = (slice_reports(r).select("config", "slice", F.col("hit_rate").alias(f"{x}_hit"), F.col("ndcg").alias(f"{x}_ndcg")) for x, r in (("b", base), ("c", current)))
    configs = a.select("config", F.lit(1).alias("ours")).distinct().join(b.select("config", F.lit(1).alias("theirs")).distinct(), "config", "full_outer")
    lost = configs.filter("ours IS NULL OR theirs IS NULL").select("config", F.lit(None).cast("string").alias("slice"), F.lit(None).cast("string").alias("case_id"), F.when(F.col("theirs").isNull(), "MissingConfig").otherwise("CaseDrift").alias("kind"))
    known = configs.filter("ours = 1 AND theirs = 1").select("config")
    flags = F.array_compact(F.array(
        F.when(F.col("b_ndcg").isNull() | F.col("c_ndcg").isNull(), "CaseDrift"), F.when(F.col("b_hit") - F.col("c_hit") > EPSILON, "SliceHitRateDrop"), F.when(F.col("b_ndcg") - F.col("c_ndcg") > NDCG_DROP + EPSILON, "SliceNdcgDrop"),
    ))
    slices = a.join(b, ["config", "slice"], "full_outer").join(known, "config", "left_semi").select("config", "slice", F.lit(None).cast("string").alias("case_id"), F.explode(flags).alias("kind"))
    return cases.select("config", "slice", F.col("case_id").cast("string").alias("case_id"), "kind").union(slices).union(lost)


def paired(base: DataFrame, current: DataFrame, value: str = "ndcg") -> DataFrame:
    """Per slice, both sides' values by case; only slices in which both have the same cases, and at least one."""
    both = base.select("slice", "case_id", F.col(value).alias("a")).join(current.select("slice", "case_id", F.col(value).alias("b")), ["slice", "case_id"], "full_outer")
    whole = both.groupBy("slice").agg(F.count(F.when(F.col("a").isNull() | F.col("b").isNull(), 1)).alias("alone")).filter("alone = 0")
    return both.join(whole.select("slice"), "slice", "left_semi")


def bootstrap(pairs: DataFrame) -> DataFrame:
    """slice, low and high: the 95 % interval of the mean of b - a over resamples of a fixed generator. A slice has few cases."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(np.array(table["case_id"].to_pylist(), dtype=object), kind="stable")
        deltas = (table["b"].to_numpy() - table["a"].to_numpy())[order]
        n, mask, x = len(deltas), (1 << 64) - 1, SEED
        draws = np.empty(RESAMPLES * n, np.int64)
        # fixed values: the generator's shifts and its multiplier
        for i in range(len(draws)):
            x ^= x >> 12
            x ^= x << 25 & mask
            x ^= x >> 27
            draws[i] = (x * 0x2545F4914F6CDD1D & mask) % n
        means = np.sort(deltas[draws].reshape(RESAMPLES, n).sum(axis=1) / n)
        return pa.table({"slice": [table["slice"][0].as_py()], "low": [means[RESAMPLES * 25 // 1000 - 1]], "high": [means[RESAMPLES * 975 // 1000 - 1]]})

    return pairs.select(F.col("slice").cast("string").alias("slice"), "case_id", "a", "b").groupBy("slice").applyInArrow(run, "slice string, low double, high double")


def latency_gate(base: DataFrame, current: DataFrame, by: str, slack: float = 1.0) -> DataFrame:
    """Per group: the 95th percentiles (column ms), what the base's allows, and whether the current one keeps within it."""
    p95 = lambda df, name: df.groupBy(by).agg(F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY ms)").alias(name))
    allowed = F.least(F.col("base_p95") * LATENCY_FACTOR * max(slack, 1.0) + LATENCY_SLACK_MS, F.lit(LATENCY_MOST_MS))
    both = p95(base, "base_p95").join(p95(current, "p95"), by).withColumn("allowed", allowed)
    return both.select(by, F.round("base_p95", 6).alias("base_p95"), F.round("p95", 6).alias("p95"), F.round("allowed", 6).alias("allowed"), (F.col("p95") <= F.col("allowed")).alias("ok"))


# Most of the cases that may be saturated, and the least that must differ by configuration and by reranking.
SATURATED_MOST, DISAGREEMENTS_LEAST, RERANKED_LEAST = 0.70, 3, 1


def discrimination(outcomes: DataFrame) -> DataFrame:
    """Per slice, over configurations (outcomes: slice, case_id, config, hit): cases, saturated (all hit), not saturated, disagreements, cases in which reranking changes bm25's hit, and whether the slice tells configurations apart (discriminates)."""
    one = lambda config: F.max(F.when(F.col("config") == config, F.col("hit").cast("int")))
    cases = outcomes.groupBy("slice", "case_id").agg(F.min(F.col("hit").cast("int")).alias("low"), F.max(F.col("hit").cast("int")).alias("high"), one("bm25").alias("plain"), one("bm25_rerank").alias("reranked"))
    count = lambda c: F.count(F.when(c, 1))
    counted = cases.groupBy("slice").agg(
        F.count("*").alias("cases"), count(F.col("low") == 1).alias("saturated"), count(F.col("low") == 0).alias("non_saturated"), count(F.col("low") != F.col("high")).alias("disagreements"), count(F.col("plain") != F.col("reranked")).alias("rerank_disagreements")
    )
    apart = (F.col("saturated") <= SATURATED_MOST * F.col("cases")) & (F.col("disagreements") >= DISAGREEMENTS_LEAST) & (F.col("rerank_disagreements") >= RERANKED_LEAST)
    return counted.withColumn("discriminates", apart)


def common_misses(outcomes: DataFrame) -> DataFrame:
    """Cases that every configuration misses."""
    return outcomes.groupBy("case_id").agg(F.max(F.col("hit").cast("int")).alias("high")).filter("high = 0").select("case_id")


def quality_counts(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Per configuration and slice: queries, hits, misses by what they were before (accepted, new, unclassified), kinds of first answers, mean recall and ndcg.

    current: config, slice, case_id, hit, returned, forbidden_hit, mrr, recall, ndcg; previous: config, case_id, hit.
    """
    both = current.join(previous.select("config", "case_id", F.col("hit").alias("before")), ["config", "case_id"], "left")
    count = lambda c: F.count(F.when(c, 1))
    miss, some, first = ~F.col("hit"), F.col("returned") > 0, F.col("mrr") >= 1 - EPSILON
    return both.groupBy("config", "slice").agg(
        F.count("*").alias("queries"), count(F.col("hit")).alias("hits"), count(miss).alias("misses"), count(miss & ~F.col("before")).alias("accepted_misses"), count(miss & F.col("before")).alias("new_misses"), count(miss & F.col("before").isNull()).alias("unclassified_misses"),
        count(~some).alias("empty_results"), count(some & F.col("forbidden_hit")).alias("top1_trap"), count(some & ~F.col("forbidden_hit") & first).alias("top1_relevant"), count(some & ~F.col("forbidden_hit") & ~first).alias("top1_unjudged"),
        F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.avg("ndcg"), 6).alias("mean_ndcg"),
    )


def trap_warnings(hits: DataFrame, expected: DataFrame, absent: DataFrame) -> DataFrame:
    """case_id, kind, path and rank of every hit on a trap, and of first hits that meet no judgement."""
    key = ["case_id", "rank"]
    traps = _on_hits(hits, absent).select(*key, "path").distinct()
    known = traps.select("case_id", F.when(F.col("rank") == 1, "known trap").otherwise("trap").alias("kind"), "path", "rank")
    judged = _on_hits(hits.filter("rank = 1"), expected.select("case_id", "path", "low", "high").union(absent.select("case_id", "path", "low", "high"))).select(*key).distinct()
    return known.union(hits.filter("rank = 1").join(judged, key, "left_anti").select("case_id", F.lit("unjudged").alias("kind"), "path", "rank"))


def query_set_problems(cases: DataFrame, expected: DataFrame, absent: DataFrame, lines: DataFrame) -> DataFrame:
    """case_id and problem of everything that is wrong with a query set.

    cases: case_id, slice, k; expected and absent as in cited_metrics; lines: path and lines of each document.
    """
    as_text = lambda df, problem: df.select(F.col("case_id").cast("string").alias("case_id"), F.lit(problem).alias("problem"))
    twice = cases.groupBy("case_id").agg(F.count("*").alias("n")).filter("n > 1")
    both = expected.join(absent.select("case_id", "path", F.col("low").alias("l"), F.col("high").alias("h")), ["case_id", "path"])
    both = both.filter(F.col("l").isNull() | touches(F.col("low"), F.col("high"), F.col("l"), F.col("h")))
    outside = expected.join(lines, "path", "left").filter(F.col("lines").isNull() | (F.col("low") < 1) | (F.col("high") > F.col("lines")) | (F.col("low") > F.col("high")))
    thin = cases.groupBy("slice").agg(F.count("*").alias("n")).filter(F.col("n") < CASES_PER_SLICE).select(F.col("slice").alias("case_id"))
    found = [
        as_text(twice, "repeated id"), as_text(cases.filter(~F.col("k").between(LEAST_K, MOST_K)), "k out of range"), as_text(expected.filter(~F.col("grade").between(1, 3)), "grade out of range"),
        as_text(both, "expected and absent"), as_text(outside, "lines outside the document"), as_text(thin, "too few cases of the slice"),
    ]
    out = found[0]
    for df in found[1:]:
        out = out.union(df)
    return out.distinct()


def contextual(chunks: DataFrame) -> DataFrame:
    """Chunks with the text that a contextual recipe embeds: a line with the path, one with the headings, an empty one, and the text."""
    return chunks.withColumn("contextual", F.concat(F.col("rel_path"), F.lit("\n"), F.col("heading_path"), F.lit("\n\n"), F.col("text")))


def recipe_census(chunks: DataFrame) -> DataFrame:
    """Distinct inputs and their bytes under the plain and the contextual recipe."""
    each = contextual(chunks).select(F.explode(F.array(F.struct(F.lit("plain").alias("recipe"), F.col("text").alias("input")), F.struct(F.lit("contextual").alias("recipe"), F.col("contextual").alias("input")))).alias("x")).select("x.*")
    distinct = each.groupBy("recipe", F.sha2("input", 256).alias("h")).agg(F.max(F.octet_length("input")).alias("bytes"), F.count("*").alias("n"))
    return distinct.groupBy("recipe").agg(F.sum("n").alias("inputs"), F.count("*").alias("distinct_inputs"), F.sum("bytes").alias("bytes"))


def pool_census(pools: DataFrame) -> DataFrame:
    """Of observed candidate pools (pool, candidates, bytes): how many, empty or not, distinct ones, and the largest."""
    count = lambda c: F.count(F.when(c, 1))
    return pools.agg(F.count("*").alias("observations"), count(F.size("candidates") == 0).alias("empty"), count(F.size("candidates") > 0).alias("non_empty"), F.countDistinct(F.array_sort("candidates")).alias("pools"), F.max("bytes").alias("largest"))
