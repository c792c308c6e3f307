"""Retrieval quality: gains, recall, reciprocal rank, slices, comparisons."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks past this have no discount entry and add nothing.
MAX_RANK = 20


def gain(grade: Column, rank: Column) -> Column:
    return F.when(rank <= MAX_RANK, (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)).otherwise(0.0)


def metrics(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """hit, recall, mrr, ndcg and duplicate_path_ratio of each case.

    hits: case_id, rank, path. expected: case_id, path, grade. Each expected path counts once, at its first hit; a
    case without expected paths has recall and ndcg 1.
    """
    shown = hits.filter(F.col("rank") <= k)
    cases = hits.select("case_id").union(expected.select("case_id")).distinct()
    first = shown.groupBy("case_id", "path").agg(F.min("rank").alias("rank"))
    found = first.join(expected, ["case_id", "path"]).groupBy("case_id").agg(
        F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"),
        F.count(F.when(F.col("grade") >= 1, 1)).alias("relevant"),
        F.min(F.when(F.col("grade") >= 1, F.col("rank"))).alias("first"),
    )
    ideal_rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("grade"), "path"))
    ideal = expected.withColumn("r", ideal_rank).groupBy("case_id").agg(F.sum(F.when(F.col("r") <= k, gain(F.col("grade"), F.col("r")))).alias("idcg"), F.count(F.when(F.col("grade") >= 1, 1)).alias("wanted"))
    repeated = shown.groupBy("case_id").agg(F.count("*").alias("returned"), F.countDistinct("path").alias("paths"))
    joined = cases.join(found, "case_id", "left").join(ideal, "case_id", "left").join(repeated, "case_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "case_id",
        (zero("relevant") > 0).alias("hit"),
        F.round(F.when(zero("wanted") == 0, 1.0).otherwise(zero("relevant") / zero("wanted")), 6).alias("recall"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.when(zero("idcg") == 0, 1.0).otherwise(zero("dcg") / F.col("idcg")), 6).alias("ndcg"),
        F.round(F.when(zero("returned") == 0, 0.0).otherwise((F.col("returned") - F.col("paths")) / F.col("returned")), 6).alias("duplicate_path_ratio"),
    )


def slices(cases: DataFrame, by: str) -> DataFrame:
    """Macro averages of each slice."""
    return cases.groupBy(by).agg(
        F.count("*").alias("cases"),
        F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"),
        *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")],
    )


def outcome_matrix(outcomes: DataFrame, by: str) -> DataFrame:
    """Cases of each slice that every configuration hits, that none hits, and others. outcomes: the slice, case_id, hit."""
    cases = outcomes.groupBy(by, "case_id").agg(F.min(F.col("hit").cast("int")).alias("low"), F.max(F.col("hit").cast("int")).alias("high"))
    count = lambda c: F.count(F.when(c, 1))
    return cases.groupBy(by).agg(count(F.col("low") == 1).alias("all_hit"), count(F.col("high") == 0).alias("all_miss"), count((F.col("low") == 0) & (F.col("high") == 1)).alias("mixed"))


def deltas(base: DataFrame, current: DataFrame, value: str, by: str, tolerance: float = 1e-9) -> DataFrame:
    """Wins, losses and ties of each slice over the cases that both sides have."""
    both = base.select("case_id", F.col(value).alias("a")).join(current.select("case_id", by, F.col(value).alias("b")), "case_id")
    d = F.col("b") - F.col("a")
    count = lambda c: F.count(F.when(c, 1))
    return both.groupBy(by).agg(count(d > tolerance).alias("wins"), count(d < -tolerance).alias("losses"), count(F.abs(d) <= tolerance).alias("ties"), F.round(F.avg(d), 6).alias("mean_delta"))


def percentiles(values: DataFrame, by: str, value: str) -> DataFrame:
    """Median and 95th percentile, interpolated, and the nearest-rank 95th."""
    p = lambda f, q: F.expr(f"{f}({q}) WITHIN GROUP (ORDER BY {value})")
    return values.groupBy(by).agg(F.round(p("percentile_cont", 0.5), 6).alias("p50"), F.round(p("percentile_cont", 0.95), 6).alias("p95"), F.round(p("percentile_disc", 0.95), 6).alias("p95_nearest"))


def pareto(points: DataFrame, quality: str, cost: str, by: str) -> DataFrame:
    """Points of each group that no other point beats: none of at least their quality at a lower cost, or of higher quality at no more cost.

    A sorted pass finds them: in order of cost, a point must exceed the best quality of all cheaper ones.
    """
    levels = points.groupBy(by, cost).agg(F.max(quality).alias("level"))
    cheaper = Window.partitionBy(by).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    kept = levels.withColumn("before", F.max("level").over(cheaper)).filter(F.col("before").isNull() | (F.col("level") > F.col("before"))).drop("before")
    return points.join(kept, [by, cost]).filter(F.col(quality) == F.col("level")).drop("level")


#: Distinct points of a group that one task reduces at first.
SKYLINE_ROWS = 10_000


def _sweep(points: np.ndarray) -> np.ndarray:
    """Which of the distinct rows (quality, cost, latency) no other beats: in falling quality, each against a staircase of costs and latencies."""
    order = np.lexsort((points[:, 2], points[:, 1], -points[:, 0]))
    costs: list[float] = []
    latencies: list[float] = []
    kept = np.zeros(len(points), bool)
    for i in order:
        _, cost, latency = points[i]
        at = bisect_right(costs, cost)
        if at and latencies[at - 1] <= latency:
            continue
        kept[i] = True
        # steps that cost as much or more and are no faster are covered by this one
        first = bisect_left(costs, cost)
        last = first
        while last < len(costs) and latencies[last] >= latency:
            last += 1
        costs[first:last], latencies[first:last] = [cost], [latency]
    return kept


def skyline(points: DataFrame, quality: str, cost: str, latency: str, by: str) -> DataFrame:
    """Points of each group that no other point beats: none of at least their quality at no more cost and latency, and better in one.

    Distinct points are reduced in blocks of a group, and what the blocks keep is met again, half as many blocks at a
    time; a last block holds no more than two times what stays. Points with a null or NaN objective are left out; equal
    points stay or go together.
    """
    names = [quality, cost, latency]
    rows = points.filter(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(double(`{c}`))" for c in names))
    best = rows.select(F.col(by).alias("g"), *[F.col(c).cast("double").alias(x) for c, x in zip(names, "xyz", strict=True)]).distinct()

    def reduce_block(key: tuple, table: pa.Table) -> pa.Table:
        x = np.column_stack([table.column(c).to_numpy() for c in "xyz"])
        return table.filter(pa.array(_sweep(x)))

    largest = best.groupBy("g").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = 1 << max(0, (-(-largest // SKYLINE_ROWS) - 1)).bit_length()
    best = best.withColumn("block", F.pmod(F.xxhash64("x", "y", "z"), F.lit(blocks)).cast("int"))
    while True:
        best = best.groupBy("g", "block").applyInArrow(reduce_block, best.schema)
        if blocks == 1:
            break
        blocks //= 2
        best = best.withColumn("block", F.pmod("block", F.lit(blocks)).cast("int"))
    keys = best.select(F.col("g").alias("__g"), *[F.col(c).alias(f"__{c}") for c in "xyz"])
    same = F.col(by).eqNullSafe(F.col("__g"))
    for c, x in zip(names, "xyz", strict=True):
        same &= F.col(c).cast("double") == F.col(f"__{x}")
    return rows.join(keys, same, "left_semi")


def jaccard(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """left_id, right_id and similarity of all pairs of token sets (columns id, tokens) that are alike by `least` (above 0) or more.

    Of sets in one order of tokens, two that are so alike share a token of both prefixes of n - ceil(least * n) + 1
    tokens. Tokens that no left set has come first in that order, then rarer ones of left sets: of a right set only the
    tokens that left sets have are looked at, and only such pairs whose sizes allow it are compared in full. Two sets
    without tokens are alike by 1.
    """
    sets = {name: df.select(F.col("id").alias(name), F.array_distinct("tokens").alias("w")) for name, df in (("left_id", left), ("right_id", right))}
    bounds = sets["left_id"].filter(F.size("w") > 0).agg(F.min(F.size("w")).alias("low"), F.max(F.size("w")).alias("high"))
    near = sets["right_id"].withColumn("n", F.size("w")).crossJoin(F.broadcast(bounds))  # one row
    sets["near"] = near.filter((F.col("n") >= least * F.col("low") - 1e-9) & (F.col("high") >= least * F.col("n") - 1e-9)).select("right_id", "w")
    each = {"left_id": sets["left_id"], "right_id": sets["near"]}
    each = {name: df.select(name, F.size("w").alias("n"), F.explode("w").alias("token")) for name, df in each.items()}
    counts = each["left_id"].groupBy("token").agg(F.count("*").alias("df"))

    def prefix(name: str) -> DataFrame:
        order = Window.partitionBy(name).orderBy("df", "token")
        whole = Window.partitionBy(name)
        ranked = each[name].join(counts, "token").withColumn("nth", F.row_number().over(order) + F.col("n") - F.count("*").over(whole))
        return ranked.filter(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select(name, F.col("n").alias(f"{name}_n"), "token")

    fits = (F.col("left_id_n") >= least * F.col("right_id_n") - 1e-9) & (F.col("right_id_n") >= least * F.col("left_id_n") - 1e-9)
    pairs = prefix("left_id").join(prefix("right_id"), "token").filter(fits).select("left_id", "right_id").distinct()
    both = pairs.join(sets["left_id"].withColumnRenamed("w", "a"), "left_id").join(sets["near"].withColumnRenamed("w", "b"), "right_id")
    n = F.size(F.array_intersect("a", "b"))
    found = both.select("left_id", "right_id", (n / (F.size("a") + F.size("b") - n)).alias("similarity")).filter(F.col("similarity") >= least)
    bare = sets["left_id"].filter(F.size("w") == 0).select("left_id", F.lit(0).alias("w")).join(sets["right_id"].filter(F.size("w") == 0).select("right_id", F.lit(0).alias("w")), "w")
    return found.select("left_id", "right_id", F.round("similarity", 6).alias("similarity")).union(bare.select("left_id", "right_id", F.lit(1.0)))
