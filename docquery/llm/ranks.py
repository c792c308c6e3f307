"""Exact row numbers within groups of any size, without a window over a whole group."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.llm import common

#: Rows that a task sorts; tables are dealt by their counted rows, not by the session's number of partitions.
TASK_ROWS = 200_000
LEAST_TASKS = 8


def tasks_for(rows: int, each: int = TASK_ROWS) -> int:
    return max(LEAST_TASKS, -(-rows // each))


def salted(df: DataFrame, name: str) -> DataFrame:
    """df stored with __salt, a number of each row, so that equal rows can be dealt to several tasks."""
    return common.stored(df.withColumn("__salt", F.monotonically_increasing_id()), name)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df, a salted table, with place (from 0, ascending by order, nulls first) and of (rows) among the rows of equal keys.

    The rows are sorted over all tasks by ranges of keys, order and salt; then each task's first number of a key is what
    the tasks before it hold of that key, a sum over one row for each key and task. Null keys are a key of their own.
    """
    rows = df.count()
    by = [*keys, *order, "__salt"]
    dealt = df.repartitionByRange(tasks_for(rows), *by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    dealt = common.stored(dealt, name).withColumn("__task", F.shiftright("__id", 33))
    each = dealt.groupBy("__task", *keys).agg(F.count("*").alias("n"), F.min("__id").alias("first"))
    same = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("n").over(same.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__task").alias("__t"), (before - F.col("first")).alias("__shift"), F.sum("n").over(same).alias("of"))
    return joined(dealt, each, {"__task": "__t", **{k: f"__k_{k}" for k in keys}}).withColumn("place", F.col("__id") + F.col("__shift")).drop("__id", "__task", "__shift")


def joined(left: DataFrame, right: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
    """A join by null-safe equality of left's columns with right's, whose key columns are left out of the result."""
    same = reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in on.items()])
    return left.join(right, same, how).drop(*on.values())


def let(value: Column, use) -> Column:
    """use(value), with value computed once for each row."""
    return F.transform(F.array(value), use)[0]
