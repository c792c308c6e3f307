"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target over its size is how many copies its documents get on average; the whole part is given to each and
the fraction is a probability of one copy more. Two documents with such a probability exchange expected words, by chance
in one direction or the other, so that no document's expectation changes and the sum of words never does, until one of
them has probability 0 or 1. Blocks of documents are folded this way, each leaving one document at most, and these
residuals are folded in blocks again, in a tree, until one document of each source is left, which is drawn.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm import common, ranks

SEPARATOR = r"[\x20\x09-\x0D]"
#: Weights of the sources, repeated in their order.
WEIGHTS = (5, 2, 1)
#: Words of the mix, as percent of all sizes.
PERCENT = 150
#: Copies at most.
MOST = 2
#: Documents that one fold takes, and residuals that one fold of the next level takes.
BLOCK = 256
SEED = 7
#: Probabilities as near to 0 or 1 are these.
NEAR = 1e-9


def word_count(text: Column) -> Column:
    """Words of a text (null: 0): places where a separator, or the text's beginning, is followed by another character."""
    led = F.concat(F.lit(" "), text)
    return F.coalesce(F.length(led) - F.length(F.regexp_replace(led, rf"{SEPARATOR}(?=[^\x20\x09-\x0D])", "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """source, source_size and target (words) of each source of sizes (source, source_size).

    Sources weigh by their order (code points, null last). A target stops at most times the size, and what is over is
    shared again by weight: the targets are the least level times the weight, which rises until no uncapped one is above.
    Sources without a word get 0. An empty table gives no rows.
    """
    ranked = ranks.numbered(ranks.salted(sizes.withColumn("none", F.col("source").isNull()), "sources"), [], ["none", "source"], "ordered-sources")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    ranked = common.stored(ranked.select("source", "source_size", weight.alias("weight")), "source-weights")
    cap = F.col("source_size") * most
    total, share = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    every, words = share, total * percent
    while share:
        # the level is words / (100 * share); compared as whole numbers
        capped = F.lit(words).cast("decimal(38,0)") * F.col("weight") >= cap.cast("decimal(38,0)") * F.lit(100 * share).cast("decimal(18,0)")
        held, weighs = ranked.filter(capped).agg(F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if every - weighs == share:
            break
        words, share = total * percent - 100 * held, every - weighs
    target = cap.cast("double")
    if share:
        target = F.when(capped, target).otherwise(F.col("weight") * F.lit(float(words)) / F.lit(100.0 * share))
    return ranked.select("source", "source_size", target.alias("target"))


def _step(held: Column, item: Column) -> Column:
    """Two documents exchange expected words until one has probability 0 or 1: who is still held, and who is done.

    up is what held can take from item, down what it can give; up happens with probability down / (up + down), so that
    neither one's expectation changes.
    """
    room, owns = held["size"] * (1 - held["p"]), held["size"] * held["p"]
    can = F.struct(F.least(room, item["size"] * item["p"]).alias("up"), F.least(owns, item["size"] * (1 - item["p"])).alias("down"))

    def move(m: Column) -> Column:
        words = F.when(item["u"] * (m["up"] + m["down"]) < m["down"], m["up"]).otherwise(-m["down"])
        return ranks.let(words, lambda w: F.struct((held["p"] + w / held["size"]).alias("held"), (item["p"] - w / item["size"]).alias("item")))

    def settle(p: Column) -> Column:
        sure = lambda x: (x < NEAR) | (x > 1 - NEAR)
        moved = lambda doc, x: F.struct(doc["size"].alias("size"), doc["doc_id"].alias("doc_id"), x.alias("p"), doc["u"].alias("u"))
        a, b = moved(held, p["held"]), moved(item, p["item"])
        none = F.lit(None).cast(ITEM)
        return F.struct(
            F.when(~sure(p["held"]), a).when(~sure(p["item"]), b).otherwise(none).alias("held"),
            F.filter(F.array(a, b), lambda x: sure(x["p"])).alias("done"),
        )

    return ranks.let(ranks.let(can, move), settle)


ITEM = "struct<size:bigint,doc_id:bigint,p:double,u:double>"


def fold(items: Column) -> Column:
    """The document that stays between 0 and 1 after all of the array (null if none), and those that are done, p being 0 or 1."""
    start = F.struct(F.lit(None).cast(ITEM).alias("held"), F.array().cast(f"array<{ITEM}>").alias("done"))

    def add(acc: Column, item: Column) -> Column:
        # a step leaves the first unsettled one of the two; both are never left
        met = ranks.let(_step(acc["held"], item), lambda s: F.struct(s["held"].alias("held"), F.concat(acc["done"], s["done"]).alias("done")))
        return F.when(acc["held"].isNull(), F.struct(item.alias("held"), acc["done"].alias("done"))).otherwise(met)

    return F.aggregate(items, start, add)


def _chance(level: int, *of: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.lit(level), *of), 11) / float(1 << 53)


def mix(docs: DataFrame, block: int = BLOCK, **shares) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies times size) of each row of docs.

    Marginals are kept (a document's expected words are its size times target over source_size), and a source's taken
    words differ from its target by less than one document: the one of the last fold. Blocks hold documents of all
    lengths, dealt by a hash, longest first, so that long ones are settled against many short ones. Reruns agree: chances
    are hashes of a row's place in its source, and places do not depend on how the rows are dealt to tasks.

    Null texts, empty ones and those of separators alone have size 0 and are taken 0 times their 0 words; null sources
    are a source, the last; null doc_ids and repeated rows are rows of their own. Texts are counted whole. An empty
    table gives no rows. Extra columns are ignored.
    """
    sized = ranks.salted(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    goals = common.stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **shares), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.when(F.abs(ratio - F.round(ratio)) < NEAR, F.round(ratio)).otherwise(ratio)
    goals = goals.select(F.col("source").alias("__source"), "source_size", "target", F.floor(near).cast("long").alias("whole"), (near - F.floor(near)).alias("p"))
    rows = ranks.joined(sized, goals, {"source": "__source"})
    shown = ["source", "source_size", "target", "whole"]
    settled = [rows.filter("p = 0 OR size = 0").select("doc_id", *shown, "size", F.lit(0.0).alias("p"))]
    drawn = rows.filter("p > 0 AND size > 0").withColumn("deal", F.xxhash64(F.lit(SEED), "doc_id"))
    drawn = ranks.numbered(drawn, ["source"], ["deal", "doc_id", "size"], "places")
    level = drawn.select(*shown, "place", F.struct("size", "doc_id", "p", _chance(0, "source", "place").alias("u")).alias("item"))
    left, depth = drawn.agg(F.coalesce(F.max("of"), F.lit(0))).first()[0], 0
    while left > 1:
        # equal documents differ by u alone, which makes the order of a fold the same in every run
        each = level.groupBy(*shown, F.floor(F.col("place") / block).alias("place")).agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
        folded = common.stored(each.select(*shown, "place", fold(F.col("items")).alias("f")), f"fold-{depth}")
        settled.append(folded.select(*shown, F.inline("f.done")).select("doc_id", *shown, "size", "p"))
        depth += 1
        again = F.struct("f.held.size", "f.held.doc_id", "f.held.p", _chance(depth, "source", "place").alias("u"))
        level = folded.filter("f.held IS NOT NULL").select(*shown, "place", again.alias("item"))
        left = -(-left // block)
    last = (F.col("item.u") < F.col("item.p")).cast("double")
    settled.append(level.select("item.doc_id", *shown, "item.size", last.alias("p")))
    out = reduce(DataFrame.unionByName, settled).withColumn("copies", F.col("whole") + F.round("p").cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at 150% of their words. Nulls, long texts, ties, repeated rows, empty tables and extra columns: as mix states."""
    return mix(common.table(spark, sf_dir, "documents"))
