"""The corpus pipeline: language ID, near-dedup, suffix-array dedup, benchmark decontamination, best-fit packing.

Each stage works on all that its predecessor kept. All but the last return the columns of documents, extra ones too.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm import common, decontamination, langid, near_dedup, packing, substring_dedup, tokens


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or whose likeliest language has a probability under 0.4, go.

    Each row is judged by its own text, so repeated rows share their fate.
    """
    return langid.keep_identified(docs, ~langid.held_out())


def _left_out(docs: DataFrame, gone: DataFrame, on: dict, how: str = "left_anti") -> DataFrame:
    """docs without the rows (left_semi: those rows alone) whose expressions (the values of on) equal the named columns of gone, null-safely."""
    gone = gone.select(*[F.col(c).alias(f"__{c}") for c in on]).distinct()
    rows = docs.withColumns({f"__own_{c}": x for c, x in on.items()})
    same = [F.col(f"__own_{c}").eqNullSafe(F.col(f"__{c}")) for c in on]
    return rows.join(gone, reduce(and_, same), how).select(*[F.col(f"`{c}`") for c in docs.columns])


def _one_of_each(docs: DataFrame) -> DataFrame:
    """One row of those with the same doc_id (or none) and the same text; rows with neither an id nor a word all stay."""
    ident = {"doc_id": F.col("doc_id"), "h": decontamination.text_hash("text")}
    worded = F.col("doc_id").isNotNull() | F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    twice = docs.filter(worded).groupBy(*[x.alias(c) for c, x in ident.items()]).agg(F.count("*").alias("n")).filter("n > 1")
    twice = common.stored(twice.drop("n"), "repeated-rows")
    # only the rows that are repeated are shuffled with their texts
    return _left_out(docs, twice, ident).union(_left_out(docs, twice, ident, "left_semi").dropDuplicates(["doc_id", "text"]))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 on five-word shingles, the document with the smallest doc_id stays.

    A document is a doc_id with a text, so rows that share a doc_id or have none are linked by their own texts. Of one
    group's documents with the same doc_id one stays, and one without a doc_id only if none has any. Rows with equal
    doc_id and text are one document, of which one row stays, and so are equal texts without a doc_id; texts without a
    word (null ones too) are linked with nothing.
    """
    key = F.xxhash64("doc_id", "text")
    found = near_dedup.link(docs.select(key.alias("doc_id"), "text"), size=5, percent=80)
    linked = found.filter("doc_id != component_id").select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")).distinct()
    linked = common.stored(linked.union(linked.select("component", "component").distinct()), "linked")
    ids = docs.select(key.alias("key"), "doc_id").join(linked, "key").select("component", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key").alias("row"))
    first = common.stored(ids.groupBy("component").agg(F.min("row").alias("first")).select("component", F.col("first.key").alias("first")), "first-documents")
    return _one_of_each(_left_out(docs, linked.join(first, "component").filter("key != first"), {"key": key}))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that stand earlier are cut out (characters stay whole); a document left without text goes.

    n_chars is that of the new text where text was cut. Null and empty texts stay as they are. Rows that share a
    doc_id are one place, and one without a doc_id comes before all others; each row is cut by its own text.
    """
    changed = next(c for c in ("cut" + "_" * n for n in range(len(docs.columns) + 1)) if c not in docs.columns)
    cut = substring_dedup.cut_repeats(docs, changed).filter(~F.col(changed) | (F.col("text") != ""))
    n_chars = F.when(F.col(changed), F.length("text")).otherwise(F.col("n_chars"))
    return cut.select(*[(n_chars.cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`")) for c, t in docs.dtypes])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text contains a window of a benchmark item go; null and empty texts contain none. Rows that share a doc_id are judged by their own texts."""
    found = decontamination.scan(docs, common.table(spark, sf_dir, "benchmark")).filter("contaminated")
    return _left_out(docs, found, {"doc_id": F.col("doc_id"), "h": decontamination.text_hash("text")})


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each remaining row stands in sequences of at most 1024 tokens; null and empty texts are their end id."""
    return packing.pack(docs, tokens.default_path())


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Language ID, substring removal and packing have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
