from pyspark.sql import functions as F

from docquery.llm import common, near_dedup
from docquery.llm.components import components

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark) -> set[str]:
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def test_stored_tables_and_rounds_of_components_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    ids = spark.range(2000)
    held = common.stored(ids.groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    chain = components(ids.filter("id % 20 != 0").select(F.col("id").alias("u"), (F.col("id") - 1).alias("v")))
    left = shuffle_files(spark) - before
    assert not left
    assert {r["count"] for r in held.collect()} == {20} and held.count() == 100
    assert {(r.node, r.component) for r in chain.collect()} == {(i, i - i % 20) for i in range(2000)}


def test_links_leave_no_shuffle_files_and_settings_as_they_were(spark):
    texts = [f"{' '.join(f'w{i}x{j}' for j in range(30))} {n}" for i in range(20) for n in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = shuffle_files(spark)
    for given in (None, "true"):
        spark.conf.unset(KEY) if given is None else spark.conf.set(KEY, given)
        kept = spark.conf.get(KEY)
        found = near_dedup.link(docs)
        assert spark.conf.get(KEY) == kept
        assert not shuffle_files(spark) - before
    spark.conf.unset(KEY)
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(i, i - i % 3) for i in range(60)}
