"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is ten consecutive words of an item (all of a shorter item's). A document contains a window only if it
contains each of the window's tokens, so one necessary token is enough as its prefix: the rarest in the whole corpus.
Document words join on that token; its offset in the window bounds where the window can start and end, and the
window's words are then compared with the document's at that place.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm import common

WINDOW = 10
#: What stands between words: a run of ASCII characters that are no letters or digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows up to which the prefix table is broadcast (about 300 bytes each); beyond, both sides are shuffled.
BROADCAST_WINDOWS = 100_000


def words_of(text: Column) -> Column:
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    # splitting is several times faster than extracting each word by an expression; only the ends can be empty
    return F.coalesce(F.array_remove(F.split(lower, SEPARATORS), ""), F.array().cast("array<string>"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, key (the words with spaces between), words and len of every window; repeated windows of an item once."""
    words = items.select("item_id", words_of(F.col("text")).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (window - 1), F.lit(1)))
    cut = words.select("item_id", "all", F.explode(starts).alias("at")).select("item_id", F.expr(f"slice(all, at, {window})").alias("words"))
    return cut.select("item_id", F.array_join("words", " ").alias("key"), "words", F.size("words").alias("len")).dropDuplicates(["item_id", "key"])


def text_hash(text: str) -> Column:
    """What tells apart the texts of rows that share a doc_id, or have none: two 64-bit hashes of unlike seeds."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _sized(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def prefix_table(docs: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """Each distinct window with its corpus-rarest token and that token's offset; windows with a token that no document has are left out."""
    distinct = windows.select("key", "words", "len").dropDuplicates(["key"])
    tokens = distinct.select("key", "words", "len", F.posexplode("words").alias("offset", "token"))
    vocabulary = tokens.select("token").distinct()
    counts = (
        docs.select(F.explode(words_of(F.col("text"))).alias("token"))
        .join(_sized(vocabulary, small), "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    ranked = tokens.join(_sized(counts, small), "token", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset"))
    out = ranked.groupBy("key").agg(rarest.alias("r"), F.first("words").alias("window"), F.first("len").alias("len"))
    return out.filter("r.n > 0").select("key", "window", "len", F.col("r.token").alias("token"), F.col("r.offset").alias("offset"))


def occurrences(docs: DataFrame, prefix: DataFrame, small: bool) -> DataFrame:
    """One row for each place where a window stands, and one with a null key for each document; columns: row (doc_id and text hash), key, start, len, n_words."""
    base = docs.select(F.struct("doc_id", text_hash("text").alias("h")).alias("row"), words_of(F.col("text")).alias("words"))
    # no word is empty: an empty one at the end stands for the document itself, so that its count needs no second scan
    # (never an empty array; of an inner posexplode of a column Spark infers a filter on its size, which splits the text once more)
    ended = base.select("row", "words", F.posexplode_outer(F.concat("words", F.array(F.lit("")))).alias("at", "word"))
    mark = prefix.sparkSession.range(1).select(F.lit("").alias("token"), F.lit(None).cast("string").alias("key"), F.array().cast("array<string>").alias("window"), F.lit(0).alias("len"), F.lit(0).alias("offset"))
    table = prefix.select("token", "key", "window", "len", "offset").unionByName(mark)
    start = F.col("at") - F.col("offset")
    bounds = (start >= 0) & (start + F.col("len") <= F.size("words"))
    same = F.slice("words", start + 1, F.col("len")) == F.col("window")
    shown = ["row", "key", start.alias("start"), "len", F.when(F.col("key").isNull(), F.col("at")).alias("n_words")]
    if small:
        return ended.join(F.broadcast(table), (F.col("word") == F.col("token")) & bounds & (F.col("key").isNull() | same)).select(*shown)
    # candidates go without the documents' words, which are joined again for the comparison
    narrow = ended.select("row", "at", "word", F.size("words").alias("size"))
    found = narrow.join(table, (F.col("word") == F.col("token")) & (start >= 0) & (start + F.col("len") <= F.col("size")))
    checked = found.join(base.dropDuplicates(["row"]), "row").filter(F.col("key").isNull() | same)
    return checked.select(*shown)


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """What each document shares with the benchmark items.

    Result: doc_id, h (text_hash), n_words, n_hit (words inside any occurrence of a window), n_items, item_ids (sorted
    as strings), contaminated. Null texts have no words; null item ids count as hits but not as items; equal rows give equal rows,
    one each; an empty items table leaves all documents clean, an empty documents table gives no rows. Of equally rare
    words of a window the first by spelling is its prefix, which changes no result. Very long texts are one array of
    words. Other columns are ignored.
    """
    windows = item_windows(items, window)
    small = windows.count() <= broadcast_windows
    prefix = common.stored(prefix_table(docs, windows, small), "window-prefixes")
    hits = occurrences(docs, prefix, small).join(_sized(windows.select("key", "item_id"), small), "key", "left")
    grouped = hits.groupBy("row").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count("n_words").alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("key").isNotNull(), F.struct("start", "len")))).alias("spans"),
        F.collect_set("item_id").alias("ids"),
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    add = lambda acc, s: F.struct(
        F.greatest(acc.end, s.start + s.len).alias("end"),
        (acc.total + F.greatest(F.lit(0), s.start + s.len - F.greatest(acc.end, s.start))).alias("total"),
    )
    n_hit = F.aggregate("spans", zero, add, lambda acc: acc.total.cast("long"))
    return grouped.select(
        F.col("row.doc_id").alias("doc_id"), F.col("row.h").alias("h"), "n_words", n_hit.alias("n_hit"), F.size("ids").cast("long").alias("n_items"),
        F.array_sort(F.transform("ids", lambda x: x.cast("string"))).alias("item_ids"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("one"),
    ).select("doc_id", "h", "n_words", "n_hit", "n_items", "item_ids", (F.col("n_hit") > 0).alias("contaminated"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark. Nulls, long texts, ties, repeated rows, empty tables and extra columns: as scan states."""
    found = scan(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rk, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT l FROM win
), grams AS (
  SELECT rk, l, s, array_to_string(w[s : s + l - 1], ' ') AS k
  FROM (SELECT rk, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, lens WHERE len(w) >= l)
), occ AS (
  SELECT rk, s, grams.l, item_id FROM grams JOIN win ON grams.k = win.k AND grams.l = win.l
), hit AS (
  SELECT rk, count(DISTINCT p) AS n_hit FROM (SELECT rk, unnest(range(s, s + l)) AS p FROM (SELECT DISTINCT rk, s, l FROM occ)) GROUP BY rk
), its AS (
  SELECT rk, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT rk, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY rk
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rk) LEFT JOIN its USING (rk)
"""
