"""Queries as clause tables: the words, phrases, fields and operators of many query texts, taken apart by Spark.

A clause has query_id, clause (its number), group, depth, team, occur (must, should or must_not), field (null: all) and
terms with their offsets; several terms are a phrase. Clauses joined by AND are one team, and a document must meet all of one team; `+x`, `-x` and
`NOT x` stand outside the teams (team -1) and hold for the whole group. A group is what stands in one pair of brackets, or in
none (ROOT), and is itself a clause, without terms, of the group around it. Boosts, ranges, slop and wildcards are errors,
and so are brackets that do not match, hold nothing that can be found, or are nested more than MOST_DEPTH deep.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.functions.text import simple_tokens
from docquery.operators.lexical import FIELD_BOOSTS
from docquery.session import shared_root


class QueryError(ValueError):
    """A query without terms, with marks that are not supported, or an argument out of range."""


_PIECE = r'[+-]?(?:\w+:)?"[^"]*"|[+-]?\(|\)|[^\s()]+'
_PARTS = r'^([+-]?)(?:(\w+):)?(?:"([^"]*)"|(\S+))$'
_UNKNOWN = r'[\[\]{}^~*]'
#: Brackets in brackets at most.
MOST_DEPTH = 8
#: The group of what stands in no bracket.
ROOT = -1


def _columns() -> list[Column]:
    """terms and offsets of a clause's entries."""
    return [F.transform("entries", lambda e: e["term"]).alias("terms"), F.transform("entries", lambda e: e["offset"]).alias("offsets")]


def _fail(bad: DataFrame, what: str) -> None:
    rows = bad.select("query_id").limit(3).collect()
    if rows:
        raise QueryError(f"{what}: queries {[r.query_id for r in rows]}")


def _kept(rows: DataFrame) -> DataFrame:
    """rows as a written table: they are read many times, by checks and by every step of a search."""
    path = f"{shared_root(rows.sparkSession)}/docquery-queries/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def simple_phrase(text: Column | str) -> Column:
    """Simple tokens as (term, offset): what an index of simple tokens is asked for. Of the analyzer's, analyzer.phrase."""
    return F.transform(simple_tokens(text), lambda t, i: F.struct(t.alias("term"), i.alias("offset")))


def literal(queries: DataFrame, tokens: Callable[[Column | str], Column] = simple_phrase) -> DataFrame:
    """Clauses of queries (query_id, text) whose words are only words: each distinct one is a clause that may match.

    tokens gives (term, offset) of a word, as the index that is searched was tokenized.
    """
    words = queries.select("query_id", F.posexplode(F.array_distinct(F.split("text", r"\s+"))).alias("clause", "word"))
    clauses = _kept(words.select("query_id", "clause", F.col("clause").alias("team"), F.lit("should").alias("occur"), F.lit(None).cast("string").alias("field"), tokens("word").alias("entries")).filter(F.size("entries") > 0).select("*", *_columns()).drop("entries"))
    _fail(queries.join(clauses, "query_id", "left_anti"), "a query has no searchable terms")
    return clauses


def syntax(queries: DataFrame, fields: list[str] | None = None, tokens: Callable[[Column | str], Column] = simple_phrase) -> DataFrame:
    """Clauses of queries (query_id, text) with AND, OR, NOT, +, -, field:word, "phrases" and brackets around any of them; other words may match."""
    fields = list(FIELD_BOOSTS) if fields is None else fields
    text = F.coalesce("text", F.lit(""))
    _fail(queries.filter(F.trim(text) == ""), "empty query")
    _fail(queries.filter((F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1), "unbalanced quote")
    _fail(queries.filter(F.regexp_replace(text, '"[^"]*"', "").rlike(_UNKNOWN)), "marks that are not supported")
    pieces = _nested(queries.select("query_id", F.posexplode(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))).alias("at", "piece")))
    order = Window.partitionBy("query_id", "group").orderBy("at")
    joined = _kept(pieces.withColumn("before", F.lag("piece").over(order)).withColumn("after", F.lead("piece").over(order)))
    joins = F.col("piece").isin("AND", "OR", "NOT")
    ends = F.when(F.col("piece") == "NOT", F.lit(False)).otherwise(F.col("before").isNull())
    _fail(joined.filter(joins & (ends | F.col("after").isNull() | F.col("after").isin("AND", "OR"))), "an operator without a word")
    words = joined.filter(~joins)
    part = lambda i: F.regexp_extract("piece", _PARTS, i)
    words = words.select("query_id", "group", "depth", "at", "before", "after", "opens", part(1).alias("sign"), F.when(part(2) != "", part(2)).alias("field"), F.concat(part(3), part(4)).alias("word"))
    _fail(words.filter(F.col("field").isNotNull() & ~F.col("field").isin(fields)), "an unknown field")
    whole = F.when(F.col("sign") == "+", "must").when((F.col("sign") == "-") | F.coalesce(F.col("before") == "NOT", F.lit(False)), "must_not")
    words = words.withColumn("whole", whole)
    begins = F.when(F.coalesce(F.col("before") == "AND", F.lit(False)), 0).otherwise(1)
    words = words.withColumn("team", F.when(F.col("whole").isNotNull(), -1).otherwise(F.sum(begins).over(order)))
    joined_by_and = F.coalesce(F.col("before") == "AND", F.lit(False)) | F.coalesce(F.col("after") == "AND", F.lit(False))
    occur = F.coalesce("whole", F.when(joined_by_and, "must").otherwise("should"))
    entries = F.when(~F.col("opens"), tokens("word")).otherwise(F.array().cast("array<struct<term:string,offset:int>>"))
    clauses = words.select("query_id", F.col("at").alias("clause"), "group", "depth", "team", occur.alias("occur"), "field", entries.alias("entries"), F.when(F.col("opens"), F.concat(F.lit("("), F.col("at"))).otherwise(F.col("word")).alias("word"), "opens")
    clauses = clauses.filter((F.size("entries") > 0) | F.col("opens")).select("*", *_columns())
    # words of equal spelling are one clause of their group
    clauses = clauses.groupBy("query_id", "group", "depth", "team", "occur", "field", "word", "opens").agg(F.min("clause").alias("clause"), F.first("terms").alias("terms"), F.first("offsets").alias("offsets"))
    clauses = _kept(clauses.select("query_id", "clause", "group", "depth", "team", "occur", "field", "terms", "offsets"))
    finding = clauses.filter("occur != 'must_not'").select("query_id", "group")
    _fail(queries.join(finding.filter(F.col("group") == ROOT), "query_id", "left_anti"), "a query has no searchable terms")
    _fail(pieces.filter("opens").select("query_id", F.col("at").alias("group")).join(finding, ["query_id", "group"], "left_anti"), "brackets without searchable terms")
    return clauses


def _nested(pieces: DataFrame) -> DataFrame:
    """query_id, at, piece, opens, depth and group of the pieces but closing brackets.

    A group is named by the place of its opening bracket, which is a piece of the group around it. The depth of a piece
    is how many brackets are open before it, and its group is the last of that depth that was opened.
    """
    order = Window.partitionBy("query_id").orderBy("at")
    opens, closes = F.col("piece").isin("(", "+(", "-("), F.col("piece") == ")"
    rows = pieces.withColumn("opens", opens).withColumn("closes", closes).withColumn("next", F.lead("piece").over(order))
    rows = _kept(rows.withColumn("depth", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(order)))
    last = rows.groupBy("query_id").agg(F.min("depth").alias("low"), F.max("depth").alias("high"), F.max_by("depth", "at").alias("end"))
    _fail(last.filter("low < 0 OR end != 0"), "unbalanced brackets")
    _fail(last.filter(F.col("high") > MOST_DEPTH), f"more than {MOST_DEPTH} brackets in each other")
    _fail(rows.filter(F.col("piece").rlike(r"^[+-]?\w+:$") & F.col("next").isin("(", "+(", "-(")), "a field before brackets")
    # an opening bracket is two rows: it names the group of the pieces one depth further in, and is a piece of the depth around it
    named = lambda depth, names: F.struct(depth.alias("depth"), F.lit(names).alias("names"))
    each = F.when(F.col("opens"), F.array(named(F.col("depth"), True), named(F.col("depth") - 1, False))).otherwise(F.array(named(F.col("depth"), False)))
    rows = rows.filter(~F.col("closes")).select("query_id", "at", "piece", "opens", F.inline(each))
    inside = Window.partitionBy("query_id", "depth").orderBy("at")
    group = F.when(F.col("depth") == 0, ROOT).otherwise(F.last(F.when(F.col("names"), F.col("at")), ignorenulls=True).over(inside))
    return rows.withColumn("group", group).filter(~F.col("names")).drop("names")
