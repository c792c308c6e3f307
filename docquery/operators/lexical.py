"""BM25, phrases and boolean clauses over a stored index, for whole batches of queries."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.functions.text import simple_tokens
from docquery.operators import scan
from docquery.operators.index import Index
from docquery.session import shared_root

# The ranking formula, the length past which a chunk counts half, and the most rows of a query.
K1, B = 1.2, 0.75
LONG_CHUNK_CHARS, LONG_CHUNK_FACTOR = 1650, 0.5
MAX_LIMIT = 1000
# What a field's score counts in the sum.
FIELD_BOOSTS = {"text": 1.0, "title": 2.0, "heading_path": 1.5, "identifiers": 2.5}
#: Query terms up to which their table is broadcast (some tens of bytes each).
BROADCAST_TERMS = 200_000
#: Clauses, and rows of all queries' answers, that a task may hold (some tens of bytes each); more are joined by Spark.
HELD_CLAUSES, HELD_ROWS = 1_000_000, 4_000_000


def analyzed(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """doc_id, tokens, dl (tokens of the document) and n_chars."""
    tokens = simple_tokens("text") if tokens is None else tokens
    return docs.select("doc_id", tokens.alias("tokens"), F.length("text").alias("n_chars")).withColumn("dl", F.size("tokens"))


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, term and tf: one row for each document and term."""
    return analyzed(docs).select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def term_df(docs: DataFrame) -> DataFrame:
    """Documents that contain each term."""
    return analyzed(docs).select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df


def words_as_terms(text: Column | str) -> Column:
    """Tokens of the distinct words of a query. Words of other spelling count again: `A a` are two clauses, `a a` is one."""
    words = F.array_distinct(F.split(text, r"\s+"))
    return F.flatten(F.transform(words, simple_tokens))


def _idf(index: Index, terms: DataFrame, boosts: dict[str, float]) -> DataFrame:
    """The terms (with a column term, and field where it is not null) with each field's weight: boost times idf, and average length."""
    boost = F.create_map(*[F.lit(x) for pair in boosts.items() for x in pair])
    stats = index.stats.filter(F.col("field").isin(list(boosts)))
    rows = terms.withColumnRenamed("field", "only") if "field" in terms.columns else terms.withColumn("only", F.lit(None).cast("string"))
    joined = rows.join(index.df_of(terms), "term").filter(F.col("only").isNull() | (F.col("only") == F.col("field"))).join(F.broadcast(stats), "field")  # a row for each field
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return joined.withColumn("weight", boost[F.col("field")] * idf).withColumn("average", F.col("total") / F.col("n")).drop("only", "df", "n", "total")


def _gain(tf: Column | str) -> Column:
    tf = F.col(tf) if isinstance(tf, str) else tf
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("average")))


def _halved(score: Column | str, n_chars: str = "n_chars") -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return F.when(F.col(n_chars) > LONG_CHUNK_CHARS, score * LONG_CHUNK_FACTOR).otherwise(score)


def bm25(index: Index, queries: DataFrame, scope: DataFrame | None = None, boosts: dict[str, float] | None = None) -> DataFrame:
    """query_id, doc_id and score of every document that shares a term with a query.

    queries: query_id and terms (an array; each entry is a clause). Scores of the fields are added with their boosts.
    Statistics cover the whole index; a scope (doc_id) only restricts which documents are scored. Long ones count half.
    """
    boosts = {"text": 1.0} if boosts is None else boosts
    clauses = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    terms = clauses.select("term").distinct()
    n, n_clauses = terms.count(), clauses.count()
    weights = _idf(index, terms, boosts)
    hits = index.within(terms, places=False).select("doc_id", "field", "term", "tf", "dl", "n_chars")
    if scope is not None:
        hits = hits.join(scope.select("doc_id"), "doc_id", "left_semi")
    # all of a document comes to one task first, so that its rows for every query do not move
    hits = hits.repartition("doc_id")
    parts = hits.join(_small(weights, n * len(boosts)), ["field", "term"]).select("doc_id", "term", "n_chars", (F.col("weight") * _gain("tf")).alias("part"))
    # fields of a document and term are added before the queries that share the term multiply them
    if len(boosts) > 1:
        parts = parts.groupBy("doc_id", "term").agg(F.sum("part").alias("part"), F.first("n_chars").alias("n_chars"))
    scored = parts.join(_small(clauses, n_clauses), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("part") * F.col("times")).alias("score"), F.first("n_chars").alias("n_chars"))
    return scored.select("query_id", "doc_id", _halved("score").alias("score"))


def _gains(tf, dl, average):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def _lengths(n_chars):
    return np.where(n_chars > LONG_CHUNK_CHARS, LONG_CHUNK_FACTOR, 1.0)


def _ones(x, *others):
    return np.ones(len(x))


def _numbered(terms: DataFrame) -> DataFrame:
    """The rows as a stored table with a number for each."""
    return scan.stored(terms.withColumn("id", F.monotonically_increasing_id()))


def _in_scope(hits: DataFrame, scope: DataFrame | None) -> DataFrame:
    return hits if scope is None else hits.join(scope.select("doc_id"), "doc_id", "left_semi")


def bm25_top(index: Index, queries: DataFrame, limit: int = 10, scope: DataFrame | None = None, boosts: dict[str, float] | None = None) -> DataFrame:
    """top(bm25(...), limit), scored in the tasks that have a document's postings, which return each query's best alone."""
    boosts, limit = {"text": 1.0} if boosts is None else boosts, min(limit, MAX_LIMIT)
    clauses = scan.stored(queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")))
    n, n_queries = clauses.count(), clauses.select("query_id").distinct().count()
    if n > HELD_CLAUSES or n_queries * limit > HELD_ROWS:
        return top(bm25(index, queries, scope, boosts), limit)
    marks = _numbered(_idf(index, clauses.select("term").distinct(), boosts))
    asked = clauses.join(_small(marks, n * len(boosts)), "term").select("query_id", "id", (F.col("weight") * F.col("times")).alias("weight"), "average")
    hits = _in_scope(index.marked(marks.select("field", "term", "id"), places=False).select("doc_id", "id", "tf", "dl", "n_chars"), scope)
    return top(scan.best(hits, asked, limit, _gains, _lengths, parts=index.parts), limit)


def matched_top(index: Index, queries: DataFrame, limit: int = 10) -> DataFrame:
    """top(matched_terms(...), limit) with the number of terms as the score."""
    limit = min(limit, MAX_LIMIT)
    clauses = scan.stored(queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")))
    n, n_queries = clauses.count(), clauses.select("query_id").distinct().count()
    if len(index.fields()) > 1 or n > HELD_CLAUSES or n_queries * limit > HELD_ROWS:
        return top(matched_terms(index, queries).select("query_id", "doc_id", F.col("n").cast("double").alias("score")), limit)
    marks = _numbered(clauses.select("term").distinct().select(F.lit(index.fields()[0]).alias("field"), "term"))
    asked = clauses.join(_small(marks, n), "term").select("query_id", "id", F.lit(1.0).alias("weight"), F.lit(1.0).alias("average"))
    return top(scan.best(index.marked(marks, places=False).select("doc_id", "id", "tf", "dl", "n_chars"), asked, limit, _ones, _ones, parts=index.parts), limit)


def top(scored: DataFrame, limit: int = 10, by: str = "query_id", key: str = "doc_id", digits: int = 6) -> DataFrame:
    """The best `limit` rows of each query with their rank; ties go to the smaller key. The limit is at most MAX_LIMIT."""
    rounded = scored.withColumn("score", F.round("score", digits))
    order = Window.partitionBy(by).orderBy(F.desc("score"), key)
    return rounded.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= min(limit, MAX_LIMIT))


def matched_terms(index: Index, queries: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id and n: distinct terms of the query that the document (of the scope, if there is one) holds."""
    clauses = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    hits = index.within(clauses, places=False).select("doc_id", "term")
    if scope is not None:
        scope = scan.stored(scope.select("doc_id").distinct())
        hits = hits.join(_small(scope, scope.count()), "doc_id", "left_semi")
    hits = hits.repartition("doc_id")
    hits = hits.distinct() if len(index.fields()) > 1 else hits
    return hits.join(_small(clauses, clauses.count()), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))


def phrase_matches(index: Index, phrases: DataFrame) -> DataFrame:
    """phrase_id, doc_id, field and n (places where the entries of the array `terms` stand at their places).

    An array `offsets`, if there is one, says how far behind the first place each term stands (0, 0, 1 ...: two terms at one
    position and one at the next); otherwise terms are consecutive. The positions of a phrase's rarest term are looked at
    first, and those of its other terms only where they can follow.
    """
    return phrase_places(index, phrases).select("phrase_id", "doc_id", "field", F.col("tf").alias("n"))


def phrase_places(index: Index, phrases: DataFrame) -> DataFrame:
    """phrase_matches with tf in place of n, and dl and n_chars: postings of the phrases' terms move once, by document."""
    offsets = F.col("offsets") if "offsets" in phrases.columns else F.transform("terms", lambda t, i: i)
    entries = F.arrays_zip(F.col("terms").alias("term"), offsets.alias("offset"))
    sized = phrases.filter(F.size("terms") > 0).select("phrase_id", F.size("terms").alias("size"), F.posexplode(entries).alias("nth", "entry")).select("phrase_id", "size", "nth", "entry.*")
    sized = scan.stored(sized)
    n = sized.count()
    if n > HELD_CLAUSES:
        return _joined_places(index, sized, n)
    known = index.df_of(sized)
    numbers = _numbered(sized.select("term").distinct())
    names = _numbered(sized.select("phrase_id").distinct()).withColumnRenamed("id", "pid")
    frequency = known.groupBy("term").agg(F.sum("df").alias("df"))
    rows = sized.join(F.broadcast(frequency), "term", "left").join(F.broadcast(numbers), "term").join(F.broadcast(names), "phrase_id")  # HELD_CLAUSES rows at most
    # a phrase with a term that no document has stands nowhere
    of, first = Window.partitionBy("pid"), Window.partitionBy("pid").orderBy("df", "nth")
    rows = rows.withColumn("all", F.min(F.coalesce("df", F.lit(0))).over(of) > 0).withColumn("lead", F.row_number().over(first) == 1).filter("all")
    entries = scan.stored(rows.select("pid", "nth", "id", "offset", "lead"))
    marks = known.select("field", "term").join(F.broadcast(numbers), "term").join(F.broadcast(entries.select("id").distinct()), "id", "left_semi")
    found = scan.places(index.marked(marks).select("doc_id", "id", "field", "positions", "dl", "n_chars"), entries, index.parts)
    return found.join(F.broadcast(names), "pid").select("phrase_id", "doc_id", "field", "tf", "dl", "n_chars")


def _joined_places(index: Index, sized: DataFrame, n: int) -> DataFrame:
    """phrase_places by joins, for very many phrases."""
    frequency = index.df_of(sized).groupBy("term").agg(F.sum("df").alias("df"))
    known = sized.join(frequency, "term", "left")
    # a phrase with a term that no document has stands nowhere
    lead = known.groupBy("phrase_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "nth", "offset", "term")).alias("lead"), F.first("size").alias("size")).filter("lead.df > 0")
    lead = lead.select("phrase_id", "size", "lead.nth", "lead.term", "lead.offset")
    starts = index.within(lead).join(_small(lead, n), "term").select("phrase_id", "size", "doc_id", "field", "offset", F.explode("positions").alias("position"))
    starts = starts.select("phrase_id", "doc_id", "field", "size", (F.col("position") - F.col("offset")).alias("start")).filter("start >= 0")
    rest = sized.join(lead.select("phrase_id", F.col("nth").alias("first")), "phrase_id").filter("nth != first").select("phrase_id", "nth", "offset", "term")
    wanted = starts.filter("size > 1").join(_small(rest, n), "phrase_id")
    # only postings of the phrases' own terms move
    held = index.within(rest).select("doc_id", "field", "term", "positions")
    # sorted positions of a term in a document come once for all starts that ask for them
    checked = wanted.groupBy("doc_id", "field", "term", "phrase_id", "size", "nth", "offset").agg(F.collect_list("start").alias("starts")).join(held, ["doc_id", "field", "term"])
    found = checked.select("phrase_id", "doc_id", "field", "size", F.explode(F.array_intersect("starts", F.transform("positions", lambda p: p - F.col("offset")))).alias("start"))
    whole = found.groupBy("phrase_id", "doc_id", "field", "start", "size").agg(F.count("*").alias("met")).filter("met = size - 1")
    single = starts.filter("size = 1").select("phrase_id", "doc_id", "field", "start")
    found = whole.select("phrase_id", "doc_id", "field", "start").union(single).groupBy("phrase_id", "doc_id", "field").agg(F.count("*").alias("tf"))
    return found.join(index.lengths, ["doc_id", "field"]).select("phrase_id", "doc_id", "field", "tf", "dl", "n_chars")


def boolean(index: Index, must: list[str], should: list[str], must_not: list[str]) -> DataFrame:
    """doc_id and matched (number of clauses met) under required, optional and forbidden terms."""
    words = list({*must, *should, *must_not})
    rows = index.within(index.spark.createDataFrame([(w,) for w in words], "term string"), places=False).select("doc_id", "term").distinct()
    count = lambda some: F.count(F.when(F.col("term").isin(list(some)), 1)) if some else F.lit(0)
    out = rows.groupBy("doc_id").agg(count(set(must)).alias("m"), count(set(should)).alias("s"), count(set(must_not)).alias("x"))
    wanted = (F.col("m") == len(set(must))) & (F.col("x") == 0) & ((F.col("s") > 0) | F.lit(bool(must)))
    return out.filter(wanted).select("doc_id", (F.col("m") + F.col("s")).alias("matched"))


def score_clauses(index: Index, clauses: DataFrame, scope: DataFrame | None = None, boosts: dict[str, float] | None = None) -> DataFrame:
    """query_id, doc_id and score for queries given as clauses (see plans.clauses): query_id, clause, team, occur, field and terms.

    A clause of several terms is a phrase, whose terms stand at its offsets if it has them. A team's required clauses must all be met; of a query's teams one must be,
    every clause of the team -1 too, and none that is forbidden. Met clauses that are not forbidden add their scores. Groups
    (brackets) are scored likewise, from the inside out, and add what they score to the group around them.
    """
    boosts = FIELD_BOOSTS if boosts is None else boosts
    keys = ["query_id", "clause"]
    single = clauses.filter(F.size("terms") == 1).select(*keys, "field", F.element_at("terms", 1).alias("term"))
    terms = single.select("term", "field").distinct()
    weights = single.join(_idf(index, terms, boosts).withColumnRenamed("field", "on"), "term").filter(F.col("field").isNull() | (F.col("field") == F.col("on")))
    weights = weights.select(*keys, "term", F.col("on").alias("field"), "weight", "average").distinct()
    n = clauses.count()
    ones = index.within(terms, places=False).join(_small(weights, n * len(boosts)), ["term", "field"]).select(*keys, "doc_id", "n_chars", (F.col("weight") * _gain("tf")).alias("part"))

    phrases = clauses.filter(F.size("terms") > 1).withColumn("phrase_id", F.struct(*keys))
    idf = _idf(index, phrases.select(*keys, "field", F.explode("terms").alias("term")), boosts).groupBy(*keys, "field").agg(F.sum("weight").alias("weight"), F.first("average").alias("average"))
    places = phrase_places(index, phrases.select("phrase_id", "terms", *[c for c in ("offsets",) if c in phrases.columns])).select("phrase_id.*", "doc_id", "field", "tf", "dl", "n_chars")
    many = places.join(_small(idf, n * len(boosts)), [*keys, "field"]).select(*keys, "doc_id", "n_chars", (F.col("weight") * _gain("tf")).alias("part"))

    hits = ones.union(many)
    if scope is not None:
        hits = hits.join(scope.select("doc_id"), "doc_id", "left_semi")
    met = hits.groupBy(*keys, "doc_id").agg(F.sum("part").alias("part"), F.first("n_chars").alias("n_chars"))
    if "group" not in clauses.columns:
        clauses = clauses.withColumns({"group": F.lit(-1), "depth": F.lit(0)})
    deepest = clauses.agg(F.max("depth")).first()[0] or 0
    if deepest:  # every depth reads what the words and phrases have found
        path = f"{shared_root(index.spark)}/docquery-queries/{uuid.uuid4().hex}"
        met.write.parquet(path)
        met = index.spark.read.schema(met.schema).parquet(path)
    found = None
    # brackets from the inside out: what a group finds is a clause of the group around it
    for depth in range(deepest, -1, -1):
        inner = [] if found is None else [found.select("query_id", F.col("group").alias("clause"), "doc_id", "part", "n_chars")]
        found = _groups(reduce(DataFrame.unionByName, inner, met), clauses.filter(F.col("depth") == depth), n)
    return found.select("query_id", "doc_id", _halved("part").alias("score"))


def literal_top(index: Index, clauses: DataFrame, limit: int, scope: DataFrame | None = None, boosts: dict[str, float] | None = None, per_owner: int | None = None) -> DataFrame | None:
    """query_id, doc_id and score of score_clauses for clauses that are optional words and phrases: each task's best, which hold each query's `limit` best.

    Of the chunks of one document (chunk_id), at most per_owner are kept. None, where the queries are too many for that.
    """
    boosts = FIELD_BOOSTS if boosts is None else boosts
    n, n_queries = clauses.count(), clauses.select("query_id").distinct().count()
    if n * len(boosts) > HELD_CLAUSES or n_queries * limit > HELD_ROWS:
        return None
    single = clauses.filter(F.size("terms") == 1).select("query_id", F.element_at("terms", 1).alias("term"))
    marks = _numbered(_idf(index, single.select("term").distinct(), boosts))
    asked = single.join(F.broadcast(marks), "term").select("query_id", "id", "weight", "average")
    columns = ["doc_id", "id", "tf", "dl", "n_chars"]
    hits = index.marked(marks.select("field", "term", "id"), places=False).select(*columns)

    # a phrase that several queries have is sought once; its ids are below those of the terms
    several = clauses.filter(F.size("terms") > 1).select("query_id", "terms", *[c for c in ("offsets",) if c in clauses.columns])
    phrases = _numbered(several.drop("query_id").distinct()).withColumnRenamed("id", "phrase_id")
    idf = _idf(index, phrases.select("phrase_id", F.explode("terms").alias("term")), boosts).groupBy("phrase_id", "field").agg(F.sum("weight").alias("weight"), F.first("average").alias("average"))
    fields = _numbered(idf).withColumn("id", -1 - F.col("id"))
    said = several.join(F.broadcast(phrases), [c for c in several.columns if c != "query_id"]).join(F.broadcast(fields), "phrase_id").select("query_id", "id", "weight", "average")
    found = phrase_places(index, phrases).join(F.broadcast(fields.select("phrase_id", "field", "id")), ["phrase_id", "field"]).select(*columns)
    return scan.best(_in_scope(hits.union(found), scope), asked.union(said), limit, _gains, _lengths, lambda d: d >> 32, per_owner, parts=index.parts)


def _groups(met: DataFrame, clauses: DataFrame, n: int) -> DataFrame:
    """query_id, group, doc_id, part and n_chars of the documents that each group of these clauses finds."""
    group = ["query_id", "group"]
    met = met.join(_small(clauses.select("query_id", "clause", "group", "team", "occur"), n), ["query_id", "clause"])
    wanted = clauses.groupBy(*group, "team").agg(F.count(F.when(F.col("occur") == "must", 1)).alias("musts"), F.count(F.when(F.col("occur") == "should", 1)).alias("shoulds"))
    teams = met.groupBy(*group, "doc_id", "team").agg(
        F.sum(F.when(F.col("occur") != "must_not", F.col("part")).otherwise(0.0)).alias("part"), F.count(F.when(F.col("occur") == "must", 1)).alias("m"),
        F.count(F.when(F.col("occur") == "should", 1)).alias("s"), F.count(F.when(F.col("occur") == "must_not", 1)).alias("x"), F.first("n_chars").alias("n_chars"),
    ).join(_small(wanted, n), [*group, "team"])
    good = (F.col("m") == F.col("musts")) & ((F.col("musts") > 0) | (F.col("s") > 0))
    rule = F.col("team") < 0
    totals = teams.groupBy(*group, "doc_id").agg(
        F.sum(F.when(good, F.col("part")).otherwise(0.0)).alias("part"), F.count(F.when(good & ~rule, 1)).alias("teams"), F.count(F.when(good & rule, 1)).alias("rules"), F.sum("x").alias("x"), F.first("n_chars").alias("n_chars")
    )
    needs = wanted.groupBy(*group).agg(F.count(F.when(rule & (F.col("musts") > 0), 1)).alias("need_rules"), F.count(F.when(~rule & (F.col("musts") + F.col("shoulds") > 0), 1)).alias("need_teams"))
    return totals.join(_small(needs, n), group).filter("x = 0 AND rules = need_rules AND (teams > 0 OR need_rules > 0)").select(*group, "doc_id", "part", "n_chars")
