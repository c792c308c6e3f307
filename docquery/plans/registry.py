"""Registered queries of the retrieval engine and the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.functions import analyzer
from docquery.functions import text as T
from docquery.operators import catalog, chunking, dense, evaluate, lexical, ranking, scan, vectors
from docquery.plans import clauses, search, stored
from docquery.sources.tables import chunks, docs, table
from docquery.streaming import debounce

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# SQL fragments that several statements share
_DOCS = "d AS (SELECT doc_id, source || '/' || doc_id || '.md' AS rel_path, source AS project, lang, source, strlen(text) AS size, text FROM documents)"
_TOKENS = r"t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w, length(text) AS n_chars FROM documents)"
_WORDS = r"flatten(list_transform(list_distinct(regexp_split_to_array(text, '\s+')), lambda x: regexp_extract_all(lower(x), '[\p{L}\p{N}]+')))"
_QUERIES = f"q AS (SELECT item_id AS query_id, {_WORDS} AS w FROM benchmark)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every benchmark item as query terms."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), lexical.words_as_terms("text").alias("terms"))


# --- catalog and scope


@query(f"WITH {_DOCS} SELECT rel_path, doc_id, size FROM d WHERE rel_path > 'src1' ORDER BY rel_path LIMIT 50")
def list_docs_page(spark, sf_dir):
    return catalog.page(docs(spark, sf_dir), "src1").select("rel_path", "doc_id", F.col("size").cast("long").alias("size"))


@query("SELECT doc_id, (SELECT count(*) FROM conversations c WHERE c.conv_id = d.doc_id) AS chunks FROM documents d")
def doc_chunk_counts(spark, sf_dir):
    return catalog.chunk_counts(docs(spark, sf_dir), chunks(spark, sf_dir))


@query(f"WITH {_DOCS}, n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT project, count(*) AS docs, CAST(sum(coalesce(n, 0)) AS BIGINT) AS chunks, CAST(sum(size) AS BIGINT) AS bytes, CAST(max(size) AS BIGINT) AS largest FROM d LEFT JOIN n ON n.conv_id = doc_id GROUP BY 1")
def project_counts(spark, sf_dir):
    out = catalog.project_counts(docs(spark, sf_dir), chunks(spark, sf_dir))
    return out.withColumn("largest", F.col("largest").cast("long"))


@query("SELECT h.conv_id AS doc_id, h.turn AS hit_seq, c.turn AS seq, (c.conv_id << 32) + c.turn AS chunk_id, c.role AS heading_path, CAST(length(c.text) AS BIGINT) AS n_chars FROM conversations h JOIN conversations c ON c.conv_id = h.conv_id AND c.turn BETWEEN h.turn - 1 AND h.turn + 1")
def read_neighbors(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return catalog.neighbours(c, c).withColumn("n_chars", F.col("n_chars").cast("long"))


@query(f"WITH {_DOCS} SELECT (conv_id << 32) + turn AS chunk_id, rel_path, role AS heading_path, turn AS seq FROM conversations JOIN d ON doc_id = conv_id WHERE role = 'user'")
def citations_lookup(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return catalog.citations(c.filter("heading_path = 'user'").select("doc_id", "seq"), c, docs(spark, sf_dir))


@query(f"WITH {_DOCS} SELECT doc_id, rel_path FROM d WHERE starts_with(rel_path, 'src1')")
def scope_prefix(spark, sf_dir):
    return catalog.path_prefix(docs(spark, sf_dir), "src1").select("doc_id", "rel_path")


@query("SELECT doc_id FROM documents WHERE list_has_all([lang, source], ['en', 'src3'])")
def scope_tags_all(spark, sf_dir):
    return catalog.has_tags(docs(spark, sf_dir), ["en", "src3"]).select("doc_id")


@query(f"WITH {_DOCS}, o AS (SELECT rel_path, sha256(text) AS h FROM d WHERE doc_id % 10 <> 0), n AS (SELECT rel_path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM d WHERE doc_id % 7 <> 0) SELECT coalesce(o.rel_path, n.rel_path) AS rel_path, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'removed' WHEN o.h = n.h THEN 'same' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.rel_path = n.rel_path")
def index_diff(spark, sf_dir):
    """Two snapshots of the documents: the newer lacks some, has others besides, and changes a fifth."""
    d = docs(spark, sf_dir)
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = d.filter("doc_id % 7 <> 0").withColumn("content_hash", F.sha2(changed, 256))
    return catalog.diff(d.filter("doc_id % 10 <> 0"), new)


def _jobs(spark, sf_dir):
    states = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "error").otherwise("done")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("project"), states.alias("state"), F.unix_timestamp("ts").alias("started_at"))


_JOBS = "j AS (SELECT event_id AS job_id, user_id AS project, CASE event_type WHEN 'click' THEN 'running' WHEN 'error' THEN 'error' ELSE 'done' END AS state, CAST(floor(epoch(ts)) AS BIGINT) AS started_at FROM events)"


@query(f"WITH {_JOBS} SELECT project, job_id, state, started_at FROM j QUALIFY row_number() OVER (PARTITION BY project ORDER BY started_at DESC, job_id DESC) = 1")
def latest_job(spark, sf_dir):
    return catalog.latest_job(_jobs(spark, sf_dir))


@query(f"WITH {_JOBS} SELECT * FROM j WHERE state = 'running' UNION ALL SELECT * FROM j WHERE state <> 'running' QUALIFY row_number() OVER (PARTITION BY project ORDER BY started_at DESC, job_id DESC) <= 5")
def prune_jobs(spark, sf_dir):
    return catalog.prune_jobs(_jobs(spark, sf_dir), 5)


@query("WITH e AS (SELECT user_id AS model_id, event_id AS key, CAST(epoch_us(ts) AS BIGINT) AS used_at, CAST(strlen(props) AS BIGINT) AS bytes, event_type = 'error' AND value > 20 AS leased FROM events), l AS (SELECT model_id, count(*) FILTER (leased) AS n, coalesce(sum(bytes) FILTER (leased), 0) AS b FROM e GROUP BY 1), r AS (SELECT *, row_number() OVER w AS nth, sum(bytes) OVER (PARTITION BY model_id ORDER BY used_at DESC, key DESC ROWS UNBOUNDED PRECEDING) AS total FROM e WHERE NOT leased WINDOW w AS (PARTITION BY model_id ORDER BY used_at DESC, key DESC)) SELECT model_id, key, used_at, bytes FROM e WHERE leased UNION ALL SELECT model_id, key, used_at, bytes FROM r JOIN l USING (model_id) WHERE nth + n <= 20 AND total + b <= 400")
def lru_evict(spark, sf_dir):
    """Cache entries from events; errors hold leases, of which those of a value up to 20 have expired."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("model_id"), F.col("event_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("used_at"), F.octet_length("props").cast("long").alias("bytes"), "event_type", "value")
    leases = e.filter("event_type = 'error'").select("model_id", "key", F.col("value").alias("expires_at"))
    return catalog.lru_keep(e.select("model_id", "key", "used_at", "bytes"), 20, 400, leases, now=20)


@query("SELECT sha256(text) AS chunk_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0) GROUP BY 1")
def embed_missing_dedupe(spark, sf_dir):
    d = docs(spark, sf_dir)
    return catalog.first_occurrences(d, d.filter("doc_id % 10 = 0").select(F.col("content_hash").alias("chunk_hash")))


@query("SELECT count(*) AS total, count(vec_id) AS present FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) ON vec_id = doc_id")
def vector_coverage(spark, sf_dir):
    return catalog.coverage(docs(spark, sf_dir), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")


# --- text


# The folding table and the letters of each script, stated again for the SQL.
_FOLD_FROM = "ёЁİأإآةى！＂＃＄％＆＇（）＊＋，－．／０１２３４５６７８９：；＜＝＞？＠ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ［＼］＾＿｀ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ｛｜｝～"
_FOLD_TO = r"""еЕIاااهي!"#$%&''()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\]^_`abcdefghijklmnopqrstuvwxyz{|}~"""
_FOLD_GONE = "ًٌٍَُِّْـ"
_LETTERS = {
    "latin": "[A-Za-zªµºÀ-ÖØ-öø-ɏḀ-ỿ]",
    "cyrillic": "[Ѐ-ҁҊ-ԯ]",
    "cjk": "[ᄀ-ᇿぁ-ゖゝ-ゟァ-ヺー-ヿ㐀-䶿一-鿿가-힣ｦ-ﾟ]",
    "arabic": "[ؐ-ؚؠ-ٗٙ-ٟٮ-ۓە-ۜۡ-ۭۨ-ۯۺ-ۼۿݐ-ݿ]",
}
_COUNTS = ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS n_{n}" for n, p in _LETTERS.items())


@query(f"SELECT doc_id, translate(text, '{_FOLD_FROM}{_FOLD_GONE}', '{_FOLD_TO}') AS folded FROM documents")
def fold_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.fold("text").alias("folded"))


@query(f"WITH c AS (SELECT doc_id, {_COUNTS} FROM documents), m AS (SELECT *, greatest(n_latin, n_cyrillic, n_cjk, n_arabic) AS m FROM c) SELECT doc_id, CASE WHEN m = 0 THEN 'other' WHEN n_latin = m THEN 'latin' WHEN n_cyrillic = m THEN 'cyrillic' WHEN n_cjk = m THEN 'cjk' ELSE 'arabic' END AS script, n_latin, n_cyrillic, n_cjk, n_arabic FROM m")
def script_of_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.script_of("text").alias("script"), *[c.cast("long").alias(f"n_{n}") for n, c in zip(T.SCRIPTS, T.script_counts("text"), strict=True)])


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: regexp_matches(w, '[\p{L}\p{N}]') AND regexp_matches(w, '[^\p{L}\p{N}]')), ' ') AS identifiers FROM documents")
def identifier_words(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.identifier_words("text").alias("identifiers"))


@query("SELECT doc_id, CASE WHEN substr(text, 240, 2) = chr(13) || chr(10) THEN substr(text, 1, 239) ELSE substr(text, 1, 240) END AS snippet, length(text) > 240 AS truncated FROM documents")
def snippets(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.snippet("text").alias("snippet"), (F.length("text") > T.SNIPPET_CHARS).alias("truncated"))


@query("SELECT doc_id, strlen(text) AS size, CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS BIGINT) AS lines FROM documents")
def document_facts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.col("size").cast("long").alias("size"), T.line_count(F.col("text")).cast("long").alias("lines"))


@query(f"WITH {_TOKENS} SELECT doc_id, u AS term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS u FROM t) GROUP BY 1, 2")
def postings_tf(spark, sf_dir):
    return lexical.postings(docs(spark, sf_dir))


@query(f"WITH {_TOKENS} SELECT u AS term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS u FROM t) GROUP BY 1")
def term_df(spark, sf_dir):
    return lexical.term_df(docs(spark, sf_dir))


@query(f"WITH {_TOKENS} SELECT doc_id, CAST(len(w) AS BIGINT) AS dl FROM t")
def doc_len(spark, sf_dir):
    return lexical.analyzed(docs(spark, sf_dir)).select("doc_id", F.col("dl").cast("long").alias("dl"))


# --- search

_BM25 = f"""
WITH {_TOKENS}, {_QUERIES}, c AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(w) AS term FROM q) GROUP BY 1, 2),
p AS (SELECT doc_id, u AS term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS u FROM t) WHERE u IN (SELECT term FROM c) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
x AS (
  SELECT query_id, p.doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t.w) / avgdl))) AS score, any_value(n_chars) AS n_chars
  FROM p JOIN df USING (term) JOIN c USING (term) JOIN t ON t.doc_id = p.doc_id, s
  WHERE {{scope}} GROUP BY 1, 2
), r AS (SELECT query_id, doc_id, round(score * CASE WHEN n_chars > 1650 THEN 0.5 ELSE 1.0 END, 6) AS score FROM x),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r)
"""
_ALL, _SCOPED = _BM25.replace("{scope}", "true"), _BM25.replace("{scope}", "p.doc_id IN (SELECT doc_id FROM documents WHERE starts_with(source, 'src1'))")


@query(f"WITH {_TOKENS} SELECT u AS term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(w) AS u FROM t) GROUP BY 1")
def index_build(spark, sf_dir):
    """Write the index of all documents, and what it holds of every term."""
    built = stored.index(spark, sf_dir)
    return built.postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query(_ALL + "SELECT * FROM k WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return lexical.bm25_top(stored.index(spark, sf_dir), _queries(spark, sf_dir))


@query(_SCOPED + "SELECT * FROM k WHERE rank <= 10")
def bm25_scoped_topk(spark, sf_dir):
    inside = catalog.path_prefix(docs(spark, sf_dir), "src1")
    return lexical.bm25_top(stored.index(spark, sf_dir), _queries(spark, sf_dir), scope=inside)


@query((_ALL + "SELECT * FROM k WHERE rank <= 10").replace("FROM documents)", "FROM documents WHERE source IS DISTINCT FROM 'src7')"))
def bm25_updated(spark, sf_dir):
    """The search over an index in segments, after one source was brought anew, one was deleted and segments were merged."""
    return lexical.bm25_top(stored.updated(spark, sf_dir), _queries(spark, sf_dir))


@query(rf"WITH {_TOKENS}, i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark), ph AS (SELECT item_id * 10000 + j AS phrase_id, w[j : j + 2] AS a FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS j FROM i)), g AS (SELECT doc_id, w[j : j + 2] AS a FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS j FROM t)) SELECT phrase_id, doc_id, count(*) AS n FROM ph JOIN g USING (a) GROUP BY 1, 2")
def phrase_match(spark, sf_dir):
    """Every three consecutive words of every item as a phrase."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.simple_tokens("text").alias("w")).filter(F.size("w") >= 3)
    at = items.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 2)).alias("j"))
    phrases = at.select((F.col("item_id") * 10000 + F.col("j")).alias("phrase_id"), F.slice("w", F.col("j"), 3).alias("terms"))
    return lexical.phrase_matches(stored.index(spark, sf_dir), phrases).select("phrase_id", "doc_id", "n")


@query(f"WITH {_TOKENS} SELECT doc_id, CAST(1 + CASE WHEN list_contains(w, 'of') THEN 1 ELSE 0 END + CASE WHEN list_contains(w, 'and') THEN 1 ELSE 0 END AS BIGINT) AS matched FROM t WHERE list_contains(w, 'the') AND NOT list_contains(w, 'it')")
def bool_and_or_not(spark, sf_dir):
    return lexical.boolean(stored.index(spark, sf_dir), ["the"], ["of", "and"], ["it"]).withColumn("matched", F.col("matched").cast("long"))


@query(_ALL + ", z AS (SELECT query_id, doc_id, source, rank FROM k JOIN documents USING (doc_id) WHERE rank <= 50) SELECT query_id, doc_id, source, rank FROM z QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) <= 2")
def dedupe_per_source(spark, sf_dir):
    hits = lexical.bm25_top(stored.index(spark, sf_dir), _queries(spark, sf_dir), 50)
    named = hits.join(docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return ranking.cap_per_document(named, 2, doc="source").select("query_id", "doc_id", "source", "rank")


# tables that the statements on turns share: field tokens with positions, lengths, and statistics by field
_TURNS = r"""
t AS (
  SELECT (conv_id << 32) + turn AS doc_id, 'text' AS field, 1.0::DOUBLE AS boost, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w, length(text) AS n_chars FROM conversations
  UNION ALL SELECT (conv_id << 32) + turn, 'title', 2.0, regexp_extract_all(lower(role), '[\p{L}\p{N}]+'), length(text) FROM conversations
),
p AS (SELECT doc_id, field, u AS term, count(*) AS tf FROM (SELECT doc_id, field, unnest(w) AS u FROM t) GROUP BY 1, 2, 3),
df AS (SELECT field, term, count(*) AS df FROM p GROUP BY 1, 2),
s AS (SELECT field, any_value(boost) AS boost, count(*) AS n, avg(len(w)) AS avgdl FROM t GROUP BY 1),
g AS (SELECT p.doc_id, p.field, p.term, t.n_chars, s.boost * ln(1 + (n - df + 0.5) / (df + 0.5)) AS weight, tf, len(t.w) AS dl, avgdl
  FROM p JOIN df USING (field, term) JOIN t ON t.doc_id = p.doc_id AND t.field = p.field JOIN s ON s.field = p.field)
"""


@query(f"WITH {_TURNS}, q AS (SELECT item_id AS query_id, list_append({_WORDS}, 'user') AS w FROM benchmark), c AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(w) AS term FROM q) GROUP BY 1, 2), x AS (SELECT query_id, doc_id, sum(times * weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, any_value(n_chars) AS n_chars FROM g JOIN c USING (term) GROUP BY 1, 2), r AS (SELECT query_id, doc_id, round(score * CASE WHEN n_chars > 1650 THEN 0.5 ELSE 1.0 END, 6) AS score FROM x) SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r QUALIFY rank <= 10")
def bm25_fielded_topk(spark, sf_dir):
    """Turns by their text and their role as title, with the title's boost."""
    q = _queries(spark, sf_dir).withColumn("terms", F.concat("terms", F.array(F.lit("user"))))
    return lexical.bm25_top(stored.index(spark, sf_dir, "conversations"), q, boosts=stored.TURN_BOOSTS)


# the analyzer's tokens of a segment in SQL; the given texts have Latin letters alone, so no run is parted by scripts and none gives pairs
def _segment_sql(x: str) -> str:
    camel = rf"string_split(regexp_replace(regexp_replace(r, '([\p{{Ll}}0-9])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), ' ')"
    runs = rf"flatten(list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+'), lambda r: list_prepend(lower(r), list_transform({camel}, lambda y: lower(y)))))"
    span = r"'^[^\p{L}\p{N}_]*([\p{L}\p{N}_]+)[^\p{L}\p{N}_]*$'"
    return f"list_distinct(list_filter(list_concat([lower({x}), lower(regexp_extract({x}, {span}, 1))], {runs}), lambda y: length(y) BETWEEN 1 AND 40))"


def _segments_sql(text: str) -> str:
    return rf"list_transform(list_filter(regexp_split_to_array({text}, '\s+'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')), lambda x: {_segment_sql('x')})"


# turns by the analyzer: tokens of each segment, and clauses of literal words, whose tokens must stand in one segment
_ANALYZED = rf"""
t AS (
  SELECT (conv_id << 32) + turn AS doc_id, 'text' AS field, 1.0::DOUBLE AS boost, {_segments_sql("text")} AS segs, length(text) AS n_chars FROM conversations
  UNION ALL SELECT (conv_id << 32) + turn, 'title', 2.0, {_segments_sql("role")}, length(text) FROM conversations
),
l AS (SELECT *, len(flatten(segs)) AS dl FROM t),
sg AS (SELECT doc_id, field, s, unnest(s) AS term FROM (SELECT doc_id, field, unnest(segs) AS s FROM t)),
p AS (SELECT doc_id, field, term, count(*) AS tf FROM sg GROUP BY 1, 2, 3),
df AS (SELECT field, term, count(*) AS df FROM p GROUP BY 1, 2),
s AS (SELECT field, any_value(boost) AS boost, count(*) AS n, avg(dl) AS avgdl FROM l GROUP BY 1),
c0 AS (SELECT query_id, word, {_segment_sql("word")} AS w FROM (SELECT item_id AS query_id, unnest(list_distinct(regexp_split_to_array(text, '\s+'))) AS word FROM benchmark) WHERE regexp_matches(word, '[\p{{L}}\p{{N}}]')),
ph AS (SELECT DISTINCT w FROM c0 WHERE len(w) > 0),
tfs AS (SELECT w, doc_id, field, count(*) AS tf FROM ph JOIN sg ON sg.term = w[1] AND list_has_all(sg.s, w) GROUP BY 1, 2, 3),
pw AS (SELECT w, df.field, sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5))) AS weight FROM (SELECT w, unnest(w) AS term FROM ph) JOIN df USING (term) JOIN s ON s.field = df.field GROUP BY 1, 2),
x AS (SELECT query_id, l.doc_id, sum(weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l.dl / avgdl))) AS score, any_value(n_chars) AS n_chars
  FROM c0 JOIN tfs USING (w) JOIN pw ON pw.w = tfs.w AND pw.field = tfs.field JOIN l ON l.doc_id = tfs.doc_id AND l.field = tfs.field JOIN s ON s.field = tfs.field GROUP BY 1, 2),
r AS (SELECT query_id, doc_id, round(score * CASE WHEN n_chars > 1650 THEN 0.5 ELSE 1.0 END, 6) AS score FROM x)
"""


@query(f"WITH {_DOCS}, {_ANALYZED}, k AS (SELECT query_id, doc_id AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS nth FROM r WHERE (doc_id >> 32) IN (SELECT doc_id FROM d WHERE starts_with(rel_path, 'src'))), m AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id >> 32 ORDER BY nth) <= 2), f AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY nth) AS INTEGER) AS rank FROM m QUALIFY rank <= 10) SELECT query_id, rank, score, chunk_id, rel_path AS path, role AS heading, turn + 1 AS line, CASE WHEN substr(v.text, 240, 2) = chr(13) || chr(10) THEN substr(v.text, 1, 239) ELSE substr(v.text, 1, 240) END AS snippet, length(v.text) > 240 AS snippet_truncated FROM f JOIN conversations v ON (conv_id << 32) + turn = chunk_id JOIN d ON d.doc_id = conv_id")
def search_turns(spark, sf_dir):
    """Search of whole items as literal words over turns, by the analyzer's tokens and positions: two fields, a scope, at most two turns of a conversation, citations and snippets."""
    d, c = docs(spark, sf_dir), stored.turns(spark, sf_dir)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    args = search.SearchArgs(limit=10, path_prefix="src", per_document=2, snippets=True)
    found = search.search(d, c, stored.index(spark, sf_dir, "analyzed turns"), queries, args, boosts=stored.TURN_BOOSTS)
    return found.select("query_id", "rank", "score", "chunk_id", "path", F.col("heading_path")[0].alias("heading"), F.col("lines")[0].cast("long").alias("line"), "snippet", "snippet_truncated")


@query()
def search_chunks(spark, sf_dir):
    """Search of whole items as literal words over the chunks of all documents, by the analyzer: four fields, at most two chunks of a document, citations."""
    chunks, index = stored.chunk_index(spark, sf_dir)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = search.search(docs(spark, sf_dir).select("doc_id", "rel_path"), chunks, index, queries, search.SearchArgs(limit=10, per_document=2))
    return found.select("query_id", "rank", "score", "chunk_id", "path", F.array_join("heading_path", " > ").alias("heading_path"), F.col("lines")[0].cast("long").alias("first_line"), F.col("lines")[1].cast("long").alias("last_line"))


#: Query syntax over the words of two turns' roles and common words; each text shows one form.
_FORMS = {
    1: "the of", 2: "the OR of", 3: "the AND of", 4: "the AND of OR title:user", 5: "title:assistant AND text:the", 6: '"of the"', 7: "the -of", 8: "+of the", 9: "the NOT and", 10: 'title:user AND "in the"', 11: "THE the", 12: '-title:user "to the"',
}
#: Brackets in brackets.
_TREES = {
    1: "(the OR of) AND (and OR in)", 2: "the AND NOT (of OR title:user)", 3: "+(the of) -(and AND in)", 4: "((the AND of) OR (and AND in)) AND title:assistant", 5: "the ((of))", 6: 'title:user AND ("in the" OR (of -the))', 7: "(title:user AND (of OR (in AND NOT (the AND (and OR to)))))",
}


def _form_sql(trees: bool = False) -> str:
    """Each form as a condition on a turn's tokens (x: text, y: title) and the clauses that it adds."""
    has = lambda c, w: f"list_contains({c}, '{w}')"
    any_ = lambda w: f"({has('x', w)} OR {has('y', w)})"
    after = lambda a, b: f"len(list_filter(range(1, len(x)), lambda i: x[i] = '{a}' AND x[i + 1] = '{b}')) > 0"
    one = lambda w, field=None, times=1: f"coalesce((SELECT sum({times} * weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) FROM g WHERE g.doc_id = h.doc_id AND term = '{w}'{'' if field is None else f' AND field = ' + repr(field)}), 0)"
    idf = lambda w: f"(SELECT boost * ln(1 + (n - df + 0.5) / (df + 0.5)) FROM df JOIN s USING (field) WHERE field = 'text' AND term = '{w}')"
    two = lambda a, b: f"(SELECT ({idf(a)} + {idf(b)}) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / avgdl)) FROM (SELECT len(list_filter(range(1, len(x)), lambda i: x[i] = '{a}' AND x[i + 1] = '{b}')) AS tf), s WHERE s.field = 'text')"
    both = f"{any_('the')} AND {any_('of')}"
    forms = {
        1: (f"{any_('the')} OR {any_('of')}", f"{one('the')} + {one('of')}"), 2: (f"{any_('the')} OR {any_('of')}", f"{one('the')} + {one('of')}"), 3: (both, f"{one('the')} + {one('of')}"),
        4: (f"({both}) OR {has('y', 'user')}", f"CASE WHEN {both} THEN {one('the')} + {one('of')} ELSE 0 END + {one('user', 'title')}"),
        5: (f"{has('y', 'assistant')} AND {has('x', 'the')}", f"{one('assistant', 'title')} + {one('the', 'text')}"), 6: (after("of", "the"), two("of", "the")),
        7: (f"{any_('the')} AND NOT {any_('of')}", one("the")), 8: (any_("of"), f"{one('of')} + {one('the')}"), 9: (f"{any_('the')} AND NOT {any_('and')}", one("the")),
        10: (f"{has('y', 'user')} AND {after('in', 'the')}", f"{one('user', 'title')} + {two('in', 'the')}"), 11: (any_("the"), one("the", None, 2)), 12: (f"{after('to', 'the')} AND NOT {has('y', 'user')}", two("to", "the")),
    }
    if trees:
        pair = lambda a, b: f"CASE WHEN {any_(a)} AND {any_(b)} THEN {one(a)} + {one(b)} ELSE 0 END"
        rest = f"({any_('in')} AND NOT ({any_('the')} AND ({any_('and')} OR {any_('to')})))"
        forms = {
            1: (f"({any_('the')} OR {any_('of')}) AND ({any_('and')} OR {any_('in')})", " + ".join(one(w) for w in ("the", "of", "and", "in"))), 2: (f"{any_('the')} AND NOT ({any_('of')} OR {has('y', 'user')})", one("the")),
            3: (f"({any_('the')} OR {any_('of')}) AND NOT ({any_('and')} AND {any_('in')})", f"{one('the')} + {one('of')}"),
            4: (f"(({both}) OR ({any_('and')} AND {any_('in')})) AND {has('y', 'assistant')}", f"{pair('the', 'of')} + {pair('and', 'in')} + {one('assistant', 'title')}"),
            5: (f"{any_('the')} OR {any_('of')}", f"{one('the')} + {one('of')}"),
            6: (f"{has('y', 'user')} AND ({after('in', 'the')} OR ({any_('of')} AND NOT {any_('the')}))", f"{one('user', 'title')} + {two('in', 'the')} + CASE WHEN {any_('the')} THEN 0 ELSE {one('of')} END"),
            7: (f"{has('y', 'user')} AND ({any_('of')} OR {rest})", f"{one('user', 'title')} + {one('of')} + CASE WHEN {rest} THEN {one('in')} ELSE 0 END"),
        }
    rows = " UNION ALL ".join(f"SELECT {k} AS query_id, doc_id, n_chars, {score} AS score FROM h WHERE {condition}" for k, (condition, score) in forms.items())
    return f"WITH {_TURNS}, h AS (SELECT a.doc_id, a.n_chars, a.w AS x, b.w AS y FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.field = 'text' AND b.field = 'title'), z AS ({rows}) SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(score * CASE WHEN n_chars > 1650 THEN 0.5 ELSE 1.0 END, 6) AS score FROM z"


@query(_form_sql())
def query_syntax(spark, sf_dir):
    """Every turn that each form of the query language finds, with its score."""
    forms = spark.createDataFrame(list(_FORMS.items()), "query_id long, text string")
    scored = lexical.score_clauses(stored.index(spark, sf_dir, "conversations"), clauses.syntax(forms), boosts=stored.TURN_BOOSTS)
    return scored.withColumn("score", F.round("score", 6))


@query(_form_sql(trees=True))
def query_trees(spark, sf_dir):
    """Every turn that each form with nested brackets finds, with its score."""
    forms = spark.createDataFrame(list(_TREES.items()), "query_id long, text string")
    scored = lexical.score_clauses(stored.index(spark, sf_dir, "conversations"), clauses.syntax(forms), boosts=stored.TURN_BOOSTS)
    return scored.withColumn("score", F.round("score", 6))


_LIST2 = """b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS rank FROM (SELECT query_id, p.doc_id, count(*) AS hits FROM p JOIN c USING (term) GROUP BY 1, 2) QUALIFY rank <= 50)"""
_RRF = _ALL + f""", a AS (SELECT query_id, doc_id, rank, score FROM k WHERE rank <= 50), {_LIST2},
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS ra, b.rank AS rb, a.score AS sa,
  round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 12) AS score
  FROM a FULL JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, (ra IS NOT NULL AND rb IS NOT NULL) DESC, least(ra, rb), sa DESC NULLS LAST, doc_id) AS INTEGER) AS rank FROM f
"""


@query(_RRF)
def rrf_fuse(spark, sf_dir):
    """BM25's list fused with a list by the number of query terms that a document holds."""
    index, q = stored.index(spark, sf_dir), _queries(spark, sf_dir)
    return ranking.rrf(lexical.bm25_top(index, q, 50), lexical.matched_top(index, q, 50))


@query(_ALL + ", o AS (SELECT query_id, p.doc_id, count(*) AS n FROM p JOIN c USING (term) SEMI JOIN labels ON labels.doc_id = p.doc_id GROUP BY 1, 2) SELECT query_id, doc_id, coalesce(CAST(n AS DOUBLE), 0) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n IS NULL, n DESC, rank) AS INTEGER) AS rank FROM k LEFT JOIN o USING (query_id, doc_id) WHERE k.rank <= 20")
def rerank_overlap(spark, sf_dir):
    """A provider that scores the labelled documents, by shared terms."""
    index, q = stored.index(spark, sf_dir), _queries(spark, sf_dir)
    hits = scan.stored(lexical.bm25_top(index, q, 20))
    # only hits are asked for
    labelled = table(spark, sf_dir, "labels").select("doc_id").join(hits.select("doc_id"), "doc_id", "left_semi")
    scored = lexical.matched_terms(index, q, labelled)
    return ranking.rerank(hits, scored.select("query_id", "doc_id", F.col("n").cast("double").alias("provider_score")))


def _query_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), "embedding")


_COSINE = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_cosine_similarity(q.e, v.e), 9) AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)"


@query(f"WITH {_COSINE} SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10")
def cosine_topk(spark, sf_dir):
    return dense.cosine_top_k(table(spark, sf_dir, "embeddings"), _query_vectors(spark, sf_dir))


@query(f"WITH {_COSINE} SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s WHERE label IN (1, 2) QUALIFY rank <= 10")
def cosine_scoped(spark, sf_dir):
    return dense.cosine_top_k(table(spark, sf_dir, "embeddings").filter("label IN (1, 2)"), _query_vectors(spark, sf_dir))


@query()
def ann_topk(spark, sf_dir):
    """The nearest vectors of every 100th one from the stored index of all: about those of cosine_topk, with exact scores."""
    return stored.vector_index(spark, sf_dir).top_k(_query_vectors(spark, sf_dir))


@query("""
WITH c AS (
  SELECT 'label ' || label AS project, count(*) AS chunks, count(embedding) AS vectors, max(len(embedding)) AS dim FROM embeddings GROUP BY 1
  UNION ALL
  SELECT source, count(*), count(embedding), coalesce(max(len(embedding)), 0) FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY 1
)
SELECT project, chunks, vectors, dim,
       CASE WHEN vectors > 54 OR vectors * dim * 4 > 15000 THEN 'stream' WHEN vectors >= 46 AND vectors >= chunks AND vectors * (dim * 4 + ceil(dim / 4.0) + 12) <= 15000 THEN 'ann' ELSE 'exact' END AS tier,
       CASE WHEN vectors > 54 OR vectors * dim * 4 > 15000 THEN 'exact_fallback' WHEN vectors < chunks THEN 'partial_coverage' END AS degraded
FROM c
""")
def dense_tiers(spark, sf_dir):
    """How a search of each group is answered, with limits that the small tables reach: groups of vectors by label, and of documents by source."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    held = [F.count("*").alias("chunks"), F.count("embedding").alias("vectors"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim")]
    by_label = e.groupBy(F.concat(F.lit("label "), F.col("label").cast("string")).alias("project")).agg(*held)
    by_source = d.join(e, d.doc_id == e.vec_id, "left").groupBy(F.col("source").alias("project")).agg(*held)
    return vectors.tiers(by_label.union(by_source), min_vectors=46, max_vectors=54, max_bytes=15_000)


@query()
def chunk_documents(spark, sf_dir):
    """Every chunk of every document with its lines, kind and heading path."""
    out = chunking.chunk(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "seq", "kind", "lang", "line_start", "line_end", F.array_join("heading_path", " > ").alias("heading_path"), F.sha2("text", 256).alias("chunk_hash"))


@query()
def analyzer_terms(spark, sf_dir):
    """Frequency of every analyzed term of every document."""
    return analyzer.term_counts(docs(spark, sf_dir))


# --- evaluation


def _cases(spark, sf_dir):
    """Sources as cases: documents by length are the hits, labelled ones the expected."""
    d = table(spark, sf_dir, "documents")
    hits = d.select(F.col("source").alias("case_id"), F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"), F.col("doc_id").alias("path"))
    expected = d.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("case_id"), F.col("doc_id").alias("path"), (F.col("quality") + 1 - F.col("toxic")).alias("grade")).filter("grade >= 1")
    return hits, expected


_CASES = """
h AS (SELECT source AS case_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, doc_id AS path FROM documents),
x AS (SELECT source AS case_id, doc_id AS path, quality + 1 - toxic AS grade FROM documents JOIN labels USING (doc_id) WHERE quality + 1 - toxic >= 1),
f AS (SELECT case_id, sum(CASE WHEN rank <= 20 THEN (2.0 ** grade - 1) / log2(rank + 1) ELSE 0 END) AS dcg, count(*) AS relevant, min(rank) AS first FROM h JOIN x USING (case_id, path) WHERE rank <= {k} GROUP BY 1),
i AS (SELECT case_id, sum(CASE WHEN r <= {k} THEN (2.0 ** grade - 1) / log2(r + 1) END) AS idcg, count(*) AS wanted FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, path) AS r FROM x) GROUP BY 1),
m AS (SELECT case_id, coalesce(relevant, 0) > 0 AS hit, round(CASE WHEN coalesce(wanted, 0) = 0 THEN 1.0 ELSE coalesce(relevant, 0) / wanted END, 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS mrr,
  round(CASE WHEN coalesce(idcg, 0) = 0 THEN 1.0 ELSE coalesce(dcg, 0) / idcg END, 6) AS ndcg, 0.0::DOUBLE AS duplicate_path_ratio
  FROM (SELECT DISTINCT case_id FROM h) LEFT JOIN f USING (case_id) LEFT JOIN i USING (case_id))
"""


@query(f"WITH {_CASES.format(k=10)} SELECT * FROM m")
def case_metrics(spark, sf_dir):
    return evaluate.metrics(*_cases(spark, sf_dir), 10)


@query(f"WITH {_CASES.format(k=3)} SELECT right(case_id, 1) AS slice, count(*) AS cases, round(avg(CAST(hit AS INTEGER)), 6) AS hit_rate, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM m GROUP BY 1")
def early_metric_slices(spark, sf_dir):
    cases = evaluate.metrics(*_cases(spark, sf_dir), 3).withColumn("slice", F.expr("right(case_id, 1)"))
    return evaluate.slices(cases, "slice")


@query("WITH o AS (SELECT lang AS slice, source AS case_id, bool_and(quality = 1) AS a, bool_or(quality = 1) AS b FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2) SELECT slice, count(*) FILTER (a) AS all_hit, count(*) FILTER (NOT b) AS all_miss, count(*) FILTER (b AND NOT a) AS mixed FROM o GROUP BY 1")
def outcome_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluate.outcome_matrix(rows.select(F.col("lang").alias("slice"), F.col("source").alias("case_id"), (F.col("quality") == 1).alias("hit")), "slice")


@query("WITH a AS (SELECT user_id AS case_id, avg(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id AS case_id, user_id % 4 AS slice, avg(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) SELECT slice, count(*) FILTER (b.v - a.v > 1e-9) AS wins, count(*) FILTER (b.v - a.v < -1e-9) AS losses, count(*) FILTER (abs(b.v - a.v) <= 1e-9) AS ties, round(avg(b.v - a.v), 6) AS mean_delta FROM a JOIN b USING (case_id) GROUP BY 1")
def delta_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("case_id", F.col("user_id"))
    a = e.filter("event_id % 2 = 0").groupBy("case_id").agg(F.avg("value").alias("v"))
    b = e.filter("event_id % 2 = 1").groupBy("case_id", (F.col("user_id") % 4).alias("slice")).agg(F.avg("value").alias("v"))
    return evaluate.deltas(a, b, "v", "slice")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.95), 6) AS p95_nearest FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return evaluate.percentiles(table(spark, sf_dir, "events"), "event_type", "value")


@query("WITH p AS (SELECT p_brand, p_partkey, p_size, p_retailprice FROM part) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.p_brand = p.p_brand AND o.p_size >= p.p_size AND o.p_retailprice <= p.p_retailprice AND (o.p_size > p.p_size OR o.p_retailprice < p.p_retailprice))")
def pareto(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice")
    return evaluate.pareto(rows, "p_size", "p_retailprice", "p_brand").select("p_brand", "p_partkey", "p_size", "p_retailprice")


@query("""
WITH e AS (SELECT 'src' || user_id % 20 AS project, event_type AS holder, ts FROM events),
n AS (SELECT project, holder, max(ts + CASE WHEN holder = 'click' THEN INTERVAL 6 HOUR ELSE INTERVAL 9 HOUR END) AS expires_at FROM e WHERE holder NOT IN ('error', 'signup') GROUP BY ALL),
u AS (SELECT DISTINCT project FROM e WHERE holder = 'error' AND ts >= TIMESTAMP '2024-01-30 12:00:00')
SELECT project, holder, epoch_us(expires_at) AS expires_us FROM n WHERE expires_at > TIMESTAMP '2024-01-30 20:00:00' AND NOT (holder = 'view' AND project IN (SELECT project FROM u))
""")
def live_leases(spark, sf_dir):
    """Pins by clicks (six hours), then by views and purchases (nine); late errors release their project's views; what has not ended in the evening of the last day."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("project"), F.col("event_type").alias("holder"), F.col("ts").cast("timestamp").alias("ts"))
    pins = lambda kinds, span: e.filter(F.col("holder").isin(*kinds)).select("project", "holder", (F.col("ts") + F.expr(f"INTERVAL {span} HOURS")).alias("expires_at"))
    held = catalog.pin(pins(["click"], 6), pins(["view", "purchase"], 9))
    released = e.filter((F.col("holder") == "error") & (F.col("ts") >= F.lit("2024-01-30 12:00:00").cast("timestamp"))).select("project", F.lit("view").alias("holder"))
    live = catalog.unexpired(catalog.unpin(held, released), F.lit("2024-01-30 20:00:00").cast("timestamp"))
    return live.select("project", "holder", F.unix_micros("expires_at").alias("expires_us"))


@query("""
WITH d AS (SELECT doc_id, source AS project, source || '/' || doc_id || '.md' AS rel_path, sha256(text) AS content_hash FROM documents WHERE source IS DISTINCT FROM 'src9')
SELECT doc_id, project, rel_path, CASE WHEN project = 'src3' THEN sha256('anew ' || content_hash) ELSE content_hash END AS content_hash FROM d WHERE project IS DISTINCT FROM 'src7'
UNION ALL SELECT -doc_id, project, 'new/' || rel_path, content_hash FROM d WHERE project = 'src2'
""")
def upserted_documents(spark, sf_dir):
    """The catalog after one source's documents came anew, another's came under new paths too, and two sources were deleted."""
    d = docs(spark, sf_dir).select("doc_id", "project", "rel_path", "content_hash")
    anew = d.filter("project = 'src3'").withColumn("content_hash", F.sha2(F.concat(F.lit("anew "), "content_hash"), 256))
    more = d.filter("project = 'src2'").withColumns({"doc_id": -F.col("doc_id"), "rel_path": F.concat(F.lit("new/"), "rel_path")})
    return catalog.delete_project(catalog.delete_project(catalog.upsert_documents(d, anew.unionByName(more)), "src7"), "src9")


@query("WITH p AS (SELECT p_brand, p_partkey, p_size, p_retailprice, length(p_name) AS words FROM part) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.p_brand = p.p_brand AND o.p_size >= p.p_size AND o.p_retailprice <= p.p_retailprice AND o.words <= p.words AND (o.p_size > p.p_size OR o.p_retailprice < p.p_retailprice OR o.words < p.words))")
def skyline(spark, sf_dir):
    """Parts of each brand that none beats in size, price and length of name."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice", F.length("p_name").cast("long").alias("words"))
    return evaluate.skyline(rows, "p_size", "p_retailprice", "words", "p_brand")


@query(r"WITH b AS (SELECT item_id AS id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM benchmark), d AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents), x AS (SELECT b.id AS left_id, d.id AS right_id, CASE WHEN len(b.w) + len(d.w) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(b.w, d.w)) / (len(b.w) + len(d.w) - len(list_intersect(b.w, d.w))) END AS s FROM b JOIN d ON len(d.w) >= 0.3 * len(b.w) AND len(b.w) >= 0.3 * len(d.w)) SELECT left_id, right_id, round(s, 6) AS similarity FROM x WHERE s >= 0.3")
def jaccard_pairs(spark, sf_dir):
    """Items and documents whose token sets are alike by 0.3 or more; two sets without tokens are alike by 1."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), T.simple_tokens("text").alias("tokens"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.simple_tokens("text").alias("tokens"))
    return evaluate.jaccard(b, d, 0.3)


# --- change events

_DEBOUNCE = """
WITH RECURSIVE e AS (
  SELECT CAST(user_id AS VARCHAR) AS key, event_type AS path, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS i FROM events
), r AS (
  SELECT key, path, ts, i, ts AS opened, CAST(1 AS BIGINT) AS batch FROM e WHERE i = 1
  UNION ALL
  SELECT e.key, e.path, e.ts, e.i,
    CASE WHEN e.ts - r.ts > INTERVAL 6 HOUR OR e.ts - r.opened > INTERVAL 12 HOUR THEN e.ts ELSE r.opened END,
    r.batch + CASE WHEN e.ts - r.ts > INTERVAL 6 HOUR OR e.ts - r.opened > INTERVAL 12 HOUR THEN 1 ELSE 0 END
  FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1
)
SELECT key, batch, min(ts) AS opened, max(ts) AS closed, count(*) AS events, count(DISTINCT path) AS paths FROM r GROUP BY 1, 2
"""


@query(_DEBOUNCE)
def debounce_sessions(spark, sf_dir):
    """Debounced batches of each user's events, with the gap and the longest span scaled to the table's times."""
    return debounce.batches(debounce.session_events(table(spark, sf_dir, "events")), 6 * 3600, 12 * 3600)
