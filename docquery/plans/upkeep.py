"""Queries of status, guards and upkeep over the given tables: sources are projects, documents their files, events their jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquery.functions import text as T
from docquery.operators import dense, ranking, upkeep
from docquery.plans.registry import query
from docquery.sources.tables import chunks, docs, table

_D = "d AS (SELECT doc_id, source || '/' || doc_id || '.md' AS rel_path, source AS project, lang, source, text, strlen(text) AS size FROM documents)"
_P = "p AS (SELECT project, CASE max(doc_id) % 4 WHEN 0 THEN 'indexing' WHEN 1 THEN 'error' ELSE 'indexed' END AS status, count(*) AS generation, CASE WHEN max(doc_id) % 3 = 0 THEN 1 ELSE 2 END AS schema_version, max(doc_id) AS attempt FROM d GROUP BY 1)"
_STATS = "'{\"warnings\": [\"' || event_type || '\"], \"error\": \"' || round(value, 2) || '\", \"errors\": ' || user_id % 3 || '}'"
_J = f"j AS (SELECT 'src' || user_id % 20 AS project, event_id AS job_id, CASE event_type WHEN 'click' THEN 'running' WHEN 'error' THEN 'error' ELSE 'done' END AS state, value, event_type, user_id FROM events)"


def _projects(spark, sf_dir):
    top = F.max("doc_id")
    status = F.when(top % 4 == 0, "indexing").when(top % 4 == 1, "error").otherwise("indexed")
    return docs(spark, sf_dir).groupBy("project").agg(status.alias("status"), F.count("*").alias("generation"), F.when(top % 3 == 0, 1).otherwise(2).alias("schema_version"), top.alias("attempt"))


def _jobs(spark, sf_dir):
    state = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "error").otherwise("done")
    stats = F.to_json(F.struct(F.array("event_type").alias("warnings"), F.round("value", 2).cast("string").alias("error"), (F.col("user_id") % 3).alias("errors")))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("project"), F.col("event_id").alias("job_id"), state.alias("state"), stats.alias("stats"))


@query(f"WITH {_D}, {_P}, {_J}, n AS (SELECT project, CAST(count(*) AS BIGINT) AS chunks FROM d JOIN conversations ON conv_id = doc_id GROUP BY 1), w AS (SELECT project, arg_max(event_type, job_id) AS warning, arg_max(round(value, 2), job_id) AS error FROM j GROUP BY 1) SELECT project, status, generation, generation AS docs, coalesce(chunks, 0) AS chunks, coalesce(warning, '') AS warnings, CAST(error AS DOUBLE) AS last_error FROM p LEFT JOIN n USING (project) LEFT JOIN w USING (project)")
def status_entries(spark, sf_dir):
    out = upkeep.status(_projects(spark, sf_dir), docs(spark, sf_dir), chunks(spark, sf_dir), _jobs(spark, sf_dir))
    return out.withColumn("warnings", F.array_join("warnings", ",")).withColumn("last_error", F.col("last_error").cast("double"))


@query(f"WITH {_D}, {_P} SELECT project, CASE WHEN status <> 'indexed' THEN 'not indexed: ' || status WHEN schema_version <> 2 THEN 'rebuild' END AS refused FROM p")
def index_admission(spark, sf_dir):
    return upkeep.admission(_projects(spark, sf_dir), 2)


@query(f"WITH {_D}, {_P}, {_J}, l AS (SELECT project, arg_max(state, job_id) AS job_state, arg_max(user_id % 3, job_id) AS errors, max(job_id) % 7 = 0 AS interrupted FROM j GROUP BY 1) SELECT project, CASE WHEN coalesce(job_state, '') = 'running' OR status = 'indexing' THEN 'indexing' WHEN coalesce(interrupted, false) THEN 'interrupted' WHEN status = 'error' THEN 'failed' WHEN errors > 1 THEN 'partial' WHEN job_state = 'error' OR errors = 1 THEN 'sync-failed' WHEN generation % 5 = 0 THEN 'rebuild-required' WHEN schema_version <> 2 THEN 'rebuild-required' WHEN errors IS NULL THEN 'unknown-outcome' WHEN attempt % 2 = 1 THEN 'incomplete-scope' END AS reason FROM p LEFT JOIN l USING (project)")
def readiness(spark, sf_dir):
    newest = _jobs(spark, sf_dir).groupBy("project").agg(F.max(F.struct("job_id", "state", "stats")).alias("j"))
    newest = newest.select("project", F.col("j.state").alias("job_state"), F.from_json("j.stats", upkeep.STATS).alias("s"), (F.col("j.job_id") % 7 == 0).alias("interrupted"))
    states = _projects(spark, sf_dir).join(newest, "project", "left").select(
        "project", (F.coalesce("job_state", F.lit("")) == "running").alias("active"), "status", F.coalesce("interrupted", F.lit(False)).alias("interrupted"), F.when(F.col("s.errors") != 1, F.when(F.col("s.errors") > 1, 1).otherwise(0)).alias("outcome_errors"),
        "job_state", F.coalesce(F.col("s.errors") == 1, F.lit(False)).alias("job_partial"), F.when(F.col("generation") % 5 == 0, "rebuild").otherwise("healthy").alias("health"), "schema_version",
        F.when(F.col("attempt") % 2 == 1, "paths").otherwise("full").alias("scope"), F.lit("r").alias("recipe_id"), F.lit(True).alias("attributable"),
    )
    return upkeep.readiness(states, 2, "r")


@query(f"WITH {_D}, {_P}, x AS (SELECT *, CASE WHEN attempt % 5 = 0 THEN attempt + 1 ELSE attempt END AS a, generation % 3 AS errors, attempt % 2 AS part, attempt % 7 = 0 AS broken FROM p), w AS (SELECT DISTINCT project FROM d WHERE size = 0), g AS (SELECT *, status = 'indexed' AND schema_version = 2 AND attempt > 0 AND a = attempt AND NOT broken AND project NOT IN (SELECT project FROM w) AS good FROM x) SELECT project, CASE WHEN good THEN CASE part WHEN 1 THEN 'paths' ELSE 'full' END END AS scope, CASE WHEN good THEN errors END AS errors, CASE WHEN good THEN part = 0 AND errors = 0 END AS complete FROM g")
def outcome_evidence(spark, sf_dir):
    p = _projects(spark, sf_dir).withColumn("root", F.col("project"))
    attempt = F.when(F.col("attempt") % 5 == 0, F.col("attempt") + 1).otherwise(F.col("attempt"))
    record = F.to_json(F.struct(attempt.alias("attempt"), "generation", "root", F.when(F.col("attempt") % 2 == 1, "paths").otherwise("full").alias("scope"), (F.col("generation") % 3).alias("errors"), F.array().cast("array<string>").alias("warnings")))
    p = p.withColumn("outcome", F.when(F.col("attempt") % 7 == 0, F.lit("{not json")).otherwise(record))
    return upkeep.outcomes(p, docs(spark, sf_dir).filter("size = 0").select("project"), 2)


@query("SELECT doc_id, sha256(concat_ws('', strlen(lang) || ':' || lang, strlen(source) || ':' || source, strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars)) AS recipe FROM documents WHERE lang IS NOT NULL")
def recipe_identity(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("lang IS NOT NULL").select("doc_id", upkeep.recipe_id([F.col("lang"), F.col("source"), F.col("n_chars")]).alias("recipe"))


@query(f"WITH {_J} SELECT job_id, project, state, user_id % 3 AS errors, 1 AS warnings FROM j")
def sync_status(spark, sf_dir):
    return upkeep.job_status(_jobs(spark, sf_dir))


@query("WITH u AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages WHERE url IS NOT NULL), r AS (SELECT DISTINCT regexp_extract(path, '^[^/]*') AS root FROM u UNION SELECT DISTINCT regexp_extract(path, '^[^/]*/[^/]*') FROM u WHERE length(path) % 2 = 0) SELECT path, arg_max(root, length(root)) AS project FROM (SELECT path, root FROM u LEFT JOIN r ON path = root OR starts_with(path, root || '/')) GROUP BY 1")
def closest_projects(spark, sf_dir):
    """Paths of page URLs under the roots that their hosts and some first folders are."""
    u = table(spark, sf_dir, "pages").filter("url IS NOT NULL").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).distinct()
    deep = u.filter(F.length("path") % 2 == 0).select(F.regexp_extract("path", "^[^/]*/[^/]*", 0).alias("root"))
    roots = u.select(F.regexp_extract("path", "^[^/]*", 0).alias("root")).union(deep).distinct()
    return upkeep.closest_project(u, roots.withColumn("project", F.col("root")))


@query("SELECT count(*) AS entries, CAST(coalesce(sum(strlen(props)), 0) AS BIGINT) AS bytes FROM events")
def cache_size(spark, sf_dir):
    return upkeep.cache_size(table(spark, sf_dir, "events").select(F.octet_length("props").alias("bytes")))


_WORD = "CAST(sum(CAST('0x' || substr(h, {i}, 8) AS BIGINT)) % 4294967296 AS BIGINT)"


@query(f"SELECT source AS project, sha256(count(*) || ':' || {" || ':' || ".join(_WORD.format(i=1 + 8 * i) for i in range(4))}) AS digest FROM (SELECT source, sha256(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(sha256(text), '')) AS h FROM documents) GROUP BY 1")
def set_digests(spark, sf_dir):
    return upkeep.set_digest(docs(spark, sf_dir), "project", "doc_id", "content_hash")


@query(f"WITH {_D}, {_P} SELECT project, status FROM p WHERE project NOT IN (SELECT project FROM d WHERE lang IS NULL OR size = 0)")
def searchable_projects(spark, sf_dir):
    """Documents without a language or text are still pending."""
    d = docs(spark, sf_dir)
    pending = upkeep.mark_pending(d, d.filter("lang IS NULL OR size = 0"))
    return upkeep.searchable(_projects(spark, sf_dir), pending).select("project", "status")


@query(f"WITH {_D} SELECT doc_id, rel_path, size FROM d WHERE project = 'src3'")
def project_isolation(spark, sf_dir):
    return upkeep.of_project(docs(spark, sf_dir), "src3").select("doc_id", "rel_path", F.col("size").cast("long").alias("size"))


@query(f"WITH {_D} SELECT conv_id AS doc_id, turn AS seq, rel_path FROM conversations JOIN d ON doc_id = conv_id WHERE starts_with(rel_path, 'src1') AND lang = 'en'")
def post_filter(spark, sf_dir):
    hits = chunks(spark, sf_dir).select("doc_id", "seq")
    return upkeep.still_there(hits, docs(spark, sf_dir), "src1", ["en"])


@query("SELECT conv_id AS doc_id, turn AS seq FROM conversations WHERE (conv_id, turn) > (3, 1) ORDER BY 1, 2 LIMIT 400")
def keyset_chunks(spark, sf_dir):
    c = chunks(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"))
    return upkeep.keyset_page(c, (3, 1))


@query(f"WITH {_D}, g AS (SELECT rel_path FROM d WHERE rel_path > 'src1' ORDER BY 1 LIMIT 51), n AS (SELECT rel_path, row_number() OVER (ORDER BY rel_path) AS nth, count(*) OVER () AS n FROM g) SELECT rel_path, CASE WHEN n > 50 THEN (SELECT max(rel_path) FROM n WHERE nth <= 50) END AS next_cursor FROM n WHERE nth <= 50")
def docs_page_cursor(spark, sf_dir):
    return upkeep.page_and_next(docs(spark, sf_dir), "src1", 50)


@query(f"WITH {_D}, gone AS (SELECT DISTINCT source || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '/' || doc_id || '.md' END AS path FROM d WHERE lang = 'de' AND (doc_id % 2 = 1 OR source = 'src2')) SELECT rel_path FROM d WHERE EXISTS (SELECT 1 FROM gone WHERE rel_path = path OR starts_with(rel_path, path || '/')) AND doc_id % 9 <> 0")
def incremental_removals(spark, sf_dir):
    """Files of one language and one whole folder go, some of which are there again."""
    d = docs(spark, sf_dir)
    gone = d.filter("lang = 'de' AND (doc_id % 2 = 1 OR source = 'src2')").select(F.concat("source", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")))).alias("path"))
    return upkeep.removals(d, gone, d.filter("doc_id % 9 = 0"))


@query(f"WITH {_D}, b AS (SELECT DISTINCT lang AS key, source || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '/' || doc_id || '.md' END AS path FROM d WHERE lang IS NOT NULL), here AS (SELECT rel_path FROM d WHERE doc_id % 3 <> 0), f AS (SELECT key, path, rel_path FROM b JOIN here ON rel_path = path OR starts_with(rel_path, path || '/')) SELECT DISTINCT key, rel_path, false AS purge FROM f UNION ALL SELECT key, path, true FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.key = b.key AND f.path = b.path)")
def finalized_batches(spark, sf_dir):
    """Batches by language that name files and folders, of which a third of the files are gone."""
    d = docs(spark, sf_dir)
    path = F.concat("source", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))))
    return upkeep.finalize(d.filter("lang IS NOT NULL").select(F.col("lang").alias("key"), path.alias("path")), d.filter("doc_id % 3 <> 0"))


@query(f"WITH {_D} SELECT rel_path, 'whole' AS walk FROM d WHERE doc_id % 4 = 1")
def survey_removals(spark, sf_dir):
    """A walk that missed every fourth document, and one that missed as many but had errors, which removes none."""
    d = docs(spark, sf_dir)
    walked = d.filter("doc_id % 4 <> 1")
    whole, failed = upkeep.survey_removals(d, walked, d.filter("doc_id < 0")), upkeep.survey_removals(d, walked, d.filter("size > 0"))
    return whole.withColumn("walk", F.lit("whole")).unionByName(failed.withColumn("walk", F.lit("failed")))


@query(f"WITH {_D}, s AS (SELECT * FROM d WHERE doc_id % 3 = 0), k AS (SELECT project, count(*) AS kept FROM s WHERE doc_id % 2 = 0 GROUP BY 1), n AS (SELECT project, rel_path, row_number() OVER (PARTITION BY project ORDER BY rel_path) AS nth FROM d WHERE doc_id % 3 <> 0) SELECT project, rel_path, CASE WHEN nth + coalesce(kept, 0) > 20 THEN 'over the document budget' END AS warning FROM n LEFT JOIN k USING (project)")
def document_budget(spark, sf_dir):
    d = docs(spark, sf_dir).select("project", "rel_path", "doc_id")
    stored = d.filter("doc_id % 3 = 0")
    return upkeep.admitted(d.filter("doc_id % 3 <> 0").drop("doc_id"), stored, stored.filter("doc_id % 2 = 1"), 20)


@query("WITH w AS (SELECT user_id AS project, event_id AS nth, event_type AS warning FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY nth) AS rank FROM w) SELECT project, count(*) AS errors, string_agg(warning, ',' ORDER BY nth) FILTER (rank <= 100) AS warnings FROM r GROUP BY 1")
def capped_warnings(spark, sf_dir):
    w = table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), F.col("event_id").alias("nth"), F.col("event_type").alias("warning"))
    return upkeep.capped_warnings(w, "project").withColumn("warnings", F.array_join("warnings", ","))


@query("SELECT conv_id AS doc_id, turn AS seq, role AS heading_path, CASE WHEN role = 'user' AND conv_id % 2 = 0 THEN text || '!' ELSE text END AS text FROM conversations WHERE conv_id % 2 = 1 OR role = 'user'")
def replaced_chunks(spark, sf_dir):
    """Conversations of even ids are chunked anew, to their user turns with a mark."""
    c = chunks(spark, sf_dir)
    return upkeep.replace_chunks(c, c.filter("doc_id % 2 = 0 AND heading_path = 'user'").withColumn("text", F.concat("text", F.lit("!"))))


@query("SELECT doc_id, (SELECT count(*) FROM conversations WHERE conv_id = doc_id) AS chunks FROM documents WHERE lang <> 'en' OR lang IS NULL")
def deleted_docs(spark, sf_dir):
    d = docs(spark, sf_dir)
    left, c = upkeep.delete_docs(d, chunks(spark, sf_dir), d.filter("lang = 'en'"))
    return left.select("doc_id").join(c.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("chunks"))


@query(f"WITH {_J}, a AS (SELECT DISTINCT project FROM j WHERE state = 'running' AND value > 150) SELECT project, min(job_id) AS job_id, 'queued' AS state FROM j WHERE state = 'done' AND project NOT IN (SELECT project FROM a) GROUP BY 1")
def started_jobs(spark, sf_dir):
    j = _jobs(spark, sf_dir).withColumn("value", F.from_json("stats", upkeep.STATS)["error"].cast("double"))
    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("value").alias("exact"))
    j = j.join(raw, "job_id")
    return upkeep.start_jobs(j.filter("state = 'running' AND exact > 150"), j.filter("state = 'done'"))


@query("SELECT 'src' || user_id % 20 AS project, max(event_id) AS job_id, 'error' AS state, count(*) AS lost FROM events WHERE event_type = 'error' GROUP BY 1")
def failed_batches(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    rows = e.groupBy(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("project")).agg(F.max("event_id").alias("job_id"), F.collect_list("props").alias("paths"), F.lit("gone").alias("message"))
    return upkeep.failed_batches(rows).select("project", "job_id", "state", F.from_json("stats", upkeep.STATS)["errors"].alias("lost"))


@query("WITH v AS (SELECT label AS model_id, CAST(vec_id % 50 AS VARCHAR) AS chunk_hash, vec_id AS nth, embedding FROM embeddings WHERE len(embedding) > 0) SELECT model_id, chunk_hash, max(nth) AS nth, CAST(len(arg_max(embedding, nth)) AS INTEGER) AS dim FROM v GROUP BY 1, 2")
def put_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("model_id"), (F.col("vec_id") % 50).cast("string").alias("chunk_hash"), F.col("vec_id").alias("nth"), F.col("embedding").alias("vector"))
    out = upkeep.put_vectors(v.filter("nth % 2 = 0"), v.filter("nth % 2 = 1"))
    return out.select("model_id", "chunk_hash", "nth", F.size("vector").alias("dim"))


_BATCHES = """
WITH RECURSIVE t AS (SELECT source AS project, doc_id AS seq, strlen(text) AS bytes, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
r AS (
  SELECT project, seq, i, 0::BIGINT AS batch, 1::BIGINT AS n, CAST(bytes AS BIGINT) AS size FROM t WHERE i = 1
  UNION ALL
  SELECT t.project, t.seq, t.i, r.batch + CASE WHEN r.n >= 8 OR r.size + bytes > 20000 THEN 1 ELSE 0 END, CASE WHEN r.n >= 8 OR r.size + bytes > 20000 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 8 OR r.size + bytes > 20000 THEN bytes ELSE r.size + bytes END
  FROM r JOIN t ON t.project = r.project AND t.i = r.i + 1
)
SELECT project, seq, batch FROM r
"""


@query(_BATCHES)
def embedding_batches(spark, sf_dir):
    d = docs(spark, sf_dir).select("project", F.col("doc_id").alias("seq"), F.coalesce("size", F.lit(0)).cast("long").alias("bytes"))
    return upkeep.embedding_batches(d, 8, 20_000)


@query("SELECT query_id, CAST(sum(n) AS BIGINT) AS capacity FROM (SELECT user_id AS query_id, event_type, least(count(*), 2) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def capped_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("doc_id"))
    return ranking.capped_count(e, 2)


@query("SELECT doc_id, strlen(text) AS first, length(text) AS second FROM documents WHERE text IS NOT NULL")
def embed_fan_out(spark, sf_dir):
    """Distinct texts embedded by their lengths; every document gets the vector of its text."""
    d = docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", "text")
    none = spark.createDataFrame([], "chunk_hash string, vector array<float>")
    out = dense.embed_all(d, none, lambda texts: [[float(len(t.encode())), float(len(t))] for t in texts], 2)
    return out.select("doc_id", F.col("vector")[0].cast("long").alias("first"), F.col("vector")[1].cast("long").alias("second"))


@query("SELECT doc_id, CASE WHEN lang IS NOT NULL THEN sha256('{\"title\":\"' || source || '\",\"tags\":[\"' || lang || '\"]}') END AS metadata FROM documents")
def metadata_json(spark, sf_dir):
    front = docs(spark, sf_dir).select("doc_id", F.when(F.col("lang").isNotNull(), F.col("source")).alias("title"), F.array_compact(F.array("lang")).alias("tags"))
    return upkeep.metadata_json(front).select("doc_id", F.sha2("metadata", 256).alias("metadata"))


@query(f"WITH {_D} SELECT rel_path AS path, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'not listed' ELSE 'changed' END AS problem FROM d WHERE doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0 AND size > 0")
def manifest_problems(spark, sf_dir):
    """A manifest of the documents that lacks some, against a copy that lacks others and changes a few."""
    d = docs(spark, sf_dir).select("doc_id", F.col("rel_path").alias("path"), F.col("content_hash").alias("hash"), "text", "size").filter("NOT (doc_id % 11 = 0 AND doc_id % 13 = 0) OR true")
    listed = d.filter("doc_id % 13 <> 0 OR doc_id % 11 = 0")
    there = d.filter("doc_id % 11 <> 0").withColumn("hash", F.when((F.col("doc_id") % 17 == 0) & (F.col("size") > 0), F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("hash")))
    return upkeep.manifest_problems(listed, there)


@query("SELECT c.conv_id AS doc_id, turn AS seq, len(embedding) AS dim FROM conversations c LEFT JOIN (SELECT vec_id, any_value(embedding) AS embedding FROM embeddings GROUP BY 1) ON vec_id = conv_id")
def vector_page(spark, sf_dir):
    c = chunks(spark, sf_dir).select("doc_id", "seq", F.col("doc_id").alias("chunk_hash"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_hash"), "embedding").dropDuplicates(["chunk_hash"])
    return upkeep.vector_page(c, v).select("doc_id", "seq", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("dim"))


def _runs_sql() -> str:
    """Letters become the number of their script, those of other scripts and all else go, and equal neighbours are one."""
    out = r"regexp_replace(regexp_replace(s, '[^\p{L}]', '', 'g'), '[A-Za-zªµºÀ-ɏḀ-ỿ]+', '0', 'g')"
    for i, letters in enumerate(("Ѐ-ԯ", "ᄀ-ᇿ\u3040-ヿ㐀-䶿一-鿿가-\ud7afｦ-ﾟ", "\u0600-ۿݐ-ݿ"), 1):
        out = f"regexp_replace({out}, '[{letters}]+', '{i}', 'g')"
    out = f"regexp_replace({out}, '[^0-3]', '', 'g')"
    for i in range(4):
        out = f"regexp_replace({out}, '{i}+', '{i}', 'g')"
    return f"SELECT doc_id, len(regexp_extract_all(s, '[A-Za-zªµºÀ-ÖØ-öø-ɏḀ-ỿ]')) > 0 AS latin, CAST(greatest(1, length({out})) AS INTEGER) AS runs FROM (SELECT doc_id, text || CASE lang WHEN 'en' THEN ' привет abc' WHEN 'de' THEN '12 文書 العربية' ELSE '' END AS s FROM documents)"


@query(_runs_sql())
def script_runs(spark, sf_dir):
    """Runs of one script in every text; those of two languages end with words of other scripts."""
    end = F.when(F.col("lang") == "en", " привет abc").when(F.col("lang") == "de", "12 文書 العربية").otherwise("")
    d = docs(spark, sf_dir).select("doc_id", F.concat("text", end).alias("text"))
    return d.select("doc_id", F.col("text").rlike(T.SCRIPTS["latin"]).alias("latin"), F.size(T.script_runs("text")).alias("runs"))
