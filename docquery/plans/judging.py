"""Queries of the judging operators over the given tables: sources are cases, documents their citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.operators import judge
from docquery.plans.registry import query
from docquery.sources.tables import table

#: How each configuration orders the documents of a source.
_ORDERS = {"bm25": "n_chars DESC, doc_id", "bm25_rerank": "doc_id", "rrf": "n_chars, doc_id"}
K = 10


def _hits(spark, sf_dir, config: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rank = F.expr(f"row_number() OVER (PARTITION BY source ORDER BY {_ORDERS[config]})")
    return d.select(F.col("source").alias("case_id"), rank.alias("rank"), F.concat("lang", F.lit("/"), (F.col("doc_id") % 7).cast("string")).alias("path"), (F.col("doc_id") % 40).alias("start"), (F.col("doc_id") % 40 + 10).alias("stop"))


def _judged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    path = F.concat("lang", F.lit("/"), (F.col("doc_id") % 7).cast("string"))
    whole = F.col("doc_id") % 3 == 0
    low, high = F.when(~whole, F.col("doc_id") % 40 + 5), F.when(~whole, F.col("doc_id") % 40 + 8)
    rows = d.select(F.col("source").alias("case_id"), F.col("doc_id").alias("nth"), path.alias("path"), low.alias("low"), high.alias("high"), (F.col("quality") + F.col("doc_id") % 2).alias("grade"), "quality", "toxic").filter("path IS NOT NULL")
    return rows.filter("quality = 1").drop("quality", "toxic"), rows.filter("toxic = 1").select("case_id", "path", "low", "high")


def _report(spark, sf_dir, config: str) -> DataFrame:
    hits = _hits(spark, sf_dir, config)
    metrics = judge.cited_metrics(hits, *_judged(spark, sf_dir), K)
    returned = hits.filter(F.col("rank") <= K).groupBy("case_id").agg(F.count("*").alias("returned"))
    return metrics.join(returned, "case_id", "left").select(F.lit(config).alias("config"), F.expr("right(case_id, 1)").alias("slice"), *metrics.columns, F.coalesce("returned", F.lit(0)).alias("returned"))


_JUDGED = """
j AS (SELECT source AS case_id, doc_id AS nth, lang || '/' || doc_id % 7 AS path, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 40 + 5 END AS low, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 40 + 8 END AS high, quality + doc_id % 2 AS grade, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL),
e AS (SELECT * FROM j WHERE quality = 1), ab AS (SELECT * FROM j WHERE toxic = 1)
"""
_HITS = "SELECT '{config}' AS config, source AS case_id, row_number() OVER (PARTITION BY source ORDER BY {order}) AS rank, lang || '/' || doc_id % 7 AS path, doc_id % 40 AS start, doc_id % 40 + 10 AS stop FROM documents"
_ALL_HITS = " UNION ALL ".join(_HITS.format(config=c, order=o) for c, o in _ORDERS.items())
# the greedy matching, hit after hit: what was taken before is carried along
_REPORTS = f"""
WITH RECURSIVE {_JUDGED}, h AS ({_ALL_HITS}), sh AS (SELECT * FROM h WHERE rank <= {K}),
o AS (SELECT config, sh.case_id, rank, list(nth ORDER BY nth) AS offers FROM sh JOIN e ON e.case_id = sh.case_id AND e.path = sh.path AND (low IS NULL OR greatest(low, start) <= least(high, stop)) GROUP BY 1, 2, 3),
steps AS (SELECT DISTINCT config, case_id FROM h),
m AS (
  SELECT config, case_id, 0::BIGINT AS rank, []::BIGINT[] AS taken, []::BIGINT[] AS ranks FROM steps
  UNION ALL
  SELECT m.config, m.case_id, m.rank + 1,
    CASE WHEN len(list_filter(coalesce(o.offers, []), lambda x: NOT list_contains(m.taken, x))) = 0 THEN m.taken ELSE list_append(m.taken, list_filter(o.offers, lambda x: NOT list_contains(m.taken, x))[1]) END,
    CASE WHEN len(list_filter(coalesce(o.offers, []), lambda x: NOT list_contains(m.taken, x))) = 0 THEN m.ranks ELSE list_append(m.ranks, m.rank + 1) END
  FROM m LEFT JOIN o ON o.config = m.config AND o.case_id = m.case_id AND o.rank = m.rank + 1 WHERE m.rank < {K}
),
tk AS (SELECT config, case_id, unnest(taken) AS nth, unnest(ranks) AS rank FROM m WHERE rank = {K}),
f AS (SELECT config, tk.case_id, sum(CASE WHEN rank <= 20 THEN (2.0 ** grade - 1) / log2(rank + 1) ELSE 0 END) AS dcg, count(*) AS found, min(rank) FILTER (grade >= 1) AS first FROM tk JOIN e ON e.case_id = tk.case_id AND e.nth = tk.nth GROUP BY 1, 2),
i AS (SELECT case_id, count(*) AS wanted, sum(CASE WHEN r <= 20 THEN (2.0 ** grade - 1) / log2(r + 1) ELSE 0 END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, nth) AS r FROM e) GROUP BY 1),
ov AS (SELECT config, case_id, count(*) AS overlap FROM o GROUP BY 1, 2),
tr AS (SELECT DISTINCT config, sh.case_id, true AS trap FROM sh JOIN ab ON ab.case_id = sh.case_id AND ab.path = sh.path AND (low IS NULL OR greatest(low, start) <= least(high, stop)) WHERE rank = 1),
rt AS (SELECT config, case_id, count(*) AS returned, count(DISTINCT path) AS paths FROM sh GROUP BY 1, 2),
reports AS (SELECT config, right(case_id, 1) AS slice, case_id, first IS NOT NULL AS hit, round(CASE WHEN coalesce(wanted, 0) = 0 THEN 1.0 ELSE coalesce(found, 0) / wanted END, 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS mrr,
  round(CASE WHEN coalesce(idcg, 0) = 0 THEN 1.0 ELSE coalesce(dcg, 0) / idcg END, 6) AS ndcg, round(coalesce(overlap, 0) / returned, 6) AS citation_overlap, coalesce(trap, false) AS forbidden_hit, round((returned - paths) / returned, 6) AS duplicate_path_ratio, returned
  FROM steps LEFT JOIN f USING (config, case_id) LEFT JOIN i USING (case_id) LEFT JOIN ov USING (config, case_id) LEFT JOIN tr USING (config, case_id) LEFT JOIN rt USING (config, case_id))
"""


def _reports(spark, sf_dir, configs=tuple(_ORDERS)) -> DataFrame:
    return reduce(DataFrame.union, [_report(spark, sf_dir, c) for c in configs])


@query(_REPORTS + "SELECT * FROM reports")
def cited_reports(spark, sf_dir):
    """Every metric of every case under three orders of its documents."""
    return _reports(spark, sf_dir)


@query(_REPORTS + "SELECT config, slice, count(*) AS cases, round(avg(CAST(hit AS INTEGER)), 6) AS hit_rate, round(avg(CAST(forbidden_hit AS INTEGER)), 6) AS forbidden_rate, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM reports GROUP BY 1, 2")
def slice_averages(spark, sf_dir):
    return judge.slice_reports(_reports(spark, sf_dir))


def _versus(spark, sf_dir):
    """bm25's report as the base, and the order of doc_id as the current one of the same configuration."""
    return _report(spark, sf_dir, "bm25"), _report(spark, sf_dir, "bm25_rerank").withColumn("config", F.lit("bm25"))


_GATES = _REPORTS + """, b AS (SELECT * FROM reports WHERE config = 'bm25'), c AS (SELECT * FROM reports WHERE config = 'bm25_rerank'), x AS (SELECT c.*, b.hit AS b_hit, b.ndcg AS b_ndcg FROM b JOIN c USING (case_id)),
bs AS (SELECT slice, round(avg(CAST(hit AS INTEGER)), 6) AS h, round(avg(ndcg), 6) AS n FROM b GROUP BY 1), cs AS (SELECT slice, round(avg(CAST(hit AS INTEGER)), 6) AS h, round(avg(ndcg), 6) AS n FROM c GROUP BY 1)
SELECT 'bm25' AS config, slice, case_id, 'ForbiddenHit' AS kind FROM x WHERE forbidden_hit
UNION ALL SELECT 'bm25', slice, case_id, 'HitDrop' FROM x WHERE b_hit AND NOT hit
UNION ALL SELECT 'bm25', slice, case_id, 'NdcgDrop' FROM x WHERE b_ndcg - ndcg > 0.02 + 1e-9
UNION ALL SELECT 'bm25', slice, NULL, 'SliceHitRateDrop' FROM bs JOIN cs USING (slice) WHERE bs.h - cs.h > 1e-9
UNION ALL SELECT 'bm25', slice, NULL, 'SliceNdcgDrop' FROM bs JOIN cs USING (slice) WHERE bs.n - cs.n > 0.02 + 1e-9
"""


@query(_GATES)
def gate_failures(spark, sf_dir):
    return judge.regressions(*_versus(spark, sf_dir))


@query(_REPORTS + "SELECT b.slice, case_id, b.ndcg AS a, c.ndcg AS b FROM reports b JOIN reports c USING (case_id) WHERE b.config = 'bm25' AND c.config = 'bm25_rerank'")
def paired_lists(spark, sf_dir):
    return judge.paired(*_versus(spark, sf_dir))


@query()
def bootstrap_intervals(spark, sf_dir):
    return judge.bootstrap(judge.paired(*_versus(spark, sf_dir)))


@query("WITH b AS (SELECT event_type, quantile_cont(value, 0.95) AS p FROM events WHERE event_id % 2 = 0 GROUP BY 1), c AS (SELECT event_type, quantile_cont(value, 0.95) AS p FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT event_type, round(b.p, 6) AS base_p95, round(c.p, 6) AS p95, round(least(b.p * 1.5 + 5, 500), 6) AS allowed, c.p <= least(b.p * 1.5 + 5, 500) AS ok FROM b JOIN c USING (event_type)")
def latency_gate(spark, sf_dir):
    """Values of events as latencies: those of even ids are the base, of odd ids the current run."""
    e = table(spark, sf_dir, "events").withColumn("ms", F.col("value"))
    return judge.latency_gate(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "event_type")


@query(_REPORTS + ", c AS (SELECT slice, case_id, min(CAST(hit AS INTEGER)) AS low, max(CAST(hit AS INTEGER)) AS high, bool_or(hit) FILTER (config = 'bm25') AS p, bool_or(hit) FILTER (config = 'bm25_rerank') AS q FROM reports GROUP BY 1, 2) SELECT slice, count(*) AS cases, count(*) FILTER (low = 1) AS saturated, count(*) FILTER (low = 0) AS non_saturated, count(*) FILTER (low <> high) AS disagreements, count(*) FILTER (p <> q) AS rerank_disagreements, count(*) FILTER (low = 1) <= 0.70 * count(*) AND count(*) FILTER (low <> high) >= 3 AND count(*) FILTER (p <> q) >= 1 AS discriminates FROM c GROUP BY 1")
def discrimination(spark, sf_dir):
    return judge.discrimination(_reports(spark, sf_dir))


@query(_REPORTS + "SELECT case_id FROM reports GROUP BY 1 HAVING NOT bool_or(hit)")
def common_misses(spark, sf_dir):
    return judge.common_misses(_reports(spark, sf_dir))


@query(_REPORTS + ", p AS (SELECT case_id, hit AS before FROM reports WHERE config = 'bm25_rerank') SELECT config, slice, count(*) AS queries, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(*) FILTER (NOT hit AND NOT before) AS accepted_misses, count(*) FILTER (NOT hit AND before) AS new_misses, count(*) FILTER (NOT hit AND before IS NULL) AS unclassified_misses, count(*) FILTER (returned = 0) AS empty_results, count(*) FILTER (returned > 0 AND forbidden_hit) AS top1_trap, count(*) FILTER (returned > 0 AND NOT forbidden_hit AND mrr >= 1 - 1e-9) AS top1_relevant, count(*) FILTER (returned > 0 AND NOT forbidden_hit AND mrr < 1 - 1e-9) AS top1_unjudged, round(avg(recall), 6) AS mean_recall, round(avg(ndcg), 6) AS mean_ndcg FROM reports LEFT JOIN p USING (case_id) WHERE config = 'bm25' GROUP BY 1, 2")
def quality_counts(spark, sf_dir):
    current, previous = _report(spark, sf_dir, "bm25"), _report(spark, sf_dir, "bm25_rerank").withColumn("config", F.lit("bm25"))
    return judge.quality_counts(current, previous)


@query(f"WITH {_JUDGED}, h AS ({_HITS.format(config='bm25', order=_ORDERS['bm25'])}), m AS (SELECT DISTINCT h.case_id, rank, h.path FROM h JOIN ab ON ab.case_id = h.case_id AND ab.path = h.path AND (low IS NULL OR greatest(low, start) <= least(high, stop))), g AS (SELECT DISTINCT h.case_id FROM h JOIN (FROM e UNION ALL FROM ab) x ON x.case_id = h.case_id AND x.path = h.path AND (low IS NULL OR greatest(low, start) <= least(high, stop)) WHERE rank = 1) SELECT case_id, CASE WHEN rank = 1 THEN 'known trap' ELSE 'trap' END AS kind, path, CAST(rank AS INTEGER) AS rank FROM m UNION ALL SELECT case_id, 'unjudged', path, CAST(rank AS INTEGER) FROM h WHERE rank = 1 AND case_id NOT IN (SELECT case_id FROM g)")
def trap_warnings(spark, sf_dir):
    return judge.trap_warnings(_hits(spark, sf_dir, "bm25"), *_judged(spark, sf_dir))


@query(f"WITH {_JUDGED}, c AS (SELECT source AS case_id, right(source, 1) AS slice, count(*) % 25 AS k FROM documents GROUP BY 1, 2), ln AS (SELECT lang || '/' || doc_id % 7 AS path, max(doc_id % 60) AS lines FROM documents WHERE lang IS NOT NULL GROUP BY 1) SELECT DISTINCT * FROM (SELECT case_id, 'k out of range' AS problem FROM c WHERE k NOT BETWEEN 3 AND 20 UNION ALL SELECT case_id, 'grade out of range' FROM e WHERE grade NOT BETWEEN 1 AND 3 UNION ALL SELECT e.case_id, 'expected and absent' FROM e JOIN ab ON ab.case_id = e.case_id AND ab.path = e.path AND (ab.low IS NULL OR e.low IS NULL OR greatest(ab.low, e.low) <= least(ab.high, e.high)) UNION ALL SELECT case_id, 'lines outside the document' FROM e JOIN ln USING (path) WHERE low < 1 OR high > lines UNION ALL SELECT slice, 'too few cases of the slice' FROM c GROUP BY slice HAVING count(*) < 8)")
def query_set_problems(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    cases = d.groupBy(F.col("source").alias("case_id"), F.expr("right(source, 1)").alias("slice")).agg((F.count("*") % 25).alias("k"))
    lines = d.filter("lang IS NOT NULL").groupBy(F.concat("lang", F.lit("/"), (F.col("doc_id") % 7).cast("string")).alias("path")).agg(F.max(F.col("doc_id") % 60).alias("lines"))
    return judge.query_set_problems(cases, *_judged(spark, sf_dir), lines)


@query("WITH c AS (SELECT text, source || '/' || doc_id || '.md' || chr(10) || role || chr(10) || chr(10) || c.text AS contextual FROM (SELECT conv_id AS doc_id, role, text FROM conversations) c JOIN (SELECT doc_id, source FROM documents) d USING (doc_id)), x AS (SELECT 'plain' AS recipe, text AS input FROM c UNION ALL SELECT 'contextual', contextual FROM c) SELECT recipe, CAST(sum(n) AS BIGINT) AS inputs, count(*) AS distinct_inputs, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT recipe, input, count(*) AS n, strlen(input) AS bytes FROM x GROUP BY 1, 2) GROUP BY 1")
def recipe_census(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("heading_path"), "text")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"))
    return judge.recipe_census(c.join(d, "doc_id"))


@query("WITH p AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (value > 50))) AS candidates, sum(strlen(props)) AS bytes FROM events GROUP BY 1) SELECT count(*) AS observations, count(*) FILTER (coalesce(len(candidates), 0) = 0) AS empty, count(*) FILTER (len(candidates) > 0) AS non_empty, count(DISTINCT coalesce(candidates, [])) AS pools, CAST(max(bytes) AS BIGINT) AS largest FROM p")
def pool_census(spark, sf_dir):
    pools = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("candidates"), F.sum(F.octet_length("props")).alias("bytes"))
    return judge.pool_census(pools)
