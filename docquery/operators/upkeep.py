"""Status, readiness, incremental upkeep and admission over the tables of an index."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of a survey, of its warnings, of an outcome record, and of embedding batches.
MAX_DOCS, MAX_WARNINGS, MAX_OUTCOME_BYTES = 20_000, 100, 1 << 20
BATCH_TEXTS, BATCH_BYTES = 128, 512 * 1024
KEYSET_PAGE = 400
STATS = "warnings array<string>, error string, errors long"


# --- status


def status(projects: DataFrame, docs: DataFrame, chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """project, status, generation, docs, chunks, and the warnings and error of the newest job (by id) alone.

    projects: project, status, generation; docs: project, doc_id; chunks: doc_id; jobs: project, job_id, stats (JSON).
    """
    n_docs = docs.groupBy("project").agg(F.count("*").alias("docs"))
    n_chunks = docs.select("project", "doc_id").join(chunks.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id").groupBy("project").agg(F.sum("n").alias("chunks"))
    newest = jobs.groupBy("project").agg(F.max(F.struct("job_id", "stats")).alias("j")).select("project", F.from_json("j.stats", STATS).alias("s"))
    joined = projects.join(n_docs, "project", "left").join(n_chunks, "project", "left").join(newest, "project", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select("project", "status", "generation", zero("docs"), zero("chunks"), F.coalesce("s.warnings", F.array().cast("array<string>")).alias("warnings"), F.col("s.error").alias("last_error"))


def admission(projects: DataFrame, schema: int) -> DataFrame:
    """project and why it cannot be searched: not indexed, or indexed under another schema; null where it can."""
    reason = F.when(F.col("status") != "indexed", F.concat(F.lit("not indexed: "), F.col("status"))).when(F.col("schema_version") != schema, "rebuild")
    return projects.select("project", reason.alias("refused"))


def readiness(states: DataFrame, schema: int, recipe: str) -> DataFrame:
    """project and the first reason for which its index is not ready, or null.

    states: active (a job runs), status, interrupted, outcome_errors (null: no outcome), job_state, job_partial,
    health, schema_version, scope, recipe_id and attributable (the last job's success belongs to this outcome).
    """
    known = F.col("outcome_errors").isNotNull()
    reason = (
        F.when(F.col("active") | (F.col("status") == "indexing"), "indexing").when(F.col("interrupted"), "interrupted").when(F.col("status") == "error", "failed")
        .when(F.col("outcome_errors") > 0, "partial").when((F.col("job_state") == "error") | F.col("job_partial"), "sync-failed")
        .when(F.col("health") == "rebuild", "rebuild-required").when(F.col("health") != "healthy", "index-unavailable").when(F.col("status") != "indexed", "index-unavailable")
        .when(F.col("schema_version") != schema, "rebuild-required").when(~known, "unknown-outcome").when(F.col("scope") != "full", "incomplete-scope")
        .when(F.col("recipe_id") != recipe, "recipe-changed").when(~F.coalesce(F.col("attributable"), F.lit(True)), "unknown-outcome")
    )
    return states.select("project", reason.alias("reason"))


def outcomes(projects: DataFrame, pending: DataFrame, schema: int) -> DataFrame:
    """project, and scope, errors and complete of its outcome record; nulls where the record is unknown.

    projects: project, status, attempt, generation, schema_version, root, outcome (JSON). A record is unknown if it is
    absent, malformed or too large, if documents are pending, or if it belongs to another attempt, generation or root.
    """
    record = F.from_json("outcome", "attempt long, generation long, root string, scope string, errors long, warnings array<string>")
    rows = projects.join(pending.select("project", F.lit(True).alias("waits")).distinct(), "project", "left").withColumn("o", F.when(F.octet_length("outcome") <= MAX_OUTCOME_BYTES, record))
    good = (
        (F.col("status") == "indexed") & F.col("waits").isNull() & (F.col("schema_version") == schema) & (F.col("attempt") > 0) & (F.col("generation") >= 0)
        & (F.col("o.attempt") == F.col("attempt")) & (F.col("o.generation") == F.col("generation")) & (F.col("o.root") == F.col("root"))
        & (F.coalesce(F.size("o.warnings"), F.lit(0)) <= MAX_WARNINGS) & F.col("o.scope").isNotNull()
    )
    only = lambda x: F.when(F.coalesce(good, F.lit(False)), x)
    return rows.select("project", only(F.col("o.scope")).alias("scope"), only(F.col("o.errors")).alias("errors"), only((F.col("o.scope") == "full") & (F.col("o.errors") == 0)).alias("complete"))


def recipe_id(parts: list[Column]) -> Column:
    """Identity of an ordered list of settings; each is preceded by its length, so that no two lists run together."""
    text = [x.cast("string") for x in parts]
    return F.sha2(F.concat(*[F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in text]), 256)


def job_status(jobs: DataFrame) -> DataFrame:
    """Jobs with their statistics taken apart."""
    return jobs.select("job_id", "project", "state", F.from_json("stats", STATS).alias("s")).select("job_id", "project", "state", "s.errors", F.size(F.coalesce("s.warnings", F.array().cast("array<string>"))).alias("warnings"))


def closest_project(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """path and the project whose root is its nearest ancestor (or itself); without one, null. An equality join on the ancestors of each path."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    each = paths.select("path", F.explode(ancestors).alias("root"))
    found = each.join(projects.select("root", "project"), "root").groupBy("path").agg(F.max_by("project", F.length("root")).alias("project"))
    return paths.select("path").distinct().join(found, "path", "left")


def cache_size(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def set_digest(rows: DataFrame, by: str, id_: str, content: str) -> DataFrame:
    """A digest of each group's (id, hash) pairs that does not depend on their order.

    Four words of 32 bits of each pair's hash are added, so every task sends one row for each group, whatever its size.
    Equal pairs count each; a null id or hash is an empty one.
    """
    text = F.concat_ws(":", F.coalesce(F.col(id_).cast("string"), F.lit("")), F.coalesce(F.col(content), F.lit("")))
    words = [F.conv(F.substring(F.sha2(text, 256), 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)").alias(f"w{i}") for i in range(4)]
    sums = rows.select(by, *words).groupBy(by).agg(F.count("*").alias("n"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(4)])
    return sums.select(by, F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[F.pmod(f"w{i}", F.lit(1 << 32)).cast("bigint").cast("string") for i in range(4)]), 256).alias("digest"))


# --- guards


def of_project(rows: DataFrame, project: str) -> DataFrame:
    return rows.filter(F.col("project") == project)


def searchable(projects: DataFrame, docs: DataFrame) -> DataFrame:
    """Projects without a pending document (one with an empty content hash)."""
    return projects.join(docs.filter("content_hash = ''").select("project"), "project", "left_anti")


def same_generation(candidates: DataFrame, generation: int) -> DataFrame:
    """Candidates of the generation; one of another is an error that asks for a retry."""
    message = F.concat(F.lit("the index has changed, retry: generation "), F.col("generation").cast("string"))
    return candidates.filter(F.when(F.col("generation") == generation, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def still_there(hits: DataFrame, docs: DataFrame, prefix: str | None, tags: list[str]) -> DataFrame:
    """Hits whose document is still there and in scope, with its path."""
    inside = docs.filter(F.col("rel_path").startswith(prefix)) if prefix else docs
    if tags:
        inside = inside.filter(F.coalesce(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0, F.lit(False)))
    return hits.join(inside.select("doc_id", "rel_path"), "doc_id")


def keyset_page(chunks: DataFrame, after: tuple[int, int] | None = None, size: int = KEYSET_PAGE) -> DataFrame:
    """Chunks in order of document and number after the pair."""
    rows = chunks if after is None else chunks.filter(F.struct(F.col("doc_id").cast("long"), F.col("seq").cast("long")) > F.struct(F.lit(after[0]).cast("long"), F.lit(after[1]).cast("long")))
    return rows.orderBy("doc_id", "seq").limit(size)


def page_and_next(docs: DataFrame, cursor: str | None, limit: int) -> DataFrame:
    """A page of paths after the cursor, and on its rows the next cursor: the last path where more follow, else null."""
    rows = (docs.filter(F.col("rel_path") > cursor) if cursor else docs).select("rel_path").orderBy("rel_path").limit(limit + 1)
    whole = Window.partitionBy()  # at most limit + 1 rows
    counted = rows.withColumn("n", F.count("*").over(whole)).withColumn("nth", F.row_number().over(Window.orderBy("rel_path"))).filter(F.col("nth") <= limit)
    return counted.select("rel_path", F.when(F.col("n") > limit, F.max("rel_path").over(whole)).alias("next_cursor"))


# --- upkeep


def removals(stored: DataFrame, gone: DataFrame, present: DataFrame) -> DataFrame:
    """Stored paths that an incremental batch removes: those that are gone, and those below a path that is gone, unless they are present again.

    Every stored path meets the gone ones by its ancestors, so the join is by equality.
    """
    parts = F.split("rel_path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    below = stored.select("rel_path", F.explode(ancestors).alias("path")).join(gone.select("path").distinct(), "path", "left_semi").select("rel_path").distinct()
    return below.join(present.select("rel_path"), "rel_path", "left_anti")


def finalize(batch: DataFrame, present: DataFrame, most: int = 10_000) -> DataFrame:
    """rel_path and purge of a closed batch (key, path): files that are there, those below a folder that is there (at most `most` of a path, in order), and paths of which nothing is left, as purge marks."""
    parts = F.split("rel_path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    wanted = batch.select("key", "path").distinct()
    below = present.select("rel_path", F.explode(ancestors).alias("path")).join(wanted, "path")
    nth = F.row_number().over(Window.partitionBy("key", "path").orderBy("rel_path"))
    kept = below.withColumn("nth", nth).filter(F.col("nth") <= most).select("key", "rel_path").distinct()
    gone = wanted.join(below.select("key", "path").distinct(), ["key", "path"], "left_anti")
    return kept.select("key", "rel_path", F.lit(False).alias("purge")).union(gone.select("key", F.col("path").alias("rel_path"), F.lit(True)))


def survey_removals(stored: DataFrame, walked: DataFrame, walk_errors: DataFrame) -> DataFrame:
    """Stored paths that a full walk did not find; none if the walk had any error."""
    gone = stored.select("rel_path").join(walked.select("rel_path"), "rel_path", "left_anti")
    failed = walk_errors.agg((F.count("*") > 0).alias("failed"))  # one row
    return gone.join(F.broadcast(failed), ~F.col("failed")).drop("failed")


def admitted(new: DataFrame, stored: DataFrame, removed: DataFrame, most: int = MAX_DOCS) -> DataFrame:
    """New paths in order as far as the project's budget goes, with a warning on those beyond it; removals free their places first."""
    left = stored.join(removed, ["project", "rel_path"], "left_anti").groupBy("project").agg(F.count("*").alias("kept"))
    order = Window.partitionBy("project").orderBy("rel_path")
    ranked = new.withColumn("nth", F.row_number().over(order)).join(left, "project", "left")
    return ranked.select("project", "rel_path", F.when(F.col("nth") + F.coalesce("kept", F.lit(0)) > most, "over the document budget").alias("warning"))


def capped_warnings(warnings: DataFrame, by: str, most: int = MAX_WARNINGS) -> DataFrame:
    """The first warnings of each group, by their number, and the count of all."""
    ranked = warnings.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("nth")))
    count = warnings.groupBy(by).agg(F.count("*").alias("errors"))
    kept = ranked.filter(F.col("rank") <= most).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "warning"))), lambda x: x.warning).alias("warnings"))
    return count.join(kept, by)


def replace_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of the documents in new are replaced as a whole."""
    return chunks.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def delete_docs(docs: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without those of the documents in gone (doc_id)."""
    ids = gone.select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_anti"), chunks.join(ids, "doc_id", "left_anti")


def mark_pending(docs: DataFrame, touched: DataFrame) -> DataFrame:
    """Documents with an empty content hash where an update is about to touch them."""
    rows = docs.join(touched.select("doc_id", F.lit(True).alias("waits")).distinct(), "doc_id", "left")
    return rows.withColumn("content_hash", F.when(F.col("waits"), "").otherwise(F.col("content_hash"))).drop("waits")


def start_jobs(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted jobs (project, job_id) of projects without a queued or running one; one for each project, the smallest id."""
    free = wanted.join(jobs.filter(F.col("state").isin("queued", "running")).select("project"), "project", "left_anti")
    return free.groupBy("project").agg(F.min("job_id").alias("job_id")).select("project", "job_id", F.lit("queued").alias("state"))


def failed_batches(batches: DataFrame) -> DataFrame:
    """Job rows in state error for batches (project, job_id, paths, message), with the lost paths in their statistics."""
    lost = F.transform("paths", lambda p: F.concat(F.lit("lost: "), p))
    return batches.select("project", "job_id", F.lit("error").alias("state"), F.to_json(F.struct(F.slice(lost, 1, MAX_WARNINGS).alias("warnings"), F.col("message").alias("error"), F.size("paths").cast("long").alias("errors"))).alias("stats"))


def put_vectors(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors by model and hash, the latest of each (nth) staying; empty ones are refused."""
    rows = stored.unionByName(new.filter(F.size("vector") > 0))
    return rows.groupBy("model_id", "chunk_hash").agg(F.max(F.struct("nth", "vector")).alias("x")).select("model_id", "chunk_hash", "x.nth", "x.vector")


def embedding_batches(texts: DataFrame, most_texts: int = BATCH_TEXTS, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """project, seq and batch (from 0): in order, batches of at most so many texts and bytes; a larger text is one of its own."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        project, batch, n, size = None, -1, 0, 0
        for part in parts:
            out = []
            for p, bytes_ in zip(part["project"], part["bytes"], strict=True):
                if p != project or n >= most_texts or size + bytes_ > most_bytes:
                    project, batch, n, size = p, (batch + 1 if p == project else 0), 0, 0
                n, size = n + 1, size + bytes_
                out.append(batch)
            yield pd.DataFrame({"project": part["project"], "seq": part["seq"], "batch": out})

    return texts.select("project", "seq", "bytes").repartition("project").sortWithinPartitions("project", "seq").mapInPandas(run, "project string, seq long, batch long")


def metadata_json(front: DataFrame) -> DataFrame:
    """doc_id and the JSON of title and tags; null where a document has neither."""
    some = F.col("title").isNotNull() | (F.size("tags") > 0)
    return front.select("doc_id", F.when(some, F.to_json(F.struct("title", "tags"))).alias("metadata"))


def manifest_problems(manifest: DataFrame, docs: DataFrame) -> DataFrame:
    """path and problem of a frozen corpus: documents that are missing, changed (by hash) or not listed."""
    both = manifest.select("path", F.col("hash").alias("a")).join(docs.select("path", F.col("hash").alias("b")), "path", "full_outer")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "not listed").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def vector_page(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks of a page with their vector, or null where there is none."""
    return chunks.join(vectors, "chunk_hash", "left")


def distinct_required(candidates: DataFrame, key: str) -> DataFrame:
    """The candidates; a key that is repeated is an error."""
    n = F.count("*").over(Window.partitionBy(key))
    return candidates.withColumn("__n", n).filter(F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("a candidate is repeated")).cast("boolean"))).drop("__n")


def nested_prefixes(patterns: list[str]) -> list[str]:
    """Ignore patterns; one that leads out of the root is an error."""
    for p in patterns:
        if ".." in p.replace("\\", "/").split("/"):
            raise ValueError(f"an ignore pattern leaves the root: {p}")
    return patterns
