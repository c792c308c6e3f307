"""Scope, listing, counting, neighbours and maintenance over the metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquery.sources.tables import chunk_id

# Rows of a page, neighbours of a chunk, and jobs that are kept.
PAGE_DEFAULT, PAGE_MOST = 50, 1000
NEIGHBOURS_MOST = 100
JOBS_KEPT = 50


def path_prefix(docs: DataFrame, prefix: str | None) -> DataFrame:
    """Documents whose path begins with the literal, case-sensitive prefix; none or empty: all."""
    return docs.filter(F.col("rel_path").startswith(prefix)) if prefix else docs


def has_tags(docs: DataFrame, tags: list[str]) -> DataFrame:
    """Documents that carry every tag; those without tags match only an empty list."""
    if not tags:
        return docs
    return docs.filter(F.coalesce(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0, F.lit(False)))


def page(docs: DataFrame, cursor: str | None = None, limit: int = PAGE_DEFAULT) -> DataFrame:
    """Documents in order of path after the cursor; the last path of a full page is the next cursor."""
    limit = max(0, min(limit, PAGE_MOST))
    rows = docs.filter(F.col("rel_path") > cursor) if cursor else docs
    return rows.orderBy("rel_path").limit(limit)


def chunk_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of every document, 0 where it has none."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("chunks"))


def project_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents, chunks and bytes of every project."""
    n = chunk_counts(docs, chunks)
    return docs.join(n, "doc_id").groupBy("project").agg(F.count("*").alias("docs"), F.sum("chunks").alias("chunks"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))


def neighbours(chunks: DataFrame, hits: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Chunks of each hit's document whose sequence number is at most `before` less or `after` more."""
    before, after = (max(0, min(x, NEIGHBOURS_MOST)) for x in (before, after))
    # a row for each wanted number, so that the join is by equality and no document is paired with itself
    wanted = hits.select("doc_id", F.col("seq").alias("hit_seq"), F.explode(F.sequence(F.col("seq") - before, F.col("seq") + after)).alias("seq"))
    return wanted.join(chunks, ["doc_id", "seq"]).select("doc_id", "hit_seq", "seq", chunk_id().alias("chunk_id"), "heading_path", F.length("text").alias("n_chars"))


def citations(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Path and heading of each hit (doc_id, seq); hits of unknown chunks or documents are dropped."""
    return hits.join(chunks, ["doc_id", "seq"]).join(docs.select("doc_id", "rel_path"), "doc_id").select(chunk_id().alias("chunk_id"), "rel_path", "heading_path", "seq")


def diff(old: DataFrame, new: DataFrame, key: str = "rel_path", content: str = "content_hash") -> DataFrame:
    """new, changed, same or removed for every key of two snapshots."""
    both = old.select(key, F.col(content).alias("a")).join(new.select(key, F.col(content).alias("b")), key, "full_outer")
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return both.select(key, state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, key: str = "rel_path") -> DataFrame:
    """The old rows that new ones do not replace, and the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def latest_job(jobs: DataFrame) -> DataFrame:
    """The newest job of each project; ties go to the larger id."""
    newest = F.max(F.struct("started_at", "job_id", "state"))
    return jobs.groupBy("project").agg(newest.alias("j")).select("project", "j.job_id", "j.state", "j.started_at")


def prune_jobs(jobs: DataFrame, keep: int = JOBS_KEPT) -> DataFrame:
    """All unfinished jobs and the `keep` newest finished ones of each project."""
    done = F.col("state").isin("done", "error")
    finished = jobs.filter(done).withColumn("nth", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("started_at"), F.desc("job_id")))).filter(F.col("nth") <= keep).drop("nth")
    return jobs.filter(~done).unionByName(finished)


def first_occurrences(texts: DataFrame, known: DataFrame) -> DataFrame:
    """One row for each distinct text whose hash is not known yet: the hash, its first document and how many share it."""
    hashed = texts.select("doc_id", F.sha2("text", 256).alias("chunk_hash"))
    distinct = hashed.groupBy("chunk_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    return distinct.join(known.select("chunk_hash"), "chunk_hash", "left_anti")


def coverage(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the chunks, and how many of them have a vector."""
    distinct = chunks.select(key).distinct()
    present = vectors.select(key, F.lit(1).alias("present")).distinct()
    return distinct.join(present, key, "left").agg(F.count("*").alias("total"), F.count("present").alias("present"))


def lru_keep(entries: DataFrame, most: int, most_bytes: int, leases: DataFrame | None = None, now: int = 0, groups: str = "model_id") -> DataFrame:
    """What an eviction leaves of each group: rows under a live lease, and the newest others while all kept rows stay within the caps.

    entries: the group, key, used_at and bytes. leases: the group, key and expires_at; one that expires at `now` or
    before is none. Leased rows count first, and stay even where they alone exceed the caps. Among equal used_at the
    smaller key is older.
    """
    if leases is None:
        held = entries.withColumn("held", F.lit(False))
    else:
        live = leases.filter(F.col("expires_at") > now).select(groups, "key", F.lit(True).alias("held")).distinct()
        held = entries.join(live, [groups, "key"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    # the leased come first in the running sums, then the others from the newest on
    order = Window.partitionBy(groups).orderBy(F.desc("held"), F.desc("used_at"), F.desc("key"))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = held.withColumn("nth", F.row_number().over(order)).withColumn("total", F.sum("bytes").over(running))
    return ranked.filter(F.col("held") | ((F.col("nth") <= most) & (F.col("total") <= most_bytes))).drop("nth", "total", "held")


def pin(leases: DataFrame, new: DataFrame) -> DataFrame:
    """Leases (project, holder, expires_at) with the new ones: a holder that pins a project again keeps the later end. Null ends are none."""
    return leases.unionByName(new).filter("expires_at IS NOT NULL").groupBy("project", "holder").agg(F.max("expires_at").alias("expires_at"))


def unpin(leases: DataFrame, released: DataFrame) -> DataFrame:
    """Leases without those that their holders (project, holder) release; a release of what is not held changes nothing."""
    return leases.join(released.select("project", "holder").distinct(), ["project", "holder"], "left_anti")


def unexpired(leases: DataFrame, now) -> DataFrame:
    """Leases that end after the timestamp `now`."""
    return leases.filter(F.col("expires_at") > now)


def upsert_documents(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored documents (project, rel_path, ...) with the new ones in place of those of the same path."""
    return stored.join(new.select("project", "rel_path").distinct(), ["project", "rel_path"], "left_anti").unionByName(new.dropDuplicates(["project", "rel_path"]))


def delete_project(stored: DataFrame, project: str) -> DataFrame:
    """What is left when all of a project's rows are deleted; rows without a project stay."""
    return stored.filter(~F.coalesce(F.col("project") == project, F.lit(False)))
