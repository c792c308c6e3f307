"""Debounced batches of changed paths into a stored index: one generation for each batch, however often it is run."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.operators import index, upkeep
from docquery.sources import files, store
from docquery.sources.store import Part, Snapshot

CATALOG = "rel_path string, doc_id long, content_hash string"


class Sync:
    """A foreachBatch sink for batches (key, paths) of a debounced stream.

    present: reads the documents (rel_path, text) as they are now; settings: reads the configuration (ignore: patterns).
    Both are read when a batch is handled, so what holds at the end of its window governs it. Only documents whose
    content differs from the catalog are indexed. Where there is no index yet, or the settings are not those that it was
    made with, all documents are surveyed instead of the batch's paths.

    Segment, ended ids, catalog and the batch's number are published as one generation. A batch that is run again, after a
    failure or a restart, finds its number (or its documents unchanged) and publishes nothing; files that a failed run
    left belong to no generation.
    """

    def __init__(self, root: str, stream: str, present: Callable[[SparkSession], DataFrame], settings: Callable[[], dict] = dict):
        self.root, self.stream, self.present, self.settings = root, stream, present, settings

    def done(self, now: Snapshot) -> Part | None:
        """What the snapshot says of this stream: its last batch, and a digest of the settings."""
        return next((p for p in now.of("sync") if p.facts["stream"] == self.stream), None)

    def __call__(self, batch: DataFrame, number: int) -> int:
        spark, root = batch.sparkSession, self.root
        # a stream's batch is read once and whatever comes of it: its state is stored only where every task has run
        (part,) = store.put(spark, root, {"batches": batch.select("key", "paths")})
        return self.apply(spark, store.written(spark, part), number)

    def apply(self, spark: SparkSession, batch: DataFrame, number: int) -> int:
        """The generation in which a written batch is indexed."""
        root = self.root
        now = store.snapshot(spark, root)
        last = self.done(now)
        if last and last.facts["batch"] >= number:
            return now.generation
        settings = self.settings()
        digest = hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()
        found = self.present(spark).select("rel_path", "text").filter(~files.ignored(F.col("rel_path"), settings.get("ignore", [])))
        found = found.select(F.xxhash64("rel_path").alias("doc_id"), "rel_path", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
        stored = store.read(spark, root, "catalog", now.generation) if now.of("catalog") else spark.createDataFrame([], CATALOG)
        if not now.of("segment") or not last or last.facts["settings"] != digest:
            changed, gone = found, stored.join(found.select("rel_path"), "rel_path", "left_anti")
        else:
            paths = batch.select("key", F.explode("paths").alias("path")).distinct()
            marked = upkeep.finalize(paths, found)
            changed = found.join(marked.filter("NOT purge").select("rel_path"), "rel_path", "left_semi")
            gone = upkeep.removals(stored, marked.filter("purge").select(F.col("rel_path").alias("path")), found)
            gone = stored.join(gone, "rel_path", "left_semi")
        changed = changed.join(stored.select("rel_path", F.col("content_hash").alias("old")), "rel_path", "left").filter(~F.col("content_hash").eqNullSafe(F.col("old"))).drop("old")
        # what a batch changes is read once and written, so that files that change meanwhile do not split it
        (kept,) = store.put(spark, root, {"changed": changed.select("doc_id", "rel_path", "text", "content_hash")})
        changed = store.written(spark, kept)
        (ended,) = store.put(spark, root, {"ended": gone.select("doc_id", "rel_path")})
        gone = store.written(spark, ended)
        any_changed, any_gone = changed.limit(1).count() > 0, gone.limit(1).count() > 0
        if not any_changed and not any_gone and now.of("segment") and last and last.facts["settings"] == digest:
            return now.generation
        parts = index.update_parts(spark, root, changed if any_changed or not now.of("segment") else None, gone if any_gone else None)
        touched = changed.select("rel_path").union(gone.select("rel_path"))
        catalog = stored.join(touched, "rel_path", "left_anti").unionByName(changed.select("rel_path", "doc_id", "content_hash"))
        (catalog,) = store.put(spark, root, {"catalog": catalog})
        mark = Part("sync", "", "", None, {"stream": self.stream, "batch": number, "settings": digest})
        base = now.of("catalog")

        def change(newest: Snapshot) -> list[Part]:
            mine = self.done(newest)
            if mine and mine.facts["batch"] >= number:
                return list(newest.parts)
            if newest.of("catalog") != base:
                raise store.Conflict("another stream has changed the catalog")
            rest = Snapshot(newest.generation, tuple(p for p in newest.parts if p.name != "catalog" and p != mine))
            return index.with_parts(spark, root, rest, [*parts, catalog, mark])

        try:
            return store.publish(spark, root, change)
        except store.Conflict:
            return self.apply(spark, batch, number)
