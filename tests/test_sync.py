import json
import time

import pytest

from docquery.operators import index, lexical
from docquery.sources import store
from docquery.streaming import debounce, sync


class Folder:
    """Documents that a test changes between batches, and the settings."""

    def __init__(self):
        self.docs, self.settings = {}, {"ignore": []}

    def present(self, spark):
        return spark.createDataFrame(list(self.docs.items()), "rel_path string, text string")

    def sink(self, root):
        return sync.Sync(root, "s", self.present, lambda: self.settings)


def batch(spark, *paths):
    return spark.createDataFrame([("k", list(paths))], "key string, paths array<string>")


def found(spark, root):
    """Paths by word, from the index and the catalog of one generation."""
    built = index.Index(spark, root)
    paths = {r.doc_id: r.rel_path for r in store.read(spark, root, "catalog", built.generation).collect()}
    q = spark.createDataFrame([(w, [w]) for w in ("one", "two", "new", "old")], "query_id string, terms array<string>")
    scores = {(r.query_id, paths[r.doc_id]): round(r.score, 9) for r in lexical.bm25(built, q).collect()}
    return scores, sorted(paths.values())


def fresh(spark, tmp_path, folder):
    root = f"{tmp_path}/fresh-{time.time_ns()}"
    folder.sink(root)(batch(spark), 0)
    return found(spark, root)


def test_batches_keep_the_index_as_if_made_anew(spark, tmp_path):
    folder, root = Folder(), str(tmp_path / "i")
    folder.docs = {"a/x.md": "one two", "a/y.md": "old", "b/z.md": "two old", "b/w.md": "one"}
    assert folder.sink(root)(batch(spark, "a/x.md"), 0) == 1  # no index yet: everything is surveyed
    assert found(spark, root)[1] == sorted(folder.docs)
    folder.docs |= {"a/x.md": "new new", "c.md": "new one", "b/z.md": "changed but not named"}
    del folder.docs["a/y.md"]
    assert folder.sink(root)(batch(spark, "a", "a/y.md", "c.md"), 1) == 2
    folder.docs["b/z.md"] = "two old"
    assert found(spark, root) == fresh(spark, tmp_path, folder)
    # nothing changed: no generation; a folder that is gone takes what was below it
    assert folder.sink(root)(batch(spark, "a", "b/z.md"), 2) == 2
    del folder.docs["b/z.md"], folder.docs["b/w.md"]
    assert folder.sink(root)(batch(spark, "b"), 3) == 3 and found(spark, root) == fresh(spark, tmp_path, folder)


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path, monkeypatch):
    folder, root = Folder(), str(tmp_path / "i")
    folder.docs = {"x.md": "one", "y.md": "two"}
    folder.sink(root)(batch(spark), 0)
    folder.docs = {"x.md": "new", "z.md": "two new"}
    real = store.create_once
    monkeypatch.setattr(store, "create_once", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        folder.sink(root)(batch(spark, "x.md", "y.md", "z.md"), 1)
    monkeypatch.setattr(store, "create_once", real)
    assert store.generation(spark, root) == 1 and found(spark, root)[1] == ["x.md", "y.md"]
    assert folder.sink(root)(batch(spark, "x.md", "y.md", "z.md"), 1) == 2
    want = found(spark, root)
    assert want == fresh(spark, tmp_path, folder)
    # the number is known: not even a changed file is taken up under it
    folder.docs["x.md"] = "old"
    assert folder.sink(root)(batch(spark, "x.md"), 1) == 2 and found(spark, root) == want
    assert folder.sink(root)(batch(spark, "x.md"), 2) == 3


def test_settings_at_the_end_of_the_window_govern(spark, tmp_path):
    folder, root = Folder(), str(tmp_path / "i")
    folder.docs = {"x.md": "one", "tmp/y.md": "two"}
    sink = folder.sink(root)
    sink(batch(spark), 0)
    folder.settings = {"ignore": ["tmp/**"]}
    sink(batch(spark, "x.md"), 1)
    assert found(spark, root)[1] == ["x.md"] and found(spark, root) == fresh(spark, tmp_path, folder)


def test_stream_to_index_with_a_restart(spark, tmp_path):
    source, state, root = tmp_path / "in", tmp_path / "state", str(tmp_path / "i")
    source.mkdir()
    folder = Folder()
    folder.docs = {"x.md": "one", "y.md": "two"}
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def start():
        events = spark.readStream.schema("key string, path string").json(str(source))
        return debounce.debounced(events, 0.3, 3.0).writeStream.foreachBatch(folder.sink(root)).option("checkpointLocation", str(state)).outputMode("append").trigger(processingTime="1 second").start()

    def wait(query, paths):
        for _ in range(90):
            time.sleep(1)
            if query.exception() or store.generation(spark, root) and sorted(r.rel_path for r in store.read(spark, root, "catalog").collect()) == paths:
                break
        query.stop()
        assert query.exception() is None

    try:
        query = start()
        (source / "a.json").write_text(json.dumps({"key": "r", "path": "x.md"}))
        wait(query, ["x.md", "y.md"])
        folder.docs |= {"x.md": "new", "z.md": "old one"}
        (source / "b.json").write_text("\n".join(json.dumps({"key": "r", "path": p}) for p in ("x.md", "z.md")))
        wait(start(), ["x.md", "y.md", "z.md"])
        assert found(spark, root) == fresh(spark, tmp_path, folder)
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
