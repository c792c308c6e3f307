import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docquery.operators import index, lexical
from docquery.sources import store


def test_two_writers_get_two_generations(spark, tmp_path):
    """Both read the log before either writes; the second derives its snapshot again from the first one's."""
    root, meet, seen = f"file://{tmp_path}/s", threading.Barrier(2), []
    store.commit(spark, root, {"base": spark.range(1)})

    def writer(name):
        part, first = store.put(spark, root, {name: spark.range(2)})[0], [True]

        def change(now):
            if first.pop() if first else False:
                meet.wait(60)
            return store.replaced(now, [part])

        seen.append(store.publish(spark, root, change))

    threads = [threading.Thread(target=writer, args=(n,)) for n in ("a", "b")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(seen) == [2, 3] and store.generation(spark, root) == 3
    assert {p.name for p in store.snapshot(spark, root).parts} == {"base", "a", "b"}


def test_a_file_is_created_once(spark, tmp_path):
    assert store.create_once(spark, f"file://{tmp_path}/l/x.json", "one") and not store.create_once(spark, f"{tmp_path}/l/x.json", "two")
    assert (tmp_path / "l/x.json").read_text() == "one" and [p.name for p in (tmp_path / "l").iterdir()] == ["x.json"]


def test_a_conflict_publishes_nothing(spark, tmp_path):
    root = str(tmp_path / "s")

    def change(now):
        raise store.Conflict

    with pytest.raises(store.Conflict):
        store.publish(spark, root, change)
    assert store.generation(spark, root) == 0


WORDS = "alpha beta gamma delta rare"
QUERIES = [(1, ["alpha"]), (2, ["beta", "rare"]), (3, ["new", "gamma"]), (4, ["gone"])]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def corpus(n=60):
    words = WORDS.split()
    return [(i, " ".join(words[(i * j) % 5] for j in range(1, 3 + i % 7)) + (" gone" if i % 11 == 0 else "")) for i in range(n)] + [(1000, None), (1001, "")]


def found(spark, built):
    q = spark.createDataFrame(QUERIES, "query_id int, terms array<string>")
    phrase = spark.createDataFrame([(1, ["alpha", "beta"]), (2, ["gamma", "alpha", "delta"])], "phrase_id int, terms array<string>")
    scores = {(r.query_id, r.doc_id): round(r.score, 9) for r in lexical.bm25(built, q).collect()}
    return scores, Counter(map(tuple, lexical.phrase_matches(built, phrase).select("phrase_id", "doc_id", "n").collect()))


def fresh(spark, path, rows):
    index.write(spark, str(path), docs(spark, rows))
    return index.Index(spark, str(path))


def test_updates_equal_a_fresh_index(spark, tmp_path):
    root, rows = str(tmp_path / "i"), dict(corpus())
    index.write(spark, root, docs(spark, list(rows.items())))
    before = index.Index(spark, root)
    held = found(spark, before)
    changed = {i: f"new alpha beta {WORDS}" for i in (3, 4, 7, 2000)}
    index.upsert(spark, root, docs(spark, list(changed.items())))
    index.delete(spark, root, docs(spark, [(5, ""), (11, ""), (99999, "")]))
    index.upsert(spark, root, docs(spark, [(7, "new alpha"), (11, "gone rare beta")]))
    now = {**rows, **changed, 7: "new alpha", 11: "gone rare beta"}
    now.pop(5)
    want = found(spark, fresh(spark, tmp_path / "f", list(now.items())))
    built = index.Index(spark, root)
    assert found(spark, built) == want and len(built.segments) == 3
    assert sorted(map(tuple, built.df.collect())) == sorted(map(tuple, index.Index(spark, str(tmp_path / "f")).df.collect()))
    assert built.stats.collect() == index.Index(spark, str(tmp_path / "f")).stats.collect()
    # the first reader still sees its generation
    assert found(spark, before) == held and found(spark, index.Index(spark, root, 1)) == held
    index.merge(spark, root, everything=True)
    merged = index.Index(spark, root)
    assert len(merged.segments) == 1 and not merged.gone and found(spark, merged) == want
    assert merged.entries().count() == index.Index(spark, str(tmp_path / "f")).entries().count()


def test_an_update_writes_its_own_rows_alone(spark, tmp_path):
    root = str(tmp_path / "i")
    index.write(spark, root, docs(spark, corpus()))
    old = {p.path for p in store.snapshot(spark, root).parts if p.path}
    index.upsert(spark, root, docs(spark, [(3, "alpha new")]))
    parts = store.snapshot(spark, root).parts
    assert old <= {p.path for p in parts}
    (new,) = [p for p in parts if p.name == "segment" and p.path not in old]
    assert store.written(spark, new).select("doc_id").distinct().collect() == [(3,)]


def test_small_segments_are_merged_by_size(spark, tmp_path):
    root = str(tmp_path / "i")
    index.write(spark, root, docs(spark, corpus()))
    for i in range(4):
        index.upsert(spark, root, docs(spark, [(i, f"new text {i}")]))
    want = found(spark, index.Index(spark, root))
    at = index.merge(spark, root)
    built = index.Index(spark, root)
    assert sorted(p.facts["rows"] for p in built.segments) == [4, 62] and built.generation == at and found(spark, built) == want
    assert index.merge(spark, root) == at


def test_a_merge_that_was_overtaken_starts_anew(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "i")
    index.write(spark, root, docs(spark, corpus()))
    index.upsert(spark, root, docs(spark, [(1, "new alpha")]))
    real, late = index._put_entries, [True]

    def slow(*args):
        out = real(*args)
        if late:  # before the first merge is published another one and a deletion are
            late.clear()
            index.merge(spark, root, everything=True)
            index.delete(spark, root, docs(spark, [(2, "")]))
            index.upsert(spark, root, docs(spark, [(9, "new gamma")]))
        return out

    monkeypatch.setattr(index, "_put_entries", slow)
    index.merge(spark, root, everything=True)
    rows = {**dict(corpus()), 1: "new alpha", 9: "new gamma"}
    rows.pop(2)
    monkeypatch.setattr(index, "_put_entries", real)
    assert found(spark, index.Index(spark, root)) == found(spark, fresh(spark, tmp_path / "f", list(rows.items())))


def test_entries_by_hand(spark):
    rows = spark.createDataFrame([(1, "b a b", "T"), (2, None, None), (3, "", "x x")], "doc_id long, text string, title string")
    from docquery.functions.text import simple_tokens

    got = index.build(rows, {"text": simple_tokens("text"), "title": simple_tokens("title")}).drop("bucket").collect()
    assert sorted((r.doc_id, r.field, r.term or "", r.tf, list(r.positions), r.dl, r.n_chars) for r in got) == sorted([
        (1, "text", "a", 1, [1], 3, 5), (1, "text", "b", 2, [0, 2], 3, 5), (1, "title", "t", 1, [0], 1, 5), (3, "title", "x", 2, [0, 1], 2, 0),
        *[(d, f, "", 0, [], n, c) for d, f, n, c in [(1, "text", 3, 5), (1, "title", 1, 5), (2, "text", 0, 0), (2, "title", 0, 0), (3, "text", 0, 0), (3, "title", 2, 0)]],
    ])
    assert got and index.build(rows.filter(F.lit(False))).count() == 0
