import re

import pytest

from docquery.llm import decontamination, near_dedup, queries
from tests.llm.oracle import compare

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name, sf):
    compare(spark, sf, queries.QUERIES[name], queries.ORACLE_SQL[name])


def brute_groups(data, size, percent):
    sets = {}
    for doc, text in data:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[doc] = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(d, len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize(("small", "block"), [(64, 256), (2, 4), (2, 1000)])
def test_near_dedup_brute_force(spark, monkeypatch, small, block):
    import random

    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small)
    monkeypatch.setattr(near_dedup, "BLOCK", block)

    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    data = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE\ttwo"), (1005, "one two three"), (1006, "x" * 100_000)]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([5, 8, 60, 200]))]
        for c in range(14):
            copy = [w if rng.random() > c * 0.006 else rng.choice(words) for w in base]
            data.append((g * 50 + c, " ".join(copy)))
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in data], "doc_id long, text string, node string, n long")
    got = near_dedup.link(df, 4, 80).collect()
    assert {tuple(r) for r in got} == brute_groups(data, 4, 80) and len(got) == len(data)


def test_near_dedup_edges(spark):
    schema = "doc_id long, text string"
    assert near_dedup.link(spark.createDataFrame([], schema)).count() == 0
    same = [(3, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    got = sorted(((r.doc_id, r.component_id) for r in near_dedup.link(spark.createDataFrame(same, schema)).collect()), key=str)
    assert got == sorted([(3, 2), (3, 2), (2, 2), (None, None), (None, None)], key=str)


def brute_scan(data, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    out = []
    for doc, text in data:
        words, hit, found = split(text), set(), set()
        for item, content in items:
            w = split(content)
            size = min(window, len(w))
            for i in range(len(w) - size + 1) if w else ():
                for s in range(len(words) - size + 1):
                    if words[s : s + size] == w[i : i + size]:
                        hit.update(range(s, s + size))
                        if item is not None:
                            found.add(str(item))
        out.append((doc, len(words), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [100_000, -1])
def test_decontamination_brute_force(spark, limit):
    import random

    rng = random.Random(3)
    words = [f"W{i}" for i in range(12)] + ["é", "日本", "x-y", "the"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 9, 10, 12, 25])))) for i in range(12)] + [(50, None), (51, ""), (None, "null item here"), (5, "the the the"), (52, "the the the")]
    data = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 10, 40])))) for i in range(30)]
    data += [(100 + i, f"a b {t} c, {t}") for i, (_, t) in enumerate(items)] + [(200, None), (200, None), (None, "null item here"), (201, "THE the The the")]
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in data], "doc_id long, text string, key string, start long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.scan(docs, bench, broadcast_windows=limit).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r.item_ids), r.contaminated) for r in got), key=str) == brute_scan(data, items)
    assert decontamination.scan(docs.limit(0), bench).count() == 0
    assert decontamination.scan(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_decontamination_words(spark):
    texts = [None, "", "?", " \t.", "A", " A b", "a,\x00B\n", "x-y_z", "Éa ÀB\u00a0c", "日本。語 Z9", "a" * 3000 + "//" + "B" * 3000, "\x7f0\x2f9\x3aA\x40Z\x5ba\x60z\x7b"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = {r.n: r.words for r in df.select("n", decontamination.words_of(df.text).alias("words")).collect()}
    assert got == {n: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) for n, t in enumerate(texts)}


def test_decontamination_splits_each_text_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prefix = spark.createDataFrame([], "key string, window array<string>, len int, token string, offset int")
    plan = decontamination.occurrences(docs, prefix, True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(text") == 1 and "regexp_extract_all" not in plan
