import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquery.operators import catalog, dense, evaluate, index, judge, lexical, ranking, upkeep
from docquery.sources import files, store
from docquery.streaming import debounce


def test_scan(spark, tmp_path):
    for name, content in {"a.md": b"hi", "sub/B.MD": b"x", "node_modules/c.md": b"n", "sub/.hidden/d.md": b"h", "t.txt": b"t", "bad.md": b"\xff\xfe", "big.md": b"y" * 50}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r.rel_path: (r.text, r.warning) for r in files.scan(spark, str(tmp_path), 40).collect()}
    assert got == {"a.md": ("hi", None), "sub/B.MD": ("x", None), "bad.md": (None, "not UTF-8"), "big.md": (None, "too large")}
    assert {r.rel_path for r in files.scan(spark, str(tmp_path), recursive=False).collect()} == {"a.md", "bad.md", "big.md"}
    (tmp_path / ".gitignore").write_text("# out\nb*.md\n!big.md\nsub/\n")
    assert {r.rel_path for r in files.scan(spark, str(tmp_path)).collect()} == {"a.md", "big.md"}
    assert {r.rel_path for r in files.scan(spark, str(tmp_path), patterns=["/a.md"]).collect()} == {"big.md"}
    (one,) = files.one_document(files.scan(spark, str(tmp_path)), "a.md").collect()
    assert tuple(one) == ("a.md", "hi", 2, 1)
    for bad in ("", "/a.md", "../a.md", "x/../../a.md", "a.txt", "c:/a.md"):
        with pytest.raises(ValueError, match="not a document"):
            files.inside("/root", bad)
    with pytest.raises(ValueError, match="leaves the root"):
        files.ignored(F.col("x"), ["../x"])
    paths = ["a/b/c.md", "c.md", "a/c.md", "docs/x/y.md", "docs/y.md"]
    hit = lambda p: [x for x in paths if spark.range(1).select(files.ignored(F.lit(x), [p])).first()[0]]
    assert hit("c.md") == paths[:3] and hit("/c.md") == ["c.md"] and hit("a/**/c.md") == ["a/b/c.md", "a/c.md"] and hit("docs/*.md") == ["docs/y.md"] and hit("docs/**") == paths[3:] and hit("?.md") == paths[:3] + paths[3:]


def test_generations(spark, tmp_path):
    root = str(tmp_path / "store")
    assert store.generation(spark, root) == 0 and store.commit(spark, root, {}) == 0
    assert store.commit(spark, root, {"docs": spark.range(3), "chunks": spark.range(2)}) == 1
    assert store.commit(spark, root, {"docs": spark.range(5)}) == 2
    assert store.read(spark, root, "docs").count() == 5 and store.read(spark, root, "docs", 1).count() == 3 and store.read(spark, root, "chunks").count() == 2
    with pytest.raises(KeyError):
        store.read(spark, root, "absent")


def stored(spark, tmp_path, docs, fields=None):
    index.write(spark, f"file://{tmp_path}/index", docs, fields)
    return index.Index(spark, f"file://{tmp_path}/index")


def test_boost_free_bm25_orders_by_rarity(spark, tmp_path):
    docs = spark.createDataFrame([(1, "rare common"), (2, "common common"), (3, "other"), (4, "rare " + "x " * 900)], "doc_id long, text string")
    built = stored(spark, tmp_path, docs)
    q = spark.createDataFrame([(1, ["rare", "common"])], "query_id int, terms array<string>")
    got = {r.doc_id: r.score for r in lexical.bm25(built, q).collect()}
    assert set(got) == {1, 2, 4} and got[1] > got[2]
    scoped = {r.doc_id: r.score for r in lexical.bm25(built, q, docs.filter("doc_id = 1")).collect()}
    assert scoped == {1: got[1]}
    # words of another spelling are clauses of their own, equal ones are not
    texts = spark.createDataFrame([(1, "common"), (2, "COMMON common"), (3, "common common")], "query_id int, text string")
    terms = texts.select("query_id", lexical.words_as_terms("text").alias("terms"))
    by = {(r.query_id, r.doc_id): r.score for r in lexical.bm25(built, terms).collect()}
    assert by[2, 1] == pytest.approx(2 * by[1, 1]) and by[3, 1] == by[1, 1]


def test_index_generations(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    first = stored(spark, tmp_path, docs)
    second = stored(spark, tmp_path, docs.filter("doc_id = 2"))
    assert second.generation > first.generation
    assert first.df.filter("term = 'b'").first().df == 2 and second.df.filter("term = 'b'").first().df == 1
    assert [r.doc_id for r in first.of(["a"]).collect()] == [1] and second.of(["a"]).count() == 0
    empty = stored(spark, tmp_path, docs.limit(0))
    q = spark.createDataFrame([(1, ["a"])], "query_id int, terms array<string>")
    assert lexical.bm25(empty, q).count() == 0


def test_phrases_brute_force(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    phrases = [tuple(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(25)]
    built = stored(spark, tmp_path, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {(r.phrase_id, r.doc_id): r.n for r in lexical.phrase_matches(built, spark.createDataFrame([(i, list(p)) for i, p in enumerate(phrases)], "phrase_id int, terms array<string>")).collect()}
    want = {}
    for i, p in enumerate(phrases):
        for d, t in enumerate(texts):
            w = t.split()
            if n := sum(tuple(w[k : k + len(p)]) == p for k in range(len(w) - len(p) + 1)):
                want[i, d] = n
    assert got == want


def test_lru_counts_leases_first(spark):
    rows = [("m", k, k, 10) for k in range(5)]
    entries = spark.createDataFrame(rows, "model_id string, key long, used_at long, bytes long")
    leases = spark.createDataFrame([("m", 0, 100), ("m", 1, 5)], "model_id string, key long, expires_at long")
    kept = lambda *a: sorted(r.key for r in catalog.lru_keep(entries, *a).collect())
    assert kept(3, 1000, leases, 10) == [0, 3, 4] and kept(3, 1000, leases, 2) == [0, 1, 4] and kept(3, 1000) == [2, 3, 4]
    assert kept(1, 1000, leases, 2) == [0, 1] and kept(9, 30, leases, 10) == [0, 3, 4]


def test_rrf_ties(spark):
    lists = "query_id int, doc_id long, rank int, score double"
    a = spark.createDataFrame([(1, 10, 1, 5.0), (1, 11, 2, 4.0), (1, 10, 3, 1.0)], lists)
    b = spark.createDataFrame([(1, 12, 1, 0.9), (1, 11, 2, 0.8)], lists)
    got = ranking.rrf(a, b).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [11, 10, 12]
    assert abs(got[0].score - 2 / 62) < 1e-9


def test_cosine_brute_force(spark):
    rng = np.random.default_rng(0)
    data = [(i, rng.normal(size=16).round(1).tolist()) for i in range(300)] + [(300 + i, [1.0] * 16) for i in range(20)]
    df = spark.createDataFrame([*data, (900, [0.0] * 16), (901, None)], "vec_id long, embedding array<float>").repartition(3)
    queries = df.filter("vec_id % 30 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in dense.cosine_top_k(df, queries, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    every = {i: np.array(v, np.float32).astype(float) for i, v in [*data, (900, [0.0] * 16)]}
    unit = {i: v / np.linalg.norm(v) if v.any() else v for i, v in every.items()}
    assert got == {q: [i for _, i in sorted((-round(float(unit[q] @ v), 9), i) for i, v in unit.items() if i != q)[:5]] for q in every if q % 30 == 0}
    with pytest.raises(Exception, match="matmul|shape|size|mismatch"):
        dense.cosine_top_k(df, spark.createDataFrame([(0, [1.0] * 3)], "query_id long, embedding array<float>"), 5).collect()


def test_embed_missing(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "doc_id long, text string").filter("text IS NOT NULL")
    known = texts.filter("text = 'b'").select(F.sha2("text", 256).alias("chunk_hash"), F.array(F.lit(9.0).cast("float"), F.lit(9.0).cast("float")).alias("vector"))
    out = dense.embed_missing(texts, known, lambda ts: [[float(len(t)), 0.0] for t in ts], 2).collect()
    assert sorted(tuple(r.vector) for r in out) == [(1.0, 0.0), (9.0, 9.0)]
    with pytest.raises(Exception, match="wrong length"):
        dense.embed_missing(texts, known, lambda ts: [[1.0]] * len(ts), 2).collect()


def test_neighbours_cap(spark):
    c = spark.createDataFrame([(1, i, "h", "t") for i in range(5)], "doc_id long, seq long, heading_path string, text string")
    got = catalog.neighbours(c, c.filter("seq = 0"), 1, 2).collect()
    assert sorted(r.seq for r in got) == [0, 1, 2]
    assert catalog.has_tags(spark.createDataFrame([(1, ["a", "b"]), (2, None)], "doc_id long, tags array<string>"), ["a"]).count() == 1


def test_pareto_brute(spark):
    rng = random.Random(1)
    points = [(rng.randint(0, 2), i, rng.randint(0, 9), rng.randint(0, 9)) for i in range(120)]
    df = spark.createDataFrame(points, "g int, id int, quality int, cost int")
    beats = lambda o, p: o[0] == p[0] and o[2] >= p[2] and o[3] <= p[3] and o[2:] != p[2:]
    want = {p[1] for p in points if not any(beats(o, p) for o in points)}
    assert {r.id for r in evaluate.pareto(df, "quality", "cost", "g").collect()} == want


def test_batches_brute(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    events = [(rng.choice("ab"), rng.choice("xyz"), start + timedelta(milliseconds=rng.randint(0, 20000))) for _ in range(120)]
    got = sorted((r.key, r.batch, r.events, r.paths) for r in debounce.batches(spark.createDataFrame(events, "key string, path string, ts timestamp"), 0.3, 0.8).collect())
    want = []
    for key in "ab":
        open_, n = [], 0
        for ts, path in sorted((t, p) for k, p, t in events if k == key):
            if open_ and ((ts - open_[-1][0]).total_seconds() > 0.3 or (ts - open_[0][0]).total_seconds() > 0.8):
                n += 1
                want.append((key, n, len(open_), len({p for _, p in open_})))
                open_ = []
            open_.append((ts, path))
        want.append((key, n + 1, len(open_), len({p for _, p in open_})))
    assert got == want


def test_bootstrap_interval(spark):
    """The same generator, step by step, on one slice; a slice without spread has its mean as both ends."""
    rng = random.Random(8)
    deltas = [rng.uniform(-1, 1) for _ in range(6)]
    rows = [("x", f"c{i}", 0.0, d) for i, d in enumerate(deltas)] + [("y", "c0", 1.0, 3.0), ("y", "c1", 0.0, 2.0)]
    got = {r.slice: (r.low, r.high) for r in judge.bootstrap(spark.createDataFrame(rows, "slice string, case_id string, a double, b double")).collect()}
    state, means = judge.SEED, []
    for _ in range(1000):
        total = 0.0
        for _ in range(6):
            state ^= state >> 12
            state = (state ^ (state << 25)) % 2**64
            state ^= state >> 27
            total += deltas[state * 0x2545F4914F6CDD1D % 2**64 % 6]
        means.append(total / 6)
    means.sort()
    assert got["x"] == pytest.approx((means[24], means[974])) and got["y"] == (2.0, 2.0)


def test_drift_and_missing_configurations(spark):
    shape = "config string, slice string, case_id string, hit boolean, ndcg double, forbidden_hit boolean, recall double, mrr double"
    base = [("a", "s", "1", True, 1.0, False, 1.0, 1.0), ("a", "t", "2", True, 0.9, False, 1.0, 1.0), ("b", "s", "1", True, 1.0, False, 1.0, 1.0)]
    current = [("a", "s", "1", False, 0.5, True, 0.0, 0.0), ("a", "u", "2", True, 0.9, False, 1.0, 1.0), ("c", "s", "1", True, 1.0, False, 1.0, 1.0)]
    got = {tuple(r) for r in judge.regressions(spark.createDataFrame(base, shape), spark.createDataFrame(current, shape)).collect()}
    assert got == {
        ("a", "s", "1", "ForbiddenHit"), ("a", "s", "1", "HitDrop"), ("a", "s", "1", "NdcgDrop"), ("a", "s", None, "SliceHitRateDrop"), ("a", "s", None, "SliceNdcgDrop"),
        ("a", "t", None, "CaseDrift"), ("a", "u", None, "CaseDrift"), ("b", None, None, "MissingConfig"), ("c", None, None, "CaseDrift"),
    }
    half = spark.createDataFrame(base[:2], shape)
    assert judge.paired(half, half.filter("slice = 's'")).count() == 1


def test_guards(spark):
    rows = spark.createDataFrame([(1, 4), (2, 4)], "doc_id long, generation long")
    assert upkeep.same_generation(rows, 4).count() == 2
    with pytest.raises(Exception, match="retry"):
        upkeep.same_generation(rows, 5).collect()
    assert upkeep.distinct_required(rows, "doc_id").count() == 2
    with pytest.raises(Exception, match="repeated"):
        upkeep.distinct_required(rows.union(rows), "doc_id").collect()
    stored_paths = spark.createDataFrame([("a/x.md",), ("b/y.md",)], "rel_path string")
    none = spark.createDataFrame([], "error string")
    assert [r.rel_path for r in upkeep.survey_removals(stored_paths, stored_paths.limit(1), none).collect()] == ["b/y.md"]
    assert upkeep.survey_removals(stored_paths, stored_paths.limit(1), spark.createDataFrame([("x",)], "error string")).count() == 0
    assert upkeep.nested_prefixes(["a/*.md"]) == ["a/*.md"]
    with pytest.raises(ValueError, match="leaves the root"):
        upkeep.nested_prefixes(["a/../../b"])
