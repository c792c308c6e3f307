from tests.llm.test_dedup_and_leaks import brute_groups, brute_scan
from tests.llm.test_substring_dedup import brute
from tests.llm.test_tokens import check_packing


def test_stages_against_brute_force(spark, sf):
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from docquery.llm import common, tokens

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34 !!", "en", "s", 8), (10**6 + 2, docs.first().text, None, None, None), (10**6 + 3, "", None, None, 0)], docs.schema)
    start = docs.union(extra)
    assert [n for n, _ in p.STAGES] == ["language_id", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    kept = common.stored(p.language_id(spark, start, sf), "a")
    assert kept.schema == start.schema
    ids = {r.doc_id for r in kept.collect()}
    assert {r.doc_id for r in start.collect()} - ids == {10**6, 10**6 + 1, 10**6 + 3}

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    near = common.stored(p.minhash_near_dedup(spark, kept, sf), "b")
    assert {r.doc_id for r in near.collect()} == {c for _, _, c in brute_groups(rows, 5, 80)} and near.schema == start.schema

    rows = [(r.doc_id, r.text) for r in near.collect()]
    cut = common.stored(p.suffix_array_dedup(spark, near, sf), "c")
    want = brute(rows, 100)
    got = {r.doc_id: r for r in cut.collect()}
    assert cut.schema == start.schema
    for doc, text in rows:
        n_bytes, n_removed, n_spans, _ = want[repr(doc)][0]
        if n_removed == n_bytes and n_bytes:
            assert doc not in got
        elif not n_removed:
            assert got[doc].text == text
        else:
            assert n_bytes - n_removed <= len(got[doc].text.encode()) <= n_bytes - n_removed + 6 * n_spans and got[doc].n_chars == len(got[doc].text)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = common.stored(p.benchmark_decontamination(spark, cut, sf), "d")
    assert {r.doc_id for r in clean.collect()} == {d for d, _, _, _, _, bad in brute_scan([(r.doc_id, r.text) for r in cut.collect()], items) if not bad}

    out = p.best_fit_packing(spark, clean, sf).collect()
    check_packing(out, [(r.doc_id, r.text) for r in clean.collect()], Tokenizer.from_file(tokens.default_path()))
    assert p.run(spark, sf).count() > 0


def test_empty_and_extra_columns(spark, sf):
    import corpus_pipeline as p
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit("x")).withColumn("node", F.lit(1)).withColumn("start", F.array(F.lit(2))).withColumn("row", F.lit(None).cast("string"))
    for data in (docs.limit(0), docs.limit(5)):
        for name, stage in p.STAGES:
            out = stage(spark, data, sf)
            assert out.count() == data.count() or data.count()
            assert name == "best_fit_packing" or out.columns == data.columns


def test_rows_that_share_a_doc_id_or_have_none(spark, sf):
    import random

    import corpus_pipeline as p

    rng = random.Random(5)
    say = lambda n: " ".join(f"{rng.randrange(10**7):07d}" for _ in range(n))

    def run(stage, rows):
        docs = spark.createDataFrame([(d, t, None, None, len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        out = stage(spark, docs, sf).collect()
        assert all(r.n_chars == len(r.text) for r in out)
        return sorted(((r.doc_id, r.text) for r in out), key=str)

    a, b, c, d, e, f = (say(60) for _ in range(6))
    near = lambda t, x: f"{t[:-7]}{x:07d}"
    rows = [(1, a), (5, near(a, 1)), (5, b), (None, near(a, 2)), (None, c), (None, c), (None, d), (7, near(e, 1)), (7, near(e, 2)), (3, f), (3, f), (3, f), (8, ""), (None, ""), (None, "")]
    got = run(p.minhash_near_dedup, rows)
    assert len([t for i, t in got if i == 7]) == 1
    assert [x for x in got if x[0] != 7] == sorted([(1, a), (5, b), (None, c), (None, d), (3, f), (8, ""), (None, ""), (None, "")], key=str)

    passage, own, again, between = f"{say(20)}<", f">{say(20)}", f"{say(20)}<", f">{say(20)}|"
    twice = again + between + again
    rows = [(1, f"{passage}{say(3)}"), (2, passage + own), (2, say(80)[: len(passage + own)]), (None, twice), (None, say(80)[: len(twice)])]
    assert run(p.suffix_array_dedup, rows) == sorted([rows[0], (2, own), rows[2], (None, again + between), rows[4]], key=str)

    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(4, f"{say(3)} {item}"), (4, b), (None, item), (None, c), (6, d)]
    assert run(p.benchmark_decontamination, rows) == sorted([(4, b), (None, c), (6, d)], key=str)
