import math

import numpy as np
from pyspark.sql import functions as F

from docquery.llm import langid


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in langid.op2_language_id(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    out = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in out) >= 0.95 * len(out)
    assert all(0 <= g.score <= 1 for g in got.values())


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score double"
    data = [(i, t, lang, 1.0) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et la souris", "fr")] * 20)]
    data += [(100, None, "en", None), (101, "", None, None), (102, "123 !!", "fr", None), (103, "the dog", None, None), (103, "the dog", None, None), (None, "le chat", None, None), (104, "la souris " * 20000, None, None), (105, "퟿ é", None, None), (106, "½ ² ① Ⅷ 12", "en", None)]
    df = spark.createDataFrame(data, schema)
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(df, ~langid.held_out()).collect()]
    assert len(got) == len(data)
    want = dict(got)
    assert want[100] == want[101] == want[102] == want[106] == "und" and want[103] == "en" and want[None] == "fr" and want[104] == "fr"
    assert langid.identify(df.limit(0), ~langid.held_out()).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled, ~langid.held_out()).collect()} == {"und"}


def test_temperature_recovers_scale():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits)
    y = np.array([rng.choice(3, p=r / r.sum()) for r in p])
    assert 2.6 < langid.temperature(3 * logits, y) < 3.4


def plain_features(text):
    """Grams one by one, with numbers of Python."""
    code = [32, *(ord(c) if ord(c) > 127 or c.isalpha() else 32 for c in text.lower()), 32]
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(code) - n + 1):
            gram = 0
            for c in code[i : i + n]:
                gram = ((gram << 21) ^ c) % 2**64
            bucket = (gram + n) * int(langid._MULTIPLIERS[n - 1]) % 2**64 >> 49
            counts[bucket] = counts.get(bucket, 0) + 1
    return {b: 1 + math.log(c) for b, c in counts.items()}


def test_features_against_plain_counts():
    for text in ("", "a", "Le Chat, 42 ÉTÉ!", "日本 ab", "x" * 50 + " Straße İstanbul"):
        for part in (1, 2, 3, 7, 1 << 20):
            at, tf = langid.features(text, part)
            want = plain_features(text)
            assert dict(zip(at.tolist(), tf.tolist(), strict=True)) == want


def test_ftrl_against_plain_loops():
    """The same steps, one coordinate and one class at a time."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        at = np.sort(rng.choice(50, 6, replace=False))
        x = rng.random(6)
        rows.append((at, x / math.sqrt(x @ x), int(at[0] % 3)))
    a, b, l1, l2 = langid.ALPHA, langid.BETA, langid.L1, langid.L2
    z, n = [{} for _ in range(3)], [{} for _ in range(3)]

    def weight(k, j):
        zj = z[k].get(j, 0.0)
        return 0.0 if abs(zj) <= l1 else -(zj - math.copysign(l1, zj)) / ((b + math.sqrt(n[k].get(j, 0.0))) / a + l2)

    for _ in range(2):
        for at, x, y in rows:
            w = [[weight(k, j) for j in at.tolist()] for k in range(3)]
            logits = [sum(u * v for u, v in zip(w[k], x.tolist(), strict=True)) for k in range(3)]
            total = sum(math.exp(v - max(logits)) for v in logits)
            for k in range(3):
                error = math.exp(logits[k] - max(logits)) / total - (k == y)
                for i, j in enumerate(at.tolist()):
                    g = error * x[i]
                    old = n[k].get(j, 0.0)
                    z[k][j] = z[k].get(j, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / a * w[k][i]
                    n[k][j] = old + g * g
    got = langid.ftrl(rows, 3, epochs=2)
    want = np.array([[weight(k, j) for j in range(50)] for k in range(3)])
    assert np.allclose(got[:, :50], want, atol=1e-6) and not got[:, 50:].any()


def test_document_frequencies_and_sample(spark):
    texts = [("the cat", "en"), ("the cat", "en"), ("le chat", "fr"), ("12", "fr"), ("une souris", "fr")]
    rows = spark.createDataFrame(texts, "text string, lang string").repartition(3)
    df, languages = langid._document_frequencies(rows)
    want = {}
    for t, _ in texts:
        for bucket in plain_features(t) if t != "12" else ():
            want[bucket] = want.get(bucket, 0) + 1
    assert languages == {"en": 2, "fr": 2} and {int(b): int(df[b]) for b in np.flatnonzero(df)} == want
    many = spark.createDataFrame([(f"{'ab'[i % 2]} {i % 40}", i % 2, i % 40) for i in range(200)], "text string, y int, h long")
    got = langid.bounded_sample(many.dropDuplicates(["h"]), "y", 7, 10**6).collect()
    assert sorted((r.y, r.h) for r in got) == sorted((y, h) for y in (0, 1) for h in range(y, 14, 2))
    assert sum(len(r.text) for r in langid.bounded_sample(many.dropDuplicates(["h"]), "y", 7, 20).collect()) <= 20


def test_a_long_text_does_not_end_the_sample(spark):
    rows = [(i, "x" * (5000 if i == 0 else 100), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "h long, text string, y int")
    got = langid.bounded_sample(df, "y", 20, 3000)
    assert sorted(r.h for r in got.collect()) == list(range(1, 31))
    assert sorted((r.y, r.h) for r in langid.bounded_sample(df, "y", 20, 10).collect()) == [(0, 2), (1, 1)]
    assert langid.bounded_sample(df.limit(0), "y", 20, 10).count() == 0


def test_small_budget_still_tells_languages_apart(spark):
    """With a budget below every text, one of each language teaches; nobody is answered the first language by name alone."""
    words = {"aa": "lorem ipsum dolor ", "bb": "zwart kwik vuur ", "cc": "être déjà çà "}
    rows = [(i, words[x] * (3 + i % 5), x) for i, x in enumerate(["aa", "bb", "cc"] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.select("text", "lang"), most_bytes=10)
    got = langid.predict(df, model).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) > 50
