import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docquery.llm import quality


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    x, bag, y = rng.normal(size=(9, quality.WIDTH)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3]), np.array([1.0, 0, 1, 0])
    net = quality.Network.start()
    score, kept = net.forward(x, bag, 4)
    grad = net.gradient(score, y, kept)

    def loss():
        s, _ = net.forward(x, bag, 4)
        return float(-(y * np.log(s) + (1 - y) * np.log(1 - s)).mean())

    for name, g in grad.items():
        at = tuple(rng.integers(0, n) for n in g.shape)
        net.p[name][at] += 1e-5
        up = loss()
        net.p[name][at] -= 2e-5
        down = loss()
        net.p[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_passages_cover_whole_texts():
    texts = ["", None, "a" * 1300, "Hello, WORLD 42!"]
    x, per = quality.passages(pa.array(texts, pa.string()))
    assert per.tolist() == [1, 1, 3, 1] and x.shape == (6, quality.WIDTH)
    assert np.allclose(np.expm1(x[:, -1]), [0, 0, 512, 512, 276, 16], atol=1e-2)


def test_passages_against_plain_counts():
    texts = ["", None, "Hello, WORLD! 42 " * 90, "日本語 the the THE", "a" * 513, "x y" * 300]
    kinds = quality.KINDS.tolist()
    want, n_passages = [], []
    for text in texts:
        raw = (text or "").encode()
        cut = [raw[i : i + 512] for i in range(0, len(raw), 512)] or [b""]
        n_passages.append(len(cut))
        for p in cut:
            row = [0.0] * quality.WIDTH
            for a, b in zip(p, p[1:], strict=False):
                row[kinds[a] * 14 + kinds[b]] += 1 / len(p)
            for b in p:
                row[196 + ((b + 32 if 65 <= b <= 90 else b) & 31)] += 1 / len(p)
            words = "".join(chr(b) if b > 32 else " " for b in p).split(" ")
            words = [w for w in words if w]
            row[228] = len(set(words)) / max(1, len(words))
            row[229] = np.log1p(len(p) / max(1, len(words))) if p else 0.0
            row[230] = np.log1p(len(p))
            want.append(row)
    for part in (1, 600, 2000, 1 << 18):
        x, per = quality.passages(pa.array(texts, pa.string()), part)
        assert per.tolist() == n_passages and np.allclose(x, want, atol=1e-5)


def test_forward_against_plain_loops():
    rng = np.random.default_rng(1)
    net = quality.Network.start(2)
    bags = [rng.normal(size=(k, quality.WIDTH)) for k in (1, 4, 2)]
    got, _ = net.forward(np.concatenate(bags), np.repeat(np.arange(3), [1, 4, 2]), 3)
    p = net.p
    for bag, score in zip(bags, got, strict=True):
        h = [np.tanh(x @ p["We"] + p["be"]) for x in bag]
        e = [float((np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"]) for v in h]
        a = [np.exp(v) / sum(np.exp(e)) for v in e]
        z = sum(u * v for u, v in zip(a, h, strict=True))
        assert abs(1 / (1 + np.exp(-float(z @ p["c"] + p["b"][0]))) - score) < 1e-9


def test_held_out_accuracy(spark, sf):
    got = {r.doc_id: r for r in quality.op5_quality_classifier(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sum(got[r.doc_id].predicted == r.quality for r in labels) >= 0.85 * len(labels)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "good text here.", 5), (2, "B@D!!", 5), (3, None, 5), (3, None, 5), (None, "x", 5), (4, "", None), (5, "long " * 50000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 1), (9, 1, 1), (None, 1, 1), (4, 7, 0)], "doc_id long, quality int, text int")
    out = quality.score(docs, labels, F.lit(True)).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality.score(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality.score(docs.limit(0), labels, F.lit(True)).count() == 0
