import math

import numpy as np
from pyspark.sql import functions as F

from docquery.llm import maxscore


def brute(data, k):
    rows = {}
    for vec, e, _ in data:
        if vec is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        w = [math.floor(64 * float(np.float32(x))) for x in e]
        rows[vec] = min(rows.get(vec, w), w)
    out = []
    for q, w in rows.items():
        if q % 3 == 0:
            best = sorted((-sum(a * b for a, b in zip(w, c, strict=False)), v) for v, c in rows.items() if v != q)[:k]
            out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(best)]
    return sorted(out)


def test_top_k_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = [(i, rng.normal(size=8).tolist(), 1) for i in range(300)]
    data += [(400 + i, data[7][1], 1) for i in range(40)] + [(500 + i, [0.0] * 8, 1) for i in range(30)]
    data += [(600, None, 1), (601, [1.0, None] * 4, 1), (602, [float("nan")] * 8, 1), (603, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (7, data[7][1], 1), (9, [9.0] * 8, 2), (604, [1.0, 2.0], 3), (606, [], 3), (609, [1e7] * 8, 3), (612, [3e6, 1.0], 3), (615, [2.0**20 - 1] * 8, 3)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, score int")
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 100)
    got = maxscore.top_k(df, F.col("vec_id") % 3 == 0, 20).collect()
    assert sorted(map(tuple, got)) == brute(data, 20)
    assert maxscore.top_k(df.limit(0), F.col("vec_id") % 3 == 0).count() == 0
    few = maxscore.top_k(df.filter("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert len(few) == 4


def test_shards_blocks_and_thresholds():
    """Shard after shard, with and without a threshold to start from, and with one that leaves whole blocks out."""
    rng = np.random.default_rng(0)
    w = rng.integers(-20, 20, (4000, 32))
    w[:200] += rng.integers(20, 60, (1, 32))
    q = w[:10] * 2
    full = q @ w.T
    shards = [maxscore.Postings(np.arange(low, low + 1000), w[low : low + 1000]) for low in range(0, 4000, 1000)]
    for i in range(10):
        want = sorted((-s, v) for v, s in enumerate(full[i].tolist()) if v != i)[:5]
        for threshold in (None, -want[-1][0] - 3, -want[-1][0]):
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            for shard in shards:
                found = maxscore.search(shard, i, q[i], 5, found, threshold)
            assert [(-s, v) for s, v in zip(*found, strict=True)] == want
    # non-essential terms are not traversed, and no vector of a block that cannot reach the threshold is
    read = []

    class Lists(np.ndarray):
        def __getitem__(self, key):
            read.append(np.asarray(super().__getitem__(key)).size)
            return np.asarray(super().__getitem__(key))

    shard = shards[0]
    typed = shard.typed(np.float32)
    shard._typed = {np.float32: (typed[0].view(Lists), *typed[1:])}
    maxscore.search(shard, 0, q[0].astype(np.int64), 5, (np.zeros(0, np.int64), np.zeros(0, np.int64)), int(np.sort(full[0][:1000])[-6]))
    assert sum(read) < 0.5 * w[:1000].size


def test_components_of_any_size(spark):
    """No finite vector is left out, and sums are exact where doubles and 64-bit products are not."""
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [2e6, 1.0])], "vec_id long, embedding array<float>")
    got = maxscore.top_k(df, F.col("vec_id") == 0).select("vec_id", "score").collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: -r.score)] == [(2, 64 * 64 * 2_000_002), (1, 64 * 64 * 5)]
    rng = np.random.default_rng(3)
    big = [(i, [float(np.float32(x)) for x in rng.choice([1.0, 3.0, 2.0**23 + 1, 2.0**40, -(2.0**40), 2.0**44 + 2.0**21], 4)], 1) for i in range(120)]
    big += [(200 + i, [float(np.float32(x)) for x in rng.normal(size=4)], 1) for i in range(100)] + [(300 + i, [float(1 << 30), 1.0, 0.0, 2.0**-7], 1) for i in range(9)]
    rows = [b for b in big if b[0] < 100 or b[0] >= 200]
    small = [(v, e if max(map(abs, e)) < 2**24 else [2.0**20 * (v % 3 - 1), x[0] if (x := e) and abs(e[0]) < 100 else 5.0, 1.0, 0.25], l) for v, e, l in rows]
    got = maxscore.top_k(spark.createDataFrame(small, "vec_id long, embedding array<float>, score int"), F.col("vec_id") % 3 == 0, 7)
    assert sorted(map(tuple, got.collect())) == brute(small, 7)
    # two wide vectors whose products are far over a long cancel out
    odd = [(0, [2.0**60, -(2.0**60), 1.0], 1), (1, [2.0**50, 2.0**50, 5.0], 1), (2, [2.0**50, 2.0**50 + 2.0**30, 5.0], 1), (4, [0.0, 0.0, 2.0], 1)]
    odd = [(v, [float(np.float32(x)) for x in e], l) for v, e, l in odd]
    got = maxscore.top_k(spark.createDataFrame(odd[:2] + odd[3:], "vec_id long, embedding array<float>, score int"), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 5 * 4096), (0, 2, 4, 2 * 4096)]
    try:
        maxscore.top_k(spark.createDataFrame(odd, "vec_id long, embedding array<float>, score int"), F.col("vec_id") == 0).collect()
    except Exception as e:
        assert "leaves the range of a long" in str(e)
    else:
        raise AssertionError("no error")
