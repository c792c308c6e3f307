import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from docquery.llm import mixing, ranks


def shared(sizes, percent=150, most=2):
    """Targets by sharing the excess again and again, as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target = sum(sizes.values()) * percent / 100, dict.fromkeys(order, 0.0)
    for _ in range(1000):
        free = [s for s in order if target[s] < most * sizes[s]]
        if left < 1e-9 or not free:
            break
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in free:
            over = max(0.0, target[s] - most * sizes[s])
            left, target[s] = left + over, target[s] - over
    return target


def folded(items):
    """The pivotal fold in plain Python over (size, p, u)."""
    held, done = None, []
    for size, p, u in items:
        if held is None:
            held = (size, p)
            continue
        hs, hp = held
        up, down = min(hs * (1 - hp), size * p), min(hs * hp, size * (1 - p))
        w = up if u * (up + down) < down else -down
        pair = [(hs, hp + w / hs), (size, p - w / size)]
        open_ = [x for x in pair if 1e-9 <= x[1] <= 1 - 1e-9]
        done += [(s, round(q)) for s, q in pair if not 1e-9 <= q <= 1 - 1e-9]
        held = open_[0] if open_ else None
    return held, done


ODD = [None, "", "  ", "a", " a b", "a\tb\x0bc\x0c", "\r\n x", "a b c", "é ü\x85z", "x" * 5000 + " y", "\x00 \x1f"]


def test_words(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "text string").select("text", mixing.word_count(F.col("text")).alias("n"))
    for r in df.collect():
        assert r.n == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r


def test_targets(spark):
    rng = random.Random(5)
    for n in (1, 2, 3, 7, 25):
        sizes = {f"s{i:02}": int(10 ** rng.uniform(0, 5)) for i in range(n)} | {"zero": 0, None: 40}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = shared(sizes)
        assert set(got) == set(want) and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)
    empty = spark.createDataFrame([("a", 0), (None, 0)], "source string, source_size long")
    assert [r.target for r in mixing.targets(empty).collect()] == [0.0, 0.0]


def test_fold_equals_plain_loop(spark):
    rng = random.Random(1)
    groups = [[(rng.randint(1, 500), rng.random(), rng.random()) for _ in range(n)] for n in (1, 2, 3, 40, 256)]
    rows = [(i, [(s, 0, p, u) for s, p, u in g]) for i, g in enumerate(groups)]
    got = spark.createDataFrame(rows, f"g int, items array<{mixing.ITEM}>").select("g", mixing.fold(F.col("items")).alias("f")).collect()
    for r in got:
        held, done = folded(groups[r.g])
        assert [(x.size, round(x.p)) for x in r.f.done] == done
        assert (r.f.held is None) == (held is None)
        if held:
            assert r.f.held.size == held[0] and math.isclose(r.f.held.p, held[1], abs_tol=1e-9)
        before = sum(s * p for s, p, _ in groups[r.g])
        assert math.isclose(before, sum(s * q for s, q in done) + (held[0] * held[1] if held else 0), rel_tol=1e-6)


def corpus(n, seed=3):
    rng = random.Random(seed)
    docs = [(i, " ".join(["w"] * int(10 ** rng.uniform(0, 2.5))), rng.choice(["a", "b", "b", "c", "d", None, "\U0001f600", "￿"]), "x") for i in range(n)]
    return docs + [(None, "a b c", "b", "x")] * 3 + [(n, t, "c", "y") for t in ODD] + [(5, "one two", "a", "z")] * 40


COLUMNS = "doc_id long, text string, source string, place string"


def test_mix(spark):
    data = corpus(3000)
    rows = mixing.mix(spark.createDataFrame(data, COLUMNS), block=16).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size, r.source) for r in rows) == Counter((d, size(t), s) for d, t, s, _ in data)
    sizes, longest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, s, _ in data:
        sizes[s] += size(t)
        longest[s] = max(longest[s], size(t))
    want = shared(sizes)
    for r in rows:
        x = want[r.source] / sizes[r.source]
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert r.taken == r.copies * r.size and (r.size == 0 or math.floor(x + 1e-9) <= r.copies <= math.ceil(x - 1e-9)) and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)


def test_reruns_agree_however_rows_are_dealt(spark, monkeypatch):
    df = spark.createDataFrame(corpus(500), COLUMNS)
    first = Counter(map(tuple, mixing.mix(df, block=8).collect()))
    monkeypatch.setattr(ranks, "TASK_ROWS", 20)
    assert Counter(map(tuple, mixing.mix(df.repartition(7), block=8).collect())) == first


def test_chances_follow_the_probabilities(spark):
    """Documents of a source are taken as often as their probability says, long ones and short ones alike."""
    rows = [(i, "w " * (1 + i % 5), "a" if i < 3000 else f"b{i % 3}") for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    r = got.filter("source = 'b2'").groupBy("size").agg(F.avg("copies").alias("c"), F.first(F.col("target") / F.col("source_size")).alias("x"), F.count("*").alias("n")).collect()
    assert all(abs(x.c - x.x) < 4 * math.sqrt(0.25 / x.n) for x in r)


def test_nothing(spark):
    df = spark.createDataFrame([], COLUMNS)
    assert mixing.mix(df).count() == 0
    assert [tuple(r) for r in mixing.mix(spark.createDataFrame([(1, None, None, "x")], COLUMNS)).collect()] == [(1, None, 0, 0, 0.0, 0, 0)]
