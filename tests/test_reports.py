import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquery.operators import evaluate, upkeep
from docquery.sources import report


def test_two_runs_write_the_same_bytes(spark, tmp_path):
    rows = spark.range(50).select((F.col("id") % 7).alias("slice"), (F.col("id") / 3).alias("ndcg"), F.lit(None).cast("string").alias("note"), F.rand().alias("latency_ms"))
    path = f"file://{tmp_path}/r/report.json"
    report.write_report(rows, path, {"name": "é", "started_at": 1})
    first = (tmp_path / "r/report.json").read_bytes()
    report.write_report(rows.repartition(5), path, {"started_at": 2, "name": "é"})
    assert (tmp_path / "r/report.json").read_bytes() == first and [p.name for p in (tmp_path / "r").iterdir()] == ["report.json"]
    assert b"latency_ms" not in first and b'"note": null' in first and "é".encode() in first
    report.write_report(rows.limit(0), path)
    assert (tmp_path / "r/report.json").read_text() == '{\n  "rows": []\n}\n'


def test_canonical():
    assert report.canonical({"b": [{"run_id": 1, "a": 2}], "a": None}) == report.canonical({"a": None, "b": [{"a": 2, "run_id": 9}]})
    with pytest.raises(ValueError):
        report.canonical({"a": float("nan")})


@pytest.mark.parametrize("rows_a_block", [10_000, 8])
def test_skyline_brute(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(evaluate, "SKYLINE_ROWS", rows_a_block)
    rng = random.Random(4)
    data = [(i, rng.choice("ab"), float(rng.randint(0, 8)), float(rng.randint(0, 8)), rng.randint(0, 8)) for i in range(300)]
    data += [(1000 + i, None, 1.0, 1.0, 1) for i in range(3)] + [(2000, "a", None, 0.0, 0), (2001, "a", float("nan"), 0.0, 0)]
    df = spark.createDataFrame(data, "id int, g string, quality double, cost double, latency int")
    got = {r.id for r in evaluate.skyline(df, "quality", "cost", "latency", "g").collect()}
    rows = data[:303]
    beats = lambda o, p: o[1] == p[1] and o[2] >= p[2] and o[3] <= p[3] and o[4] <= p[4] and o[2:] != p[2:]
    assert got == {p[0] for p in rows if not any(beats(o, p) for o in rows)}
    assert evaluate.skyline(df.limit(0), "quality", "cost", "latency", "g").count() == 0


def test_sweep_of_points_that_all_stay():
    x = np.arange(500.0)
    assert evaluate._sweep(np.column_stack([x, x, np.zeros(500)])).all() and evaluate._sweep(np.column_stack([-x, x, x])).sum() == 1


def test_set_digest(spark):
    rows = [(p, i, f"h{i % 5}") for p in "ab" for i in range(40)] + [("c", None, None), ("d", 1, "x")]
    digest = lambda data: {r.p: r.digest for r in upkeep.set_digest(spark.createDataFrame(data, "p string, i int, h string"), "p", "i", "h").collect()}
    base = digest(rows)
    assert digest(rows[::-1]) == base and base["a"] == base["b"] and len(set(base.values())) == 3
    for other in (rows[1:], [("a", 0, "h1"), *rows[1:]], [*rows, ("a", 0, "h0")], [("a", 100, "h0"), *rows[1:]]):
        assert digest(other)["a"] != base["a"]
