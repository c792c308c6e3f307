import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docquery.llm import conversations as trie
from docquery.llm import ranks
from tests.llm.oracle import compare

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rebuilt(rows):
    turns = defaultdict(list)
    for c, t, r, x, _ in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in turns.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = [*own.get(base, [])[:h], *v[h:]]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(k[:-1] for k in members if k)
    saved, leaves = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1].encode()) if k else 0)
            leaves[k[:d]] += children[k] == 0
    return Counter((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], sha(",".join(map(str, ends[k])))) for k, m in members.items())


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["é", "ab", "", "x" * 40]
    rows = []
    for c in range(-7, n):
        if rng.random() < 0.2:
            continue
        for t in range(rng.choice([1, 2, 3, 5, 12, 20])):
            shared = rng.random() < 0.75
            rows.append((c, t * 2, rng.choice(["user", "bot"]) if rng.random() < 0.2 else "user", words[t % 4] if shared else f"own {c} {t}", "x"))
    rows += [(1000 + i, t, "user", f"copy {t}", "x") for i in range(60) for t in range(11)]
    rows += [(2000, t, "user", f"turn {t % 7}", "x") for t in range(900)] + [(2004, t, "user", f"turn {t % 7}", "x") for t in range(870)]
    rows += [(3000, None, None, None, "x"), (3000, None, None, None, "x"), (3000, 4, None, "b", "x"), (3001, None, "", "", "x"), (None, 1, "user", "a", "x"), (None, None, None, None, None)]
    rows += [(c, 0, "user", "alone", "x") for c in (4001, 4002, 4003, 4004, 4006)] + [(9, 3, "user", "same", "x")] * 30
    rng.shuffle(rows)
    return rows


def counted(df):
    return Counter(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def built(df, **more):
    base = F.col("conv_id") - F.col("conv_id") % 5
    return trie.conversation_trie(df, base, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9, **more)


@pytest.mark.parametrize("rows_a_task,most_cells", [(200_000, 1 << 25), (150, trie.CELL_BLOCK)])
def test_trie_brute_force(spark, monkeypatch, rows_a_task, most_cells):
    """With several tasks a long conversation lies in many of them; block sizes of the driver's steps are small."""
    monkeypatch.setattr(ranks, "TASK_ROWS", rows_a_task)
    monkeypatch.setattr(trie, "CHAIN_BLOCK", 16)
    rows = corpus(120, 5)
    assert counted(built(spark.createDataFrame(rows, SCHEMA), most_cells=most_cells)) == brute(rebuilt(rows))


def test_crowded_sketch_changes_no_result(spark, monkeypatch):
    """With few cells hardly a prefix is proven unshared."""
    rows = [(c, t, "user", f"{c} {t}" if t else "first", "x") for c in range(3000) for t in range(12)]
    convs = {c: [("user", f"{c} {t}" if t else "first") for t in range(12)] for c in range(3000)}
    df = spark.createDataFrame(rows, SCHEMA)
    prefixes, list_ = trie.rebuilt(trie.placed(df))
    alone = trie.screened(prefixes, trie.CELL_BLOCK).filter("alone").count()
    wide = trie.screened(prefixes).filter("alone").count()
    assert alone < 0.5 * wide and wide > 0.8 * 33000
    assert counted(trie.trie(prefixes, list_, trie.CELL_BLOCK)) == brute(convs)


def test_proven_prefixes_are_unshared(spark):
    rows = corpus(200, 8)
    seen = trie.screened(trie.rebuilt(trie.placed(spark.createDataFrame(rows, SCHEMA)))[0])
    shared = seen.groupBy("depth", "p1", "p2").agg(F.count("*").alias("k"), F.max("alone").alias("alone"))
    assert shared.filter("alone AND k > 1").count() == 0 and shared.filter("k > 1").count() > 10


def test_long_chains_of_chains(spark):
    """Each conversation leaves the one before it a turn later, so chains hang on chains."""
    convs = {i: [("u", str(j)) for j in range(i)] + [("u", f"end {i}")] for i in range(1, 60)}
    convs = dict(enumerate((convs[i] for i in sorted(convs)), 1))
    rows = [(c, t, r, x, "x") for c, v in convs.items() for t, (r, x) in enumerate(v)]
    assert counted(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(convs)


def test_nothing(spark):
    assert built(spark.createDataFrame([], SCHEMA)).count() == 0
    assert counted(built(spark.createDataFrame([(7, None, None, None, None)], SCHEMA))) == brute(rebuilt([(7, None, None, None, None)]))


def test_equals_sql(spark, sf):
    compare(spark, sf, trie.op11_conversation_trie, trie.ORACLE)
