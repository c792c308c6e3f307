import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docquery.llm import merkle, ranks
from tests.llm.oracle import compare


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def above(nodes):
    return [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]


def fold(nodes, at, new):
    """The siblings of node `at` up to the root of nodes, and the root with another node there."""
    seen = []
    while len(nodes) > 1:
        run = at - at % 2
        pair = nodes[run : run + 2]
        seen += [n for i, n in enumerate(pair) if run + i != at]
        pair[at % 2] = new
        nodes, at, new = above(nodes), at // 2, H(*pair)
    return seen, nodes[0], new


def brute(docs):
    by = {}
    for d in docs:
        by.setdefault(d[2], []).append((d[0] is not None, d[0] or 0, leaf(*d), d))
    by = {k: sorted(v, key=lambda x: x[:3]) for k, v in by.items()}
    langs = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    subroots = [fold([m[2] for m in by[k]], 0, "")[1] for k in langs]
    out = []
    for j, k in enumerate(langs):
        nodes = [m[2] for m in by[k]]
        for i, (_, _, own, d) in enumerate(by[k]):
            hit = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 and d[3] is not None
            seen, sub, changed = fold(nodes, i, leaf(*d[:3], d[3] + 1, d[4]) if hit else own)
            over, root, folded = fold(subroots, j, changed)
            out.append((d[0], own, sub, root, H(*seen, *over), folded, folded == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string"


def documents(n):
    docs = [(i * 3, f"s{i % 4}", [None, "en", "de", "zh", "é", "￿", "\U0001f600"][min(i % 11, 6)], i if i % 9 else None, "tëxt " * (i % 50)) for i in range(n)]
    docs += [(None, None, None, None, None), (None, None, None, None, None), (None, "", "", 0, ""), (3, "s", "en", 1, "other"), (3, "s", "en", 1, "other"), (1, "s", "alone", 2**63 - 1, "y" * 100000), (-5, "s", "de", 5, "z")]
    return docs


@pytest.mark.parametrize("levels,n", [(8, 700), (1, 90), (2, 300), (8, 0)])
def test_manifest_brute_force(spark, monkeypatch, levels, n):
    monkeypatch.setattr(ranks, "TASK_ROWS", 60)
    docs = documents(n)
    rows = merkle.manifest(spark.createDataFrame([(*d, "x") for d in docs], SCHEMA), levels).drop("copied").collect()
    assert Counter(map(tuple, rows)) == Counter(brute(docs))
    assert any(not r.verified for r in rows) or n == 0


@pytest.mark.parametrize("docs", [[], [(1, "s", "en", 3, "abc")], [(1, "s", "en", 3, "abc"), (2, "s", "en", 3, "abd")], [(1, "s", None, None, None), (2, "s", "en", 3, "abd"), (3, "s", "fr", 3, "")]])
def test_small_trees(spark, docs):
    rows = merkle.manifest(spark.createDataFrame([(*d, "x") for d in docs], SCHEMA)).drop("copied").collect()
    assert Counter(map(tuple, rows)) == Counter(brute(docs))


def test_a_version_copies_its_path_alone():
    """Putting the copied nodes into the old tree gives the tree built anew; no other node differs."""
    for of in (1, 2, 3, 7, 100, 255, 256):
        leaves = [H(str(i)) for i in range(of)]
        levels = merkle.block_levels(leaves, of)
        for at in {0, of // 2, of - 1}:
            copied = merkle.copied_path(H("new"), merkle.siblings(levels, at))
            again = merkle.block_levels([*leaves[:at], H("new"), *leaves[at + 1 :]], of)
            for k, (old, new) in enumerate(zip(levels, again, strict=True)):
                assert [i for i, (a, b) in enumerate(zip(old, new, strict=True)) if a != b] == [at >> k] and new[at >> k] == copied[k]


def test_copied_nodes_are_those_of_changed_leaves(spark, sf):
    df = merkle.manifest(spark.read.parquet(f"{sf}/documents.parquet"))
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    assert df.filter(hit != F.col("copied").isNotNull()).count() == 0
    assert df.filter(F.col("copied").isNotNull() & (F.element_at("copied", -1) != F.col("folded_root"))).count() == 0
    assert df.filter(hit == F.col("verified")).count() == 0


def test_equals_sql(spark, sf):
    compare(spark, sf, merkle.op12_merkle_manifest, merkle.ORACLE)
