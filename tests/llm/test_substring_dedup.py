import hashlib
import random

import numpy as np
import pytest

from docquery.llm import substring_dedup


def brute(data, length):
    place = {}
    texts = [(d, (t or "").encode()) for d, t in data]
    order = sorted(range(len(texts)), key=lambda i: (texts[i][0] is not None, texts[i][0] or 0))
    out = {}
    for i in order:
        doc, b = texts[i]
        for s in range(len(b) - length + 1):
            place.setdefault(b[s : s + length], (doc, s))
    for i in order:
        doc, b = texts[i]
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if place[b[s : s + length]] != (doc, s):
                gone[s : s + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.setdefault(repr(doc), []).append((len(b), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def run(spark, data, length, gram, piece=substring_dedup.PIECE):
    df = spark.createDataFrame([(d, t, 1, "b") for d, t in data], "doc_id long, text string, start int, bytes string").repartition(3, "doc_id")
    out = {}
    for r in substring_dedup.remove_repeats(df, length, gram, piece=piece).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
        assert r.n_removed - 6 * r.n_spans <= r.n_bytes - len(r.text.encode()) <= r.n_removed
        out.setdefault(repr(r.doc_id), []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("piece", [substring_dedup.PIECE, 64])
def test_brute_force(spark, piece):
    """Also with long texts hashed in parts, here of 64 bytes."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(6)]
    data = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 12)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : a + rng.randint(10, 120)], word()]
        data.append((i * 7 % 100, "".join(parts)))
    data += [(200, data[3][1]), (201, data[3][1]), (202, "a" * 400), (203, "ab" * 200), (204, None), (205, ""), (206, "short"), (207, "short"), (204, None), (300, data[5][1]), (300, data[5][1]), (None, data[8][1]), (301, "xyz" + "é" * 200), (302, "z" * 3 + "q".join(["é" * 200] * 2))]
    assert run(spark, data, 40, 12, piece) == brute(data, 40)


def test_threshold_edges(spark):
    base = "".join(random.Random(9).choice("abcdefgh") for _ in range(400))
    data = [(1, base), (2, "Q" + base[50:150] + "Q"), (3, "W" + base[200:299] + "W"), (4, base[300:] + "E"), (5, base[:100])]
    assert run(spark, data, 100, 32) == brute(data, 100)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert (got[2].n_removed, got[3].n_removed, got[4].n_removed, got[5].n_removed) == (100, 0, 100, 100) and got[2].spans == [1, 101]
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_windows_have_equal_grams():
    rng = np.random.default_rng(0)
    block = rng.integers(97, 101, 300).astype(np.uint8)
    for lead in (0, 1, 7, 50):
        data = np.concatenate([rng.integers(97, 101, lead).astype(np.uint8), block, rng.integers(97, 101, 30).astype(np.uint8)])
        _, first, n, h, *_ = substring_dedup.runs(data, np.array([0, len(data)]), 100, 32)
        per_window = np.repeat(h, n)
        assert len(per_window) == len(data) - 99
        if lead == 0:
            want = per_window[: 300 - 99]
        assert (per_window[lead : lead + 201] == want).all()


def test_characters_stay_whole():
    text = "aéb日c".encode()
    assert substring_dedup._whole_characters(text, [[2, 5]]) == "aé日c"
    assert substring_dedup._whole_characters(text, [[1, 6]]) == "a日c"
    assert substring_dedup._whole_characters(text, [[0, 7]]) == "c"
