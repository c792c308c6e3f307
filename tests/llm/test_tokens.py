import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquery.llm import packing, token_output, tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


CASES = ["", "a", " a", "  a", "a  b", "a   b", "a ", "a  ", "x \ny", "x\n \ny", "it's  we're", "<|endoftext|> a", "é  b", "'s 't", " ", "word, word.", "naïve Ünïcode ½ 3rd", "  x", "a\t b", "日本 語"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é,.'!\n\t ½日7"), max_size=30))
def test_encoder_equals_tokenizer(text):
    e = tokens.encoder(tokens.default_path())
    assert e.encode(text) == e.whole(text).astype("<u4").tobytes()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "bc", " ", " ", "é", "\n", "\u3000", "<|endoftext|>", "日"]), max_size=40).map("".join)), max_size=6), st.integers(1, 20))
def test_columns_in_small_groups(texts, group):
    """Texts longer than a group are cut, and words are shared between rows."""
    e = tokens.encoder(tokens.default_path())
    e.group, kept = group, e.group
    try:
        ids, counts = e.encode_column(pa.array(texts, pa.string()))
    finally:
        e.group = kept
    want = [e.whole(t or "") for t in texts]
    assert counts.tolist() == [len(x) for x in want] and (ids == np.concatenate([*want, np.zeros(0, np.uint32)])).all()


def test_block_codec_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 1000, 5000, 700_000):
        ids = np.where(rng.random(n) < 0.05, rng.integers(0, 2**32, n), rng.integers(0, 300, n)).astype(np.uint32)
        content = token_output.encode_file([1, 2], [n, 0], ids)
        docs, counts, back = token_output.decode_file(content)
        assert docs.tolist() == [1, 2] and counts.tolist() == [n, 0] and (back == ids).all()
        blocks = token_output.encode_ids(ids)
        for first, count in ((0, n), (n // 3, n // 3), (max(0, n - 5), min(5, n))):
            assert (token_output.decode_ids(blocks, n, 0, first, count) == ids[first : first + count]).all()


def rows(spark, texts):
    return spark.createDataFrame(list(texts), "doc_id long, text string, lang string, start long")


def test_files_match_tokenizer(spark, tokenizer):
    data = [(i * 3 % 50, t, "x", 5) for i, t in enumerate(CASES)] + [(100, None, None, 1), (None, "null id", None, None), (7, "long " * 30000, None, 0), (7, "again", None, 0)]
    files = token_output.write_tokens(rows(spark, data), tokens.default_path())
    got = token_output.read_tokens(files).collect()
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for doc, text, *_ in order:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got), key=lambda x: x[1]) == want
    assert token_output.read_tokens(token_output.write_tokens(rows(spark, []), tokens.default_path())).count() == 0


def check_packing(out, docs, tokenizer, capacity=1024):
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        got = sorted(by_doc.pop(doc), key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got)))
        assert [r.start for r in got] == np.cumsum([0] + [r.length for r in got])[:-1].tolist() and sum(r.length for r in got) == len(ids)
        assert all(r.length == capacity for r in got[1:]) and got[0].length <= capacity
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in got)
    assert not by_doc
    for rs in by_seq.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == np.cumsum([0] + [r.length for r in rs])[:-1].tolist() and sum(r.length for r in rs) <= capacity
    return len(by_seq)


def test_packing_places_every_piece(spark, tokenizer, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    data = [tuple(r) for r in docs.collect()] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "w " * 5000)]
    frame = spark.createDataFrame([(*x, 1, "p") for x in data], "doc_id long, text string, length int, sequence_id string")
    out = packing.pack(frame, tokens.default_path()).collect()
    n = check_packing(out, data, tokenizer)
    assert n <= 1.06 * -(-sum(r.length for r in out) // 1024)
    assert packing.pack(docs.limit(0), tokens.default_path()).count() == 0


def test_packing_of_repeated_rows_and_null_ids(spark, tokenizer):
    data = [(None, "w " * 700), (None, "other"), (5, "same text"), (5, "same text"), (-(2**63), "least")]
    out = packing.pack(spark.createDataFrame(data, "doc_id long, text string"), tokens.default_path()).collect()
    numbered = {}
    for d, t in data:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        for a, b in [(0, first), *((x, x + 1024) for x in range(first, len(ids), 1024))]:
            key = (d, a, b - a, zlib.crc32(ids[a:b].tobytes()))
            numbered[key] = numbered.get(key, 0) + 1
    for r in out:
        numbered[r.doc_id, r.start, r.length, r.ids_crc32] -= 1
    assert not any(numbered.values()) and len({(r.sequence_id, r.offset) for r in out}) == len(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_covers_exactly(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=41).astype(np.int64)
    chosen = packing.plan(counts, 40)
    used = np.zeros(41, np.int64)
    for config, n in chosen:
        assert sum(length * copies for length, copies in config) <= 40 and n > 0
        for length, copies in config:
            assert copies > 0
            used[length] += n * copies
    assert (used == counts).all()


def test_plan_is_never_worse_than_best_fit_and_better_where_that_loses():
    rng = np.random.default_rng(6)
    used = lambda p: sum(n for _, n in p)
    for low, high, n in ((1, 1024, 400), (200, 700, 900), (300, 420, 900), (5, 90, 700)):
        counts = np.bincount(rng.integers(low, high, n), minlength=1025)
        chosen = packing.plan(counts)
        held = np.zeros(1025, np.int64)
        for config, n_seq in chosen:
            assert sum(length * k for length, k in config) <= 1024
            for length, k in config:
                held[length] += n_seq * k
        assert (held == counts).all() and used(chosen) <= used(packing.best_fit(counts))
    # 51 + 26 + 23 and 27 + 27 + 23 + 23 are full; longest first pairs 51 with 27
    counts = np.zeros(101, np.int64)
    counts[[51, 27, 26]], counts[23] = 600, 1200
    assert used(packing.best_fit(counts, 100)) == 1100 and used(packing.plan(counts, 100)) == 900
