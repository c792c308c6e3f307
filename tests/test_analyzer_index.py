"""The analyzer's index against plain Python: positions, phrases over several terms at one position, and scores."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docquery.functions import analyzer
from docquery.operators import index, lexical
from docquery.plans import clauses

CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿]")


def _script(ch):
    return "cjk" if CJK.match(ch) else "latin" if ch.isascii() and ch.isalpha() else None


def _runs(segment):
    """Runs of letters and digits, parted where the script of the letters changes."""
    for run in re.findall(r"[^\W_]+", segment):
        out, last = "", None
        for ch in run:
            script = _script(ch)
            if script and last and script != last:
                yield out
                out = ""
            last, out = script or last, out + ch
        yield out


def plain(text):
    """(position, term) of every token."""
    out, at = [], 0
    for segment in text.split():
        if not re.search(r"[^\W_]", segment):
            continue
        letters = [s for s in map(_script, segment) if s]
        terms, pairs = [], []
        if letters.count("cjk") <= letters.count("latin"):
            inner = re.fullmatch(r"[^\w]*(\w+)[^\w]*", segment)
            terms += [segment.lower(), inner[1].lower() if inner else ""]
        for run in _runs(segment):
            if CJK.search(run):
                pairs += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
            else:
                terms += [run.lower(), *(w.lower() for w in re.split(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", run))]
        out += [(at, t) for t in dict.fromkeys(terms) if 0 < len(t) <= 40] + [(at + i, p) for i, p in enumerate(pairs)]
        at += max(1, len(pairs))
    return out


TEXTS = [
    "parseRow reads ledger_entry_key; then parseRow", "API設計書 v2", "設計書API", "検索7図 x", "row parse ;; parseRow!", "y" * 41 + " after", "before " + "z" * 41 + " after", "before after", "", ";; --", None, "設",
    "7検 と検索", "ledger entry key", "(ledger_entry_key)", "JSONBodyReader.open() JSONBodyReader",
]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rng = random.Random(4)
    parts = ["parseRow", "row", "parse", "API設計書", "設計", "計書", "x-y", "after", ";", "q" * 41, "Key", "key_Key"]
    texts = TEXTS + [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = f"file://{tmp_path_factory.mktemp('analyzed')}"
    index.write(spark, root, docs, {"text": analyzer.lattice("text")})
    return [t or "" for t in texts], index.Index(spark, root)


def test_postings_are_the_analyzers_positions(built):
    texts, stored = built
    got = {(r.doc_id, r.term): (r.tf, r.positions, r.dl) for r in stored.postings.collect()}
    want = {}
    for d, text in enumerate(texts):
        for at, term in plain(text):
            want.setdefault((d, term), []).append(at)
    assert got == {(d, t): (len(at), at, len(plain(texts[d]))) for (d, t), at in want.items()}
    assert {r.doc_id: r.dl for r in stored.lengths.collect()} == {d: len(plain(t)) for d, t in enumerate(texts)}


def _places(text, phrase):
    """Positions at which all tokens of a phrase stand as far apart as in the phrase."""
    held, wanted = set(plain(text)), plain(phrase)
    return sum(all((start + at - wanted[0][0], term) in held for at, term in wanted) for start in range(len(held) + 1))


def test_phrases_by_relative_positions(spark, built):
    texts, stored = built
    phrases = ["parseRow", "API設計書", "設計書", "before after", "parseRow reads", "row parse", "parse parseRow", "x-y after", "key_Key", "JSONBodyReader.open()", "ledger_entry_key", "設", "Key key_Key", "after row API設計書", f"before {'z' * 41} after", f"{'y' * 41} after", "absent row"]
    table = spark.createDataFrame(list(enumerate(phrases)), "phrase_id int, text string").select("phrase_id", analyzer.phrase("text").alias("e"))
    found = lexical.phrase_matches(stored, table.selectExpr("phrase_id", "e.term AS terms", "e.offset AS offsets"))
    got = {(r.phrase_id, r.doc_id): r.n for r in found.collect()}
    assert got == {(i, d): n for i, p in enumerate(phrases) for d, t in enumerate(texts) if (n := _places(t, p))}
    # words of one identifier are no phrase, and a token that is too long keeps its place
    assert (5, 4) in got and (5, 0) not in got and (3, 7) in got and (3, 6) not in got


def test_literal_scores(spark, built):
    texts, stored = built
    queries = {1: "parseRow API設計書 after", 2: "key_Key x-y key", 3: "検索 ledger_entry_key;"}
    table = spark.createDataFrame(list(queries.items()), "query_id int, text string")
    scored = lexical.score_clauses(stored, clauses.literal(table, analyzer.phrase), boosts={"text": 1.0})
    got = {(r.query_id, r.doc_id): r.score for r in scored.collect()}
    lengths = [len(plain(t)) for t in texts]
    average, n = sum(lengths) / len(texts), len(texts)
    df = Counter(term for t in texts for term in {term for _, term in plain(t)})
    want = {}
    for q, text in queries.items():
        for word in text.split():
            idf = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for _, t in plain(word) if df[t])
            for d, t in enumerate(texts):
                if tf := _places(t, word):
                    want[q, d] = want.get((q, d), 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[d] / average))
    assert got == pytest.approx(want)


def test_syntax_phrases_over_segments(spark, built):
    texts, stored = built
    table = spark.createDataFrame([(1, '"row parse" -after'), (2, '+parseRow "API設計書 after"')], "query_id int, text string")
    got = {(r.query_id, r.doc_id) for r in lexical.score_clauses(stored, clauses.syntax(table, ["text"], analyzer.phrase), boosts={"text": 1.0}).collect()}
    first = {(1, d) for d, t in enumerate(texts) if _places(t, "row parse") and not _places(t, "after")}
    assert got == first | {(2, d) for d, t in enumerate(texts) if _places(t, "parseRow")}


def test_words_of_a_slice_are_analyzed_once(spark, tmp_path, monkeypatch):
    """The index of texts whose distinct words are analyzed is that of the tokens of every text, over odd words and small slices."""

    long_ = "x" * 40
    texts = ["Hello, hello HELLO! hello", f"{long_} {long_}! {long_}y {long_}y. end", "parse_row parseRow ABCdef a1 1a été École. ÉCOLE Straße", "日本語 x日本 ｆｕｌｌ ёлка Ёлка, مَكتَبة", " \t\x0btwo\x0cwords\r\n ... -- ", "", None, "nbsp inside line end\x85 end;: a.b.c don't ai%%% İI"]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(2, "again again")], "doc_id long, text string").withColumn("title", F.reverse("text"))
    monkeypatch.setattr(index, "SLICE_TOKENS", 5)
    seen = lambda df: sorted((r.doc_id, r.field, r.term or "", r.tf, tuple(r.positions), r.dl, r.n_chars) for r in index.opened(df).collect())
    fields = ["text", "title"]
    want = seen(index.blocks(rows, {f: analyzer.lattice(f) for f in fields}))
    got = index.blocks(rows, {f: F.col(f) for f in fields}, analyzed=True)
    assert len(want) > 100 and seen(got) == want
    # only words that are not plain are taken apart by expressions
    assert "others" in got._jdf.queryExecution().optimizedPlan().toString()


def test_packs_hold_postings_as_they_are(spark, tmp_path):
    """Packs give back ids of any size and none, documents that come twice, and after a merge the same rows."""

    rows = [(-(2**40), "b a b"), (2**62, "a " * 300 + "b"), (7, "a c"), (7, "a c"), (None, "c"), (3, None)]
    root = f"file://{tmp_path}/i"
    index.write(spark, root, spark.createDataFrame(rows, "doc_id long, text string"))
    seen = lambda: sorted((str(r.doc_id), r.term or "", r.tf, tuple(r.positions), r.dl, r.n_chars) for r in index.Index(spark, root).entries().collect())
    want = seen()
    assert [r[:3] for r in want if r[1] == "a"] == [(str(-(2**40)), "a", 1), (str(2**62), "a", 300), ("7", "a", 1), ("7", "a", 1)] and ("None", "c", 1, (0,), 1, 1) in want
    index.upsert(spark, root, spark.createDataFrame([(9, "z")], "doc_id long, text string"))
    index.merge(spark, root, everything=True)
    assert [r for r in seen() if r[0] != "9"] == want
