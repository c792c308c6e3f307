import pytest
from pyspark.sql import functions as F

from docquery.functions import analyzer
from docquery.functions import text as T
from docquery.operators import chunking


def tokens(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.position, r.term) for r in analyzer.tokens(df).collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("parseRow", ["parserow", "parse", "row"]),
        ("ledger_entry_key", ["ledger_entry_key", "ledger", "entry", "key"]),
        ("Cache-Max-Age", ["cache-max-age", "cache", "max", "age"]),
        ("_zz_openFile", ["_zz_openfile", "zz", "openfile", "open", "file"]),
        ("QX.total", ["qx.total", "qx", "total"]),
        ("~ ;; ??", []),
        ("load4KTiles", ["load4ktiles", "load4", "k", "tiles"]),
        ("JSONBodyReader", ["jsonbodyreader", "json", "body", "reader"]),
        ("y-y", ["y-y", "y"]),
        ("bB", ["bb", "b"]),
        ("(ledger_entry_key);", ["(ledger_entry_key);", "ledger_entry_key", "ledger", "entry", "key"]),
        ("青山図書館", ["青山", "山図", "図書", "書館"]),
        ("", []),
    ],
)
def test_tokens(spark, text, want):
    assert [t for _, t in tokens(spark, text)] == want


def test_positions(spark):
    got = tokens(spark, "parseRow ;; 青山図 last " + "x" * 41)
    assert got == [(0, "parserow"), (0, "parse"), (0, "row"), (1, "青山"), (2, "山図"), (3, "last")]


@pytest.mark.parametrize(
    ("text", "script", "runs", "stem"),
    [
        ("plain", "latin", ["plain"], "en"), ("Слово", "cyrillic", ["Слово"], "ru"), ("ԀԂԀԂ", "cyrillic", ["ԀԂԀԂ"], None), ("ỹỳỹ", "latin", ["ỹỳỹ"], None), ("ｱｲｳ", "cjk", ["ｱｲｳ"], None), ("كتاب", "arabic", ["كتاب"], "ar"),
        ("Web7検索・ok", "latin", ["Web7", "検索・", "ok"], None), ("12 -", "other", ["12 -"], None), ("abc", "latin", ["abc"], None), ("HTTP", "latin", ["HTTP"], None), ("parseRow", "latin", ["parseRow"], None), ("ab1c", "latin", ["ab1c"], None),
    ],
)
def test_scripts(spark, text, script, runs, stem):
    row = spark.range(1).select(T.script_of(F.lit(text)).alias("s"), T.script_runs(F.lit(text)).alias("r"), T.stem_language(F.lit(text)).alias("l")).first()
    assert (row.s, row.r, row.l) == (script, runs, stem)


def test_folding(spark):
    row = spark.range(1).select(T.fold(F.lit("Ёлка ＡＢＣ أحمد مـحمَّد")).alias("x"), T.script_of(F.lit("аб c")).alias("s"), T.script_of(F.lit("12")).alias("o")).first()
    assert (row.x, row.s, row.o) == ("Елка ABC احمد محمد", "cyrillic", "other")
    lines = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\nb",), ("\n",)], "t string").select(T.line_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in lines] == [0, 1, 1, 2, 1]
    assert spark.range(1).select(T.snippet(F.lit("x" * 239 + "\r\n")).alias("s")).first().s == "x" * 239


MARKDOWN = """---
title: "Tide Notes"
tags: [a, 'b', ]
---
intro text

# One
first
## Two
```python
# not a heading
x = 1
```
### Three
| a | b |
|---|---|
## Four
last
"""


def chunks(spark, text, **kw):
    return chunking.chunk(spark.createDataFrame([(1, text)], "doc_id long, text string"), **kw).orderBy("seq").collect()


def test_front_matter(spark):
    data = [(1, MARKDOWN), (2, "---\ntags:\n  - x\n  - 'y z'\n---\nbody"), (3, "no front"), (4, "---\nunclosed"), (5, None), (6, "---\r\ntitle: T\r\n---\r\nB"), (7, "---\n  title: In\n  tags:\n    # some\n    - p\n\n    - q # note\n      - deeper\n    - r\n  other: x\n---\n")]
    got = {r.doc_id: r for r in chunking.front_matter(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert (got[1].title, got[1].tags, got[1].skipped) == ("Tide Notes", ["a", "b"], 4)
    assert (got[2].title, got[2].tags, got[2].body) == (None, ["x", "y z"], "body")
    assert (got[3].title, got[3].tags, got[3].body) == (None, [], "no front")
    assert (got[7].title, got[7].tags) == ("In", ["p", "q"])
    assert got[4].body == "---\nunclosed" and (got[6].title, got[6].body) == ("T", "B")


def test_sections(spark):
    got = chunks(spark, MARKDOWN)
    assert [r.heading_path for r in got] == [[], ["One"], ["One", "Two"], ["One", "Two", "Three"], ["One", "Four"]]
    assert [(r.kind, r.lang) for r in got] == [("prose", None), ("prose", None), ("code", "python"), ("table", None), ("prose", None)]
    assert [(r.line_start, r.line_end) for r in got] == [(5, 6), (7, 8), (9, 13), (14, 16), (17, 19)]
    assert [r.seq for r in got] == list(range(5))


def test_cap_and_atomic_blocks(spark):
    text = "# H\n" + "\n".join(f"line {i} " + "w" * 40 for i in range(40)) + "\n```\n" + "code\n" * 60 + "```\n" + "y" * 450
    got = chunks(spark, text, cap=200)
    assert all(len(r.text) <= 220 or r.kind == "code" for r in got)
    assert sum("code\ncode" in r.text for r in got) == 1
    # without what is repeated, all that is not white space comes once and in order
    plain, at = "".join(text.split()), 0
    for r in got:
        body = "".join(r.text.split())
        start = max(k for k in range(at + 1) if plain.startswith(body, k))
        assert at - start <= 20
        at = start + len(body)
    assert at == len(plain)
    assert chunks(spark, "  \n\n ") == [] and chunks(spark, "") == []


def test_fences_close_on_their_own_mark(spark):
    text = "````md\n```\n# not heading\n```\n````\n# Real\n~~~\n```\n# also not\n~~~~ \n## Sub\n```\nopen to the end\n# no"
    got = chunks(spark, text)
    assert [r.heading_path for r in got] == [[], ["Real"], ["Real", "Sub"]] and [r.kind for r in got] == ["code", "code", "prose"] and got[0].lang == "md"


def test_setext_headings(spark):
    text = "Top title\nin two lines\n===\nbody\n\nLower\n---\ntext\n\n- item\n---\n\n***\n---\nend"
    got = chunks(spark, text)
    assert [r.heading_path for r in got] == [["Top title in two lines"], ["Top title in two lines", "Lower"]]
    assert [(r.line_start, r.line_end) for r in got] == [(1, 5), (6, 15)]


def test_long_lines_are_cut_after_tokens(spark):
    got = [r.text for r in chunks(spark, "word_one word_two, " * 6 + "z" * 130, cap=50)]
    assert all(len(t) <= 55 for t in got) and got[0] == "word_one word_two, word_one word_two, word_one "
    assert "z" * 50 in got and sum(t.count("z") for t in got) == 130


def test_captions_and_repeated_ends(spark):
    prose = "\n".join(f"sentence number {i} stands here." for i in range(12))
    got = [r.text for r in chunks(spark, f"# Title\n\n| a |\n| b |\n{prose}\n", cap=100)]
    assert got[0] == "# Title\n\n| a |\n| b |" and got[1].startswith("sentence number 0")  # a table begins afresh after its caption
    assert got[2].startswith("here.\nsentence number 3") and all(len(t) <= 110 for t in got)
    # a heading alone joins the prose after it, within the cap and what may be repeated, and repeats nothing
    long_ = "x" * 60 + " " + "y" * 38
    assert [r.text for r in chunks(spark, f"# Some heading\n{long_}\n{long_}\n", cap=100)][0] == f"# Some heading\n{long_}"
    rows = chunks(spark, f"# Title\n\n| a |\n| b |\n{prose}\n", cap=100)
    assert [r.line_start for r in rows][:3] == [1, 5, 7]


def test_packing_of_sizes():
    flags = lambda s, c: [x == c for x in s]
    pack = lambda s, n=10, cap=25: chunking.pack_sizes([n] * len(s), [n] * len(s), [False] * len(s), flags(s, "A"), [x in "hb" for x in s], flags(s, "b"), cap)
    assert pack("pppp") == [(0, 2, False), (2, 4, True)]
    assert pack("hA") == [(0, 2, False)] and pack("phA") == [(0, 2, False), (2, 3, False)] and pack("bbA") == [(2, 3, False)]
    assert pack("hbpp") == [(0, 4, False)]  # the heading's piece joins the next
    assert pack("Apppp") == [(0, 1, False), (1, 3, False), (3, 5, True)]


def test_chunking_moves_no_lines(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, "a\n\nb")], "doc_id long, text string")
    plan = chunking.chunk(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and "Join" not in plan


def test_rows_of_one_document_are_mixed_by_line(spark):
    text = "# A\none\n```\ncode\n```\n## B\ntwo"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = [(r.doc_id, r.seq, tuple(r.heading_path), r.line_start, r.line_end, r.text) for r in chunking.chunk(docs).collect()]
    assert len(set(got)) == len(got) and sorted(r[1] for r in got if r[0] == 2) == [0, 1]
    # each line of document 1 stands twice, one after the other, so that every heading and fence does
    assert [r[2:] for r in sorted(g for g in got if g[0] == 1)] == [(("A",), 1, 1, "# A"), (("A",), 1, 5, "# A\none\none\n```\n```\ncode\ncode\n```\n```"), (("A", "B"), 6, 6, "## B"), (("A", "B"), 6, 7, "## B\ntwotwo")]


def test_identifier_words(spark):
    from docquery.functions.text import identifier_words

    text = "plain foo_bar, -- a.b 日本 日本。 x y 'q' ... é! 1 1% _"
    assert spark.createDataFrame([(text,), (None,), ("",)], "text string").select(identifier_words("text").alias("w")).collect() == [("foo_bar, a.b 日本。 x y 'q' é! 1%",), (None,), ("",)]
