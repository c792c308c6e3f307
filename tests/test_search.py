import pytest

from docquery.functions.text import simple_tokens
from docquery.operators import index as stored
from docquery.operators import lexical
from docquery.plans import clauses
from docquery.plans import search as S


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    data = [
        (1, "auth/login.md", "---\ntitle: Login\ntags: [auth]\n---\n# Login flow\nusers sign in with passwords\n## Tokens\nrefresh_token rotation"),
        (2, "auth/oauth.md", "# OAuth\n" + "\n".join(f"## Step {i}\npasswords step {i}" for i in range(6))),
        (3, "cad/mesh.md", "# Mesh\ntriangles and passwords once"),
    ]
    docs, chunks = S.build(spark.createDataFrame(data, "doc_id long, rel_path string, text string"))
    chunks = chunks.cache()
    return docs.cache(), chunks, S.write_index(chunks, f"file://{tmp_path_factory.mktemp('index')}")


def run(spark, index, text, **kw):
    return S.search(*index, texts(spark, {1: text}), S.SearchArgs(**kw)).orderBy("rank").collect()


def texts(spark, by_id):
    return spark.createDataFrame(list(by_id.items()), "query_id long, text string")


def test_citations(spark, index):
    (hit,) = run(spark, index, "rotation", snippets=True)
    assert (hit.path, hit.heading_path, hit.lines) == ("auth/login.md", ["Login flow", "Tokens"], [7, 8])
    assert hit.snippet == "## Tokens\nrefresh_token rotation" and not hit.snippet_truncated and hit.chunk_id >> 32 == 1


def test_scope_and_cap(spark, index):
    assert {r.path for r in run(spark, index, "passwords")} == {"auth/login.md", "auth/oauth.md", "cad/mesh.md"}
    assert {r.path for r in run(spark, index, "passwords", path_prefix="cad/")} == {"cad/mesh.md"}
    assert {r.path for r in run(spark, index, "passwords", tags=["auth"])} == {"auth/login.md"}
    capped = run(spark, index, "passwords", per_document=2)
    assert len(capped) == 4 and [r["rank"] for r in capped] == [1, 2, 3, 4]
    assert run(spark, index, "passwords", limit=0) == [] and len(run(spark, index, "passwords", limit=3)) == 3
    same = {r.chunk_id: r.score for r in run(spark, index, "passwords")}
    assert all(same[r.chunk_id] == r.score for r in run(spark, index, "passwords", path_prefix="auth/"))


def test_fusion(spark, index):
    (mesh,) = run(spark, index, "triangles")
    dense = spark.createDataFrame([(1, mesh.chunk_id, 1, 0.9)], "query_id long, chunk_id long, rank int, score double")
    got = S.search(*index, texts(spark, {1: "rotation"}), dense=dense).collect()
    assert {r.path for r in got} == {"auth/login.md", "cad/mesh.md"}


def test_errors(spark):
    for bad in (" ", "..."):
        with pytest.raises(S.QueryError):
            clauses.literal(texts(spark, {1: bad}))
    for bad in ("", "  ", 'a "b', "nowhere:a", "a AND", "OR a", "a AND OR b", "(a b", "a^2", "a*", "[a TO b]", "-a", "..."):
        with pytest.raises(S.QueryError):
            clauses.syntax(texts(spark, {1: bad}))
    with pytest.raises(S.QueryError):
        S.SearchArgs(per_document=11)


def test_clauses(spark):
    got = clauses.syntax(texts(spark, {1: 'a AND b OR title:c -d +"e f" NOT g snake_case a'})).orderBy("clause").collect()
    assert [(r.team, r.occur, r.field, r.terms) for r in got] == [
        (1, "must", None, ["a"]), (1, "must", None, ["b"]), (2, "should", "title", ["c"]), (-1, "must_not", None, ["d"]), (-1, "must", None, ["e", "f"]), (-1, "must_not", None, ["g"]), (6, "should", None, ["snake", "case"]), (7, "should", None, ["a"]),
    ]
    same = lambda t: [(r.occur, r.terms) for r in clauses.syntax(texts(spark, {1: t})).orderBy("clause").collect()]
    assert [(r.occur, r.terms) for r in clauses.literal(texts(spark, {1: "AND -x title:y"})).orderBy("clause").collect()] == [("should", ["and"]), ("should", ["x"]), ("should", ["title", "y"])]
    assert same("alpha beta") == [("should", ["alpha"]), ("should", ["beta"])] and same("ALPHA alpha") == [("should", ["alpha"])] * 2


def test_syntax_search(spark, index):
    found = lambda t, **kw: {(r.path, r.heading_path[-1]) for r in S.search(*index, texts(spark, {1: t}), syntax=True, **kw).collect()}
    assert found("passwords AND triangles") == {("cad/mesh.md", "Mesh")}
    assert found("passwords -step -triangles") == {("auth/login.md", "Login flow")}
    assert found('"sign in with"') == {("auth/login.md", "Login flow")} and found('"in sign"') == set()
    assert found("title:mesh OR refresh_token") == {("cad/mesh.md", "Mesh"), ("auth/login.md", "Tokens")}
    literal = {r.chunk_id: r.score for r in S.search(*index, texts(spark, {1: "passwords step"})).collect()}
    assert literal == {r.chunk_id: r.score for r in S.search(*index, texts(spark, {1: "passwords step"}), syntax=True).collect()}


def test_plan_of_a_search():
    assert S.fetched(S.SearchArgs(limit=10), False, 50) == 10 and S.fetched(S.SearchArgs(limit=10, per_document=2), False, 50) == 40
    assert S.fetched(S.SearchArgs(limit=700, per_document=2), False, 50) == 1000 and S.fetched(S.SearchArgs(limit=10), True, 50) == 50
    assert [S.score_scale(*x) for x in ((False, False), (True, False), (True, True))] == ["bm25", "rrf", "rerank"]


def test_field_boosts(spark, tmp_path):
    """Of four documents that hold the word in one field each, the field's boost decides, and by its ratio."""
    rows = [(i, *["needle" if j == i else "pad" for j in range(4)]) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, title string, heading_path string, identifiers string")
    stored.write(spark, f"file://{tmp_path}", df, {f: simple_tokens(f) for f in lexical.FIELD_BOOSTS})
    queries = spark.createDataFrame([(1, ["needle"])], "query_id long, terms array<string>")
    by = {r.doc_id: r.score for r in lexical.bm25(stored.Index(spark, f"file://{tmp_path}"), queries, boosts=lexical.FIELD_BOOSTS).collect()}
    assert [round(by[i] / by[0], 6) for i in range(4)] == [1.0, 2.0, 1.5, 2.5]


def test_brackets(spark, tmp_path):
    """Nested brackets against the same expression over each document's words; brackets that make no sense are errors."""
    from docquery.operators import index

    words = ["ant", "bee", "cat", "dog", "elk"]
    rows = [(i, " ".join(w for j, w in enumerate(words) if i >> j & 1)) for i in range(1, 32)]
    index.write(spark, f"file://{tmp_path}/i", spark.createDataFrame(rows, "doc_id long, text string"))
    built = index.Index(spark, f"file://{tmp_path}/i")
    forms = {
        1: ("(ant OR bee) AND (cat OR dog)", lambda a, b, c, d, e: (a or b) and (c or d)), 2: ("ant AND NOT (bee OR (cat AND dog))", lambda a, b, c, d, e: a and not (b or (c and d))),
        3: ("((((elk))))", lambda a, b, c, d, e: e), 4: ("+(ant bee) -(cat AND (dog OR elk)) dog", lambda a, b, c, d, e: (a or b) and not (c and (d or e))),
        5: ("(ant AND (bee OR (cat AND NOT (dog AND elk))))", lambda a, b, c, d, e: a and (b or (c and not (d and e)))), 6: ('("ant bee" OR cat) AND (dog -elk)', lambda a, b, c, d, e: ((a and b) or c) and d and not e),
        7: ("(ant)(bee)AND(cat)", lambda a, b, c, d, e: a or (b and c)),
    }
    asked = spark.createDataFrame([(k, t) for k, (t, _) in forms.items()], "query_id int, text string")
    found = {(r.query_id, r.doc_id) for r in lexical.score_clauses(built, clauses.syntax(asked, ["text"]), boosts={"text": 1.0}).collect()}
    assert found == {(k, i) for k, (_, f) in forms.items() for i, _ in rows if f(*[bool(i >> j & 1) for j in range(5)])}
    for bad in ("(ant", "ant)", ")ant(", "()", "ant AND ()", "(-ant) bee", "(ant OR)", "(" * 9 + "ant" + ")" * 9, "text:(ant)", "(NOT ant) OR bee"):
        with pytest.raises(clauses.QueryError):
            clauses.syntax(spark.createDataFrame([(1, bad)], "query_id int, text string"))
