"""Search over an index of chunks: scope, BM25 over fields, optional dense fusion, cap, limit and citations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.functions import analyzer
from docquery.functions.text import SNIPPET_CHARS, identifier_words, snippet
from docquery.operators import catalog, chunking, index, lexical, ranking
from docquery.plans import clauses
from docquery.plans.clauses import QueryError
from docquery.sources.tables import chunk_id


@dataclass
class SearchArgs:
    limit: int = 10
    path_prefix: str | None = None
    tags: list[str] = field(default_factory=list)
    per_document: int | None = None
    snippets: bool = False

    def __post_init__(self):
        if self.limit < 0 or (self.per_document is not None and not 1 <= self.per_document <= 10):
            raise QueryError("limit must not be negative, and per_document lies between 1 and 10")
        self.limit = min(self.limit, lexical.MAX_LIMIT)


def build(docs: DataFrame, cap: int = chunking.CAP_CHARS) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, rel_path, text) to an index: documents with title and tags, and chunks with their search fields."""
    front = chunking.front_matter(docs).select("doc_id", "title", "tags")
    chunks = chunking.chunk(docs, cap)
    ready = chunks.select(
        chunk_id().alias("chunk_id"), "doc_id", "seq", F.col("heading_path").alias("headings"), "kind", "lang", "line_start", "line_end", "text",
        F.coalesce(F.try_element_at("heading_path", F.lit(1)), F.lit("")).alias("title"), F.array_join("heading_path", " > ").alias("heading_path"), identifier_words("text").alias("identifiers"),
    )
    return docs.select("doc_id", "rel_path").join(front, "doc_id"), ready


def write_index(chunks: DataFrame, root: str, tokens: Callable[[str], Column] = analyzer.lattice) -> index.Index:
    """Store the index of the chunks' fields as the root's next generation; by the analyzer, or by other tokens."""
    rows = chunks.select(F.col("chunk_id").alias("doc_id"), *lexical.FIELD_BOOSTS)
    analyzed = tokens is analyzer.lattice
    index.write(chunks.sparkSession, root, rows, {f: F.col(f) if analyzed else tokens(f) for f in lexical.FIELD_BOOSTS}, analyzed)
    return index.Index(chunks.sparkSession, root)


def fetched(args: SearchArgs, dense: bool, window: int) -> int:
    """Candidates that are read before the cap: four times the limit with a cap alone, the window with fusion; at most MAX_LIMIT."""
    if dense:
        return min(max(args.limit, window), lexical.MAX_LIMIT)
    return args.limit if args.per_document is None else min(4 * args.limit, lexical.MAX_LIMIT)


def score_scale(dense: bool, reranked: bool) -> str:
    """What the scores of a search are: of the last step that ran."""
    return "rerank" if reranked else "rrf" if dense else "bm25"


def search(docs: DataFrame, chunks: DataFrame, stored: index.Index, queries: DataFrame, args: SearchArgs | None = None, dense: DataFrame | None = None, window: int = 50, syntax: bool = False, boosts: dict[str, float] | None = None, tokens: Callable[[Column | str], Column] = analyzer.phrase) -> DataFrame:
    """query_id, rank, score, chunk_id, path, headings, lines and, if asked for, a snippet of the best chunks.

    queries: query_id and text, as literal words or in query syntax. The scope restricts candidates before the top is
    taken, and statistics stay those of the whole index. A per-document cap reads more candidates until the limit is
    filled or none are left. tokens gives the (term, offset) of a query's word as the index was tokenized. dense is a second ranked list (query_id, chunk_id, rank, score) to fuse with.
    """
    args = args or SearchArgs()
    scoped = catalog.has_tags(catalog.path_prefix(docs, args.path_prefix), args.tags)
    inside = chunks.join(scoped.select("doc_id"), "doc_id", "left_semi").select(F.col("chunk_id").alias("doc_id")) if args.path_prefix or args.tags else None
    parsed = clauses.syntax(queries, tokens=tokens) if syntax else clauses.literal(queries, tokens)
    few = None if syntax or dense is not None else lexical.literal_top(stored, parsed, args.limit, inside, boosts, args.per_document)
    scored = (lexical.score_clauses(stored, parsed, inside, boosts) if few is None else few).withColumnRenamed("doc_id", "chunk_id")
    named = scored.withColumn("score", F.round("score", 6)).withColumn("doc_id", F.shiftright("chunk_id", 32))
    if dense is not None:
        named = ranking.rrf(lexical.top(scored, fetched(args, True, window), key="chunk_id"), dense, key="chunk_id").withColumn("doc_id", F.shiftright("chunk_id", 32))
    order = [F.desc("score"), F.col("chunk_id")] if dense is None else [F.col("rank")]
    if args.per_document:
        # the cap comes before the top, so the window never has to be widened for a document with very many hits
        named = ranking.cap_per_document(named, args.per_document, keys=order)
    if dense is None or args.per_document:
        named = named.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    best = named.filter(F.col("rank") <= args.limit)
    # text is joined only for the rows that are returned
    cited = best.drop("doc_id").join(chunks.select("chunk_id", "doc_id", "headings", "line_start", "line_end", "text"), "chunk_id").join(docs.select("doc_id", F.col("rel_path").alias("path")), "doc_id")
    shown = [snippet("text").alias("snippet"), (F.length("text") > SNIPPET_CHARS).alias("snippet_truncated")] if args.snippets else []
    return cited.select("query_id", "rank", "score", "chunk_id", "path", F.col("headings").alias("heading_path"), F.array("line_start", "line_end").alias("lines"), *shown)
