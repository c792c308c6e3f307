"""Identifier-aware tokens with positions, as column expressions.

A white-space segment gives its lower-cased self, the identifier inside its punctuation, its runs of letters and
digits and the words of camel case, all at one position. Runs are parted where their script changes. A run of CJK gives
overlapping pairs of characters at positions of their own, which begin at the segment's; a segment mostly of CJK has no
token of its whole self. Segments whose tokens are all too long keep their position, so that phrases do not close up
over them. Stems are not built in; a table of (term, stem) may replace terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.functions.text import SCRIPTS, fold, script_of, script_runs

LONGEST_TOKEN = 40
_ALNUM = r"[\p{L}\p{N}]"
_SPAN = r"^[^\p{L}\p{N}_]*([\p{L}\p{N}_]+)[^\p{L}\p{N}_]*$"
#: A word of small Latin letters, with a capital at most at its start and marks at most at its end.
_WORD = r"^[A-Z\x{C0}-\x{D6}\x{D8}-\x{DE}]?[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+[.,;:!?]*$"
_CAMEL = r"(?<=[\p{Ll}0-9])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def segments(text: Column | str) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda s: s.rlike(_ALNUM))


def _words(run: Column) -> Column:
    return F.concat(F.array(F.lower(run)), F.transform(F.split(run, _CAMEL), F.lower))


def _pairs(run: Column) -> Column:
    """Overlapping pairs of a run's characters; a single character stands alone."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2)))


def _parts(segment: Column) -> Column:
    """terms: distinct tokens at the segment's own position (whole, identifier, runs and their camel-case words); pairs: those of its CJK runs in order."""
    plain = ~segment.rlike(r"[^\x00-\x7F]")
    cjk = lambda run: run.rlike(SCRIPTS["cjk"])
    runs = F.regexp_extract_all(segment, F.lit(f"{_ALNUM}+"), F.lit(0))
    runs = F.when(plain, runs).otherwise(F.flatten(F.transform(runs, script_runs)))
    words = F.flatten(F.transform(F.filter(runs, lambda r: ~cjk(r)), _words))
    whole = F.array(F.lower(segment), F.lower(F.regexp_extract(segment, _SPAN, 1)))
    every = F.when(plain | (script_of(segment) != "cjk"), F.concat(whole, words)).otherwise(words)
    terms = F.array_distinct(F.filter(every, lambda t: F.length(t).between(1, LONGEST_TOKEN)))
    none = F.array().cast("array<string>")
    pairs = F.when(plain, none).otherwise(F.flatten(F.transform(F.filter(runs, cjk), _pairs)))
    # most words are one run of one script and one case, whose tokens are themselves and what stands before their marks
    lower = F.lower(segment)
    word = F.array_distinct(F.filter(F.array(lower, F.translate(lower, ".,;:!?", "")), lambda t: F.length(t) <= LONGEST_TOKEN))
    return F.when(segment.rlike(_WORD), F.struct(word.alias("terms"), none.alias("pairs"))).otherwise(F.struct(terms.alias("terms"), pairs.alias("pairs")))


def _gaps(parts: Column) -> Column:
    tokens = F.concat(parts["terms"], parts["pairs"])
    here = F.size(parts["terms"])
    token = lambda gap, term: F.struct(gap.alias("gap"), term.alias("term"))
    # the first token moves on from the segment before; the first pair stands with the terms, the others follow it
    each = F.transform(tokens, lambda t, i: token(F.when(i == 0, 1).when(i <= here, 0).otherwise(1), t))
    return F.when(F.size(tokens) > 0, each).otherwise(F.array(token(F.lit(1), F.lit(None).cast("string"))))


def lattice(text: Column | str, folded: bool = True) -> Column:
    """Tokens in order as (gap, term): gap is how far a token's position lies behind the one before it (0: the same).

    The first position is 0, which a first gap of 1 stands for. A null term is a position without a token. Null text: null.
    """
    source = F.col(text) if isinstance(text, str) else text
    return F.flatten(F.transform(F.transform(segments(fold(source) if folded else source), _parts), _gaps))


def plain(words: pa.Array) -> np.ndarray:
    """Which are words of small Latin letters, with a capital at most at their start and marks at most at their end."""
    return pc.fill_null(pc.match_substring_regex(words, _WORD), False).to_numpy(zero_copy_only=False)


def plain_tokens(words: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """For plain words: how many tokens lattice gives each, and gap and term of all of them in order."""
    lower = pc.utf8_lower(words)
    bare = pc.utf8_rtrim(lower, characters=".,;:!?")
    short = lambda x: pc.less_equal(pc.utf8_length(x), LONGEST_TOKEN).to_numpy(zero_copy_only=False)
    whole, part = short(lower), short(bare) & pc.not_equal(lower, bare).to_numpy(zero_copy_only=False)
    n = np.maximum(1, whole.astype(np.int32) + part)
    first = np.cumsum(n) - n
    gap, term = np.zeros(int(n.sum()), np.int32), np.full(int(n.sum()), -1)
    gap[first] = 1
    term[first[whole]] = np.flatnonzero(whole)
    term[(first + whole)[part]] = len(words) + np.flatnonzero(part)
    return pa.array(n), pa.array(gap), pa.concat_arrays([lower, bare]).take(pa.array(term, mask=term < 0))


def phrase(text: Column | str, folded: bool = True) -> Column:
    """The tokens of a query's word or phrase as (term, offset), offsets counted from the first token.

    Sums are taken anew for each token, which is for queries: the tokens of a document get their positions in the index.
    """
    tokens = lattice(text, folded)
    gaps = F.transform(tokens, lambda t: t["gap"])
    at = F.transform(tokens, lambda t, i: F.struct(t["term"].alias("term"), F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, b: a + b).alias("offset")))
    known = F.filter(at, lambda t: t["term"].isNotNull())
    return F.transform(known, lambda t: F.struct(t["term"].alias("term"), (t["offset"] - known[0]["offset"]).alias("offset")))


def term_counts(docs: DataFrame, text: str = "text", folded: bool = True) -> DataFrame:
    """doc_id, term and tf: how often each token stands in a document."""
    parts = F.transform(segments(fold(text) if folded else F.col(text)), _parts)
    terms = docs.select("doc_id", F.explode(F.flatten(F.transform(parts, lambda p: F.concat(p["terms"], p["pairs"])))).alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def tokens(docs: DataFrame, text: str = "text", folded: bool = True, stems: DataFrame | None = None) -> DataFrame:
    """doc_id, position and term of every token; segments without a letter or digit take no position."""
    parts = docs.select("doc_id", F.posexplode(lattice(text, folded)).alias("nth", "token"))
    before = Window.partitionBy("doc_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.select("doc_id", (F.sum("token.gap").over(before) - 1).alias("position"), F.col("token.term").alias("term")).filter("term IS NOT NULL")
    if stems is None:
        return out
    return out.join(stems, "term", "left").select("doc_id", "position", F.coalesce("stem", "term").alias("term")).distinct()
