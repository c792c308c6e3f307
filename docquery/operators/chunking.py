"""Markdown documents to chunks with heading paths and line ranges.

Front matter is taken off by column functions. A document's lines are then gone through in the task that has it, so that
no line moves: fences, headings (ATX and setext) and sections are found. A section over the cap is cut into pieces by the
sizes of its parts: prose by lines, whole fences and tables, long lines after a token. A heading alone joins what follows
it, and a piece of prose begins with the end of the one before.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.operators import scan

# The cap of a chunk and the most that is repeated from the chunk before.
CAP_CHARS, OVERLAP_CHARS = 1500, 150
#: Ids up to which their table is broadcast (some tens of bytes each).
BROADCAST_IDS = 200_000
LEVELS = range(1, 7)
_FRONT = r"(?s)\A---\r?\n(.*?\r?\n)?---[ \t]*(?:\r?\n|\z)"
#: A character that ends no line, and the end of a line, as Java's patterns have them.
_ANY, _END = "[^\\n\\r\\x85\\u2028\\u2029]", "(?=[\\r\\x85\\u2028\\u2029]?\\Z)"


def _line(pattern: str) -> re.Pattern:
    """A pattern that a line begins with. In it ~. and ~$ stand for _ANY and _END."""
    return re.compile(pattern.replace("~.", _ANY).replace("~$", _END), re.ASCII)


_RETURN = re.compile(f"\\r{_END}")
_HEADING = _line(r" {0,3}(#{1,6})(?:[ \t]+(~.*?))?(?:[ \t]+#+)?[ \t]*~$")
_FENCE = _line(r" {0,3}(`{3,}|~{3,})(~.*)~$")
_UNDERLINE = _line(r" {0,3}(?:=+|-+)[ \t]*~$")
#: Lines that cannot be part of a paragraph: empty ones, rules, headings, tables, quotes, lists and indented code.
_NOT_PROSE = _line(r"\s*~$| {0,3}(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})~$| {0,3}#{1,6}(?:[ \t]|~$)|\s*\|| {0,3}>| {0,3}(?:[-*+]|\d{1,9}[.)])[ \t]|(?: {4}|\t)")
#: White space and ASCII marks but the underscore: after these a line may be cut, and a repeated end may begin.
_EDGE = r"[\s!-/:-@\[-^`{-~]"
_TAIL = re.compile(rf"(?s)\A.*?{_EDGE}(?=.*\S)(.*)\Z", re.ASCII)
_BARE, _WHITE, _SPACES = re.compile(r"#|\s*\Z", re.ASCII), " \t\n\r\f\v", re.compile(r"\s+", re.ASCII)
_TITLE_LINE = re.compile(r"[ \t]*#[^\n]*\n+")
_INFO = re.compile(r" {0,3}(?:`{3,}|~{3,})[ \t]*([^\n]*)\n")
_CODE = re.compile(r"(?s) {0,3}(`{3,}|~{3,})[^\n]*\n(?:.*\n)? {0,3}\1[`~]*\s*\Z", re.ASCII)
#: Chunks, and characters of them, that a task returns at once.
BATCH_CHUNKS, BATCH_CHARS = 8192, 16_000_000


def _unquote(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), r"""^(["'])(.*)\1$""", "$2")


def front_matter(docs: DataFrame) -> DataFrame:
    """doc_id, title (null if none), tags and body, and the lines before the body. Tags may be inline or a block list, whose items share an indent."""
    raw = F.regexp_extract("text", _FRONT, 1)
    # the first key's indent is that of the root; deeper and shallower lines are no keys
    block = F.regexp_replace(raw, F.concat(F.lit("(?m)^"), F.regexp_extract(raw, r"(?m)^([ \t]*)[^\s#:][^:\n]*:", 1)), F.lit(""))
    value = lambda key: F.regexp_extract("block", rf"(?mi)^{key}[ \t]*:[ \t]*(.*?)[ \t]*\r?$", 1)
    inline = F.split(F.regexp_replace(value("tags"), r"^\[|\]$", ""), ",")
    listed = F.regexp_extract_all(F.regexp_extract("block", r"(?mi)^tags[ \t]*:[ \t]*\r?\n((?:[ \t]*(?:#[^\n]*)?\r?\n)*([ \t]*)-[ \t][^\n]*(?:\n(?:\2-[ \t][^\n]*|[ \t]*(?:#[^\n]*)?\r?(?=\n|\z)))*)", 1), F.lit(r"(?m)^[ \t]*-[ \t]+(?!-)(.+?)(?:[ \t]+#.*)?[ \t]*\r?$"), F.lit(1))
    clean = lambda a: F.filter(F.transform(a, _unquote), lambda t: t != "")
    # most texts have none and are looked at no further
    begins = F.startswith("text", F.lit("---"))
    rows = docs.withColumn("block", block).withColumn("body", F.when(begins, F.regexp_replace("text", _FRONT, "")).otherwise(F.col("text")))
    head = F.expr("substring(text, 1, length(text) - length(body))")
    skipped = F.when(begins, F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))).otherwise(F.when(F.col("text").isNotNull(), 0))
    title = _unquote(value("title"))
    return rows.select(
        "doc_id", F.when(title != "", title).alias("title"),
        F.coalesce(F.when(value("tags") != "", clean(inline)).otherwise(clean(listed)), F.array().cast("array<string>")).alias("tags"),
        "body", skipped.alias("skipped"),
    )


def _fences(lines: list[tuple[int, str, bool]]) -> dict[int, list[tuple[int, float]]]:
    """By their first line, opens and closes (infinite: at the end) of every fence: it closes at the same mark, as long or longer, with nothing after it."""
    marks = [(line, m[1][0], len(m[1]), m[2].strip(" ")) for line, content, _ in lines if (m := _FENCE.match(content))]
    found, opened, c, n = defaultdict(list), 0, "", 0
    for line, mark, size, rest in sorted(marks):
        if n == 0:
            if mark == "~" or "`" not in rest:
                opened, c, n = line, mark, size
        elif mark == c and size >= n and rest == "":
            found[opened].append((opened, line))
            n = 0
    if n:
        found[opened].append((opened, float("inf")))
    return found


class Line(NamedTuple):
    line: int
    text: str
    fence: int | None
    level: int
    heading: str | None


def marked_lines(bodies: Iterable[tuple[int, str]], fenced: bool = True) -> list[Line]:
    """Lines of a document (bodies: skipped, body; several are mixed by line): their number in the whole file, text with its break, fence (its first line or None), level (0: no heading) and heading."""
    lines = []
    for skipped, body in bodies:
        every = body.split("\n")
        lines += [(i + skipped, _RETURN.sub("", x) if "\r" in x else x, i == len(every)) for i, x in enumerate(every, 1)]
    lines.sort()
    fences = _fences(lines) if fenced else {}
    if fences:
        lines = [(*x, f) for x in lines for f in fences.get(x[0], [None])]
    fence, closes, before, paragraph = None, 0, False, -1
    rows, paragraphs = [], []  # number, content, last, fence, prose, paragraph; setext level, prose lines
    before_rule = False  # of the line before: prose but for underlines
    for line, content, last, *opens in lines:
        if opens and opens[0]:
            fence, closes = opens[0]
        inside = fence if fence is not None and line <= closes else None
        could = inside is None and not _NOT_PROSE.match(content)
        rule = inside is None and bool(_UNDERLINE.match(content))
        prose = could and not (rule and before_rule)
        if prose and not before:
            paragraph += 1
            paragraphs.append([None, []])
        if prose:
            paragraphs[paragraph][1].append((line, content))
        elif before and rule:
            paragraphs[paragraph][0] = 1 if content.lstrip(" ").startswith("=") else 2
        rows.append((line, content, last, inside, paragraph if prose and not before else None))
        before, before_rule = prose, could
    out = []
    for line, content, last, inside, begins in rows:
        level, text = 0, None
        if inside is None and (m := _HEADING.match(content)):
            level, text = len(m[1]), m[2] or ""
        elif begins is not None and paragraphs[begins][0]:
            level, text = paragraphs[begins][0], " ".join(x.strip(" ") for _, x in sorted(paragraphs[begins][1]))
        if text is not None:
            text = _SPACES.sub(" ", text.strip(" ").replace("`", " ").replace("*", " ")).strip(" ")
        out.append(Line(line, content if last else content + "\n", inside, level, text))
    return out


def _sections(lines: list[Line]) -> Iterator[tuple[list[str], list[Line]]]:
    """Each section's heading path (the headings above it and its own, outermost first) and lines; the first may be what stands before any heading."""
    above: list[tuple[int, str]] = []
    held: list[Line] = []
    for x in lines:
        if x.level:
            if held:
                yield [h for _, h in above], held
            above = [a for a in above if a[0] < x.level] + [(x.level, x.heading)]
            held = []
        held.append(x)
    if held:
        yield [h for _, h in above], held


def pack_sizes(sizes: list[int], wholes: list[int], alone: list[bool], atomic: list[bool], bare: list[bool], blank: list[bool], cap: int) -> list[tuple[int, int, bool]]:
    """Pieces of a section's parts: first part, last part + 1, and whether the end of the piece before is repeated.

    wholes: of the line that a part belongs to; alone: a part of a long line but for its last; atomic: a fence or
    table; bare: only headings and empty lines; blank: white space only.
    """
    pieces: list[list] = []  # first, end, atomic, joined with a heading

    def push(a: int, b: int) -> None:
        if a < b and not all(blank[a:b]):
            pieces.append([a, b, False, False])

    i = 0
    while i < len(sizes):
        if atomic[i]:
            caption = pieces and not pieces[-1][2] and pieces[-1][1] == i and all(bare[pieces[-1][0] : i])
            pieces.append([pieces.pop()[0] if caption else i, i + 1, True, True])
            i += 1
            continue
        a = i
        size = 0
        while i < len(sizes) and not atomic[i]:
            if size and size + wholes[i] > cap:
                push(a, i)
                a, size = i, 0
            if alone[i]:
                push(i, i + 1)
                a = i + 1
            else:
                size += sizes[i]
            i += 1
        push(a, i)
    joined: list[list] = []
    for piece in pieces:
        joined.append(piece)
        while len(joined) > 1:
            (a, b, fixed, _), (c, d, next_fixed, _) = joined[-2:]
            if fixed or next_fixed or b != c or sum(sizes[a:d]) > cap + OVERLAP_CHARS or not all(bare[a:b]):
                break
            joined[-2:] = [[a, d, False, True]]
    return [(a, b, k > 0 and not any(x for p in joined[k - 1 : k + 1] for x in p[2:])) for k, (a, b, _, _) in enumerate(joined)]


class Part(NamedTuple):
    text: str
    first: int
    last: int
    whole: int
    alone: bool
    atomic: bool


def _parts(section: list[Line], cap: int, cut: re.Pattern) -> list[Part]:
    """Whole fences and tables, and lines of prose, those longer than the cap cut after a token or hard where they have none."""
    parts = []
    kind = lambda x: ("f", x.fence) if x.fence is not None else ("t", 0) if x.text.lstrip(" ").startswith("|") else ("p", x.line)
    for k, block in groupby(section, kind):
        block = list(block)
        text, atomic = "".join(t for _, t in sorted((x.line, x.text) for x in block)), k[0] != "p"
        pieces = [text] if atomic or len(text) <= cap else cut.findall(text)
        parts += [Part(t, block[0].line, block[-1].line, len(text), i < len(pieces) - 1, atomic) for i, t in enumerate(pieces)]
    return parts


def _blank(text: str) -> bool:
    return not text.strip(_WHITE)


def _pieces(parts: list[Part], cap: int) -> list[tuple[int, int, bool]]:
    if sum(len(p.text) for p in parts) <= cap:
        return [(0, len(parts), False)]
    bare = [bool(_BARE.match(p.text.lstrip(" "))) for p in parts]
    return pack_sizes([len(p.text) for p in parts], [p.whole for p in parts], [p.alone for p in parts], [p.atomic for p in parts], bare, [_blank(p.text) for p in parts], cap)


def _tail(before: str, take: int) -> str:
    """The end of a piece that the next one repeats: at most `take` characters, from a token's start."""
    if len(before) <= take:
        return before
    found = _TAIL.match(before[-(take + 1) :])
    return found[1] if found else ""


def _kind(text: str) -> tuple[str, str | None]:
    """kind and lang of a chunk."""
    body = _TITLE_LINE.sub("", text, count=1) if _TITLE_LINE.match(text) else text
    if _CODE.match(body):
        info = _INFO.match(body)
        return "code", (info[1].strip(" ") if info else "") or None
    return ("table" if body.lstrip(" ").startswith("|") else "prose"), None


def chunks_of(bodies: Iterable[tuple[int, str]], cap: int = CAP_CHARS, fenced: bool = True) -> Iterator[tuple]:
    """seq, heading_path, kind, lang, line_start, line_end and text of the chunks of one document (bodies: skipped, body)."""
    cut = re.compile(rf"(?s).{{1,{cap}}}\Z|.{{1,{cap}}}(?<={_EDGE})|.{{1,{cap}}}", re.ASCII)
    seq, take = 0, min(OVERLAP_CHARS, cap // 10)
    for path, section in _sections(marked_lines(bodies, fenced)):
        parts, before = _parts(section, cap, cut), ""
        for nth, (a, b, repeat) in enumerate(_pieces(parts, cap)):
            whole = "".join(p.text for p in parts[a:b])
            tail = _tail(before, take) if repeat and nth else ""
            before = whole
            if _blank(whole):
                continue
            text = (tail + whole).removesuffix("\n")
            yield seq, path, *_kind(text), parts[a].first - tail.count("\n"), parts[b - 1].last, text
            seq += 1


def chunk(docs: DataFrame, cap: int = CAP_CHARS) -> DataFrame:
    """doc_id, seq, heading_path, kind, lang, line_start, line_end and text of every chunk.

    A section up to the cap is one chunk. A longer one is packed: prose lines up to the cap, whole fences and whole
    tables; a line longer than the cap is cut after a token, or hard where it has none. Chunks of white space only are
    dropped; lines are those of the file. Rows that share a doc_id, or have none, are one document, whose lines are mixed.
    """
    bodies = front_matter(docs).filter(F.col("body").isNotNull()).select("doc_id", "skipped", "body")
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__doc"))  # texts are not read for it
    twice = scan.stored(ids)
    n = twice.count()
    one = F.array(F.struct("skipped", "body")).alias("bodies")
    if not n:
        rows = bodies.select("doc_id", one)
    else:
        small = F.broadcast(twice) if n <= BROADCAST_IDS else twice
        same = F.col("doc_id").eqNullSafe(F.col("__doc"))
        several = bodies.join(small, same, "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("skipped", "body")).alias("bodies"))
        rows = bodies.join(small, same, "left_anti").select("doc_id", one).union(several)
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, seq int, heading_path array<string>, kind string, lang string, line_start int, line_end int, text string"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        names = ["doc_id", "seq", "heading_path", "kind", "lang", "line_start", "line_end", "text"]
        for batch in batches:
            doc, bodies = batch.columns
            at: list[int] = []
            held: list[tuple] = []
            chars = 0

            def returned(doc=doc) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([doc.take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True))], names=names)

            for i in range(batch.num_rows):
                known = doc[i].is_valid
                for x in chunks_of([(b["skipped"], b["body"]) for b in bodies[i].as_py()], cap, known):
                    at.append(i)
                    held.append(x)
                    chars += len(x[-1])
                    if len(held) >= BATCH_CHUNKS or chars >= BATCH_CHARS:
                        yield returned()
                        at, held, chars = [], [], 0
            if held:
                yield returned()

    return rows.mapInArrow(search, schema)
