"""License detection with ordered signature rules over the words of a text.

A rule is a regular expression over the text's words joined by single spaces. It runs only where all of its keywords
occur. Detections are taken in the rules' order (most specific first); one that lies inside an accepted detection is
suppressed. The four base phrases are always reported. Rules are hand-written signatures (license_signatures), whose
keywords are words that each match must hold, and names of license families in some sentence forms.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docquery.llm import common
from docquery.llm.license_signatures import signatures

SEPARATORS = common.byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

LIC = "licen[cs]e"
#: Label, the name in words, keywords of which one must occur, and the versions that may follow.
FAMILIES = [
    ("agpl", f"(?:gnu )?affero general public {LIC}|agpl", "affero agpl", "3 0|1|3"),
    ("lgpl", f"(?:gnu )?(?:lesser|library) general public {LIC}|lgpl", "lesser library lgpl", "2 0|2 1|3 0|2|3"),
    ("gfdl", f"(?:gnu )?free documentation {LIC}|gfdl", "documentation gfdl", "1 1|1 2|1 3"),
    ("gpl", f"(?:gnu )?general public {LIC}|gpl|gnu gpl", "general gpl", "2 0|3 0|1|2|3"),
    ("apache", f"apache(?: software)? {LIC}|asl", "apache asl", "1 0|1 1|2 0|2"),
    ("mit", f"mit {LIC}|mit x11 {LIC}|expat {LIC}", "mit expat", ""),
    ("bsd-4-clause", f"(?:original|4 clause|four clause) bsd {LIC}|bsd 4 clause(?: {LIC})?", "bsd", ""),
    ("bsd-3-clause", f"(?:new|modified|revised|3 clause|three clause) bsd {LIC}|bsd 3 clause(?: {LIC})?", "bsd", ""),
    ("bsd-2-clause", f"(?:simplified|freebsd|2 clause|two clause) (?:bsd )?{LIC}|bsd 2 clause(?: {LIC})?", "bsd simplified freebsd clause", ""),
    ("0bsd", f"(?:zero clause|0 clause) bsd {LIC}|0bsd", "bsd 0bsd", ""),
    ("bsd", f"bsd(?: style)? {LIC}", "bsd", ""),
    ("mpl", f"mozilla public {LIC}|mpl", "mozilla mpl", "1 0|1 1|2 0"),
    ("epl", f"eclipse public {LIC}|epl", "eclipse epl", "1 0|2 0"),
    ("edl", f"eclipse distribution {LIC}", "eclipse", "1 0"),
    ("cddl", f"common development and distribution {LIC}|cddl", "development cddl", "1 0|1 1"),
    ("cpl", f"common public {LIC}", "common", "1 0"),
    ("eupl", f"european union public {LIC}|eupl", "european eupl", "1 0|1 1|1 2"),
    ("artistic", f"artistic {LIC}", "artistic", "1 0|2 0"),
    ("isc", f"isc {LIC}", "isc", ""),
    ("zlib", f"zlib(?: libpng)? {LIC}", "zlib", ""),
    ("boost", f"boost software {LIC}", "boost", "1 0"),
    ("unlicense", "(?:the )?unlicense", "unlicense", ""),
    ("wtfpl", f"do what the fuck you want to public {LIC}|wtfpl", "fuck wtfpl", "2"),
    ("python", f"python software foundation {LIC}|psf {LIC}", "python psf", "2"),
    ("php", f"php {LIC}", "php", "3 01|3 0"),
    ("ruby", f"ruby {LIC}", "ruby", ""),
    ("openssl", f"openssl {LIC}", "openssl", ""),
    ("postgresql", f"postgresql {LIC}", "postgresql", ""),
    ("ofl", f"(?:sil )?open font {LIC}", "font", "1 0|1 1"),
    ("ms-pl", f"microsoft public {LIC}|ms pl", "microsoft ms", ""),
    ("ms-rl", f"microsoft reciprocal {LIC}|ms rl", "microsoft ms", ""),
    ("upl", f"universal permissive {LIC}", "permissive", "1 0"),
    ("ncsa", f"(?:university of illinois )?ncsa(?: open source)? {LIC}", "ncsa", ""),
    ("osl", f"open software {LIC}", "software", "1 0|2 0|3 0"),
    ("afl", f"academic free {LIC}", "academic", "2 1|3 0"),
    ("odbl", f"open (?:data commons open )?database {LIC}|odbl", "database odbl", "1 0"),
    ("busl", f"business source {LIC}", "business", "1 1"),
    ("sspl", f"server side public {LIC}|sspl", "side sspl", "1"),
    ("elastic", f"elastic {LIC}", "elastic", "2 0"),
    ("cc0", "cc0(?: 1 0)?(?: universal)?|creative commons zero", "cc0 creative", ""),
    ("cc-by-nc-nd", "(?:cc|creative commons)(?: attribution| by)(?: non ?commercial| nc) (?:no ?deriv(?:ative)?s|nd)", "cc creative", "2 0|2 5|3 0|4 0"),
    ("cc-by-nc-sa", "(?:cc|creative commons)(?: attribution| by)(?: non ?commercial| nc) (?:share ?alike|sa)", "cc creative", "2 0|2 5|3 0|4 0"),
    ("cc-by-nc", "(?:cc|creative commons)(?: attribution| by)(?: non ?commercial| nc)", "cc creative", "2 0|2 5|3 0|4 0"),
    ("cc-by-nd", "(?:cc|creative commons)(?: attribution| by) (?:no ?deriv(?:ative)?s|nd)", "cc creative", "2 0|2 5|3 0|4 0"),
    ("cc-by-sa", "(?:cc|creative commons)(?: attribution| by) (?:share ?alike|sa)", "cc creative", "2 0|2 5|3 0|4 0"),
    ("cc-by", "(?:cc|creative commons)(?: attribution| by)", "cc creative", "2 0|2 5|3 0|4 0"),
]

#: Sentence forms, most specific first: the pattern around {name} and {version}, its keywords, and how sure it is.
FORMS = [
    (r"spdx {lic} identifier (?:{name}|{label})(?: (?:{version}))?(?: only| or later)?", ("spdx",), 0.99),
    (r"(?:licensed|released|distributed|published|covered|governed|available|redistributed) (?:\S+ ){{0,4}}?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{name})(?: (?:version |v)?(?:{version}))?", ("under",), 0.95),
    (r"(?:subject to|according to|see|in accordance with|under) (?:the )?(?:terms of )?(?:the )?(?:{name})(?: (?:version |v)?(?:{version}))?", (), 0.85),
    (r"(?:{name}) (?:version |v)(?:{version})(?: or (?:any )?later(?: version)?)?", ("version",), 0.8),
    (r"copyright (?:\S+ ){{0,8}}?(?:{name})", ("copyright",), 0.7),
    (r"(?:{name})(?: (?:{version}))?", (), 0.6),
]

#: Signatures at least as sure as this come before the families' forms, the others after them.
STRONG = 0.85
#: Keywords of a signature: so many of the longest words that it cannot match without.
KEYWORDS = 3


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    all_of: frozenset[str]
    any_of: frozenset[str]
    sure: float

    def may_match(self, present) -> bool:
        return self.all_of <= present and not self.any_of.isdisjoint(present)


def _rule(label: str, text: str, all_of, any_of, sure: float) -> Rule:
    return Rule(label, re.compile(rf"(?<!\S)(?:{text})(?!\S)".encode()), frozenset(all_of), frozenset(any_of), sure)


_GROUP = re.compile(r"\(\?:((?:[^()]|(\((?:[^()])*\)))*)\)(\?|\{|)")


def must_hold(pattern: str) -> set[str]:
    """Words that every match of the pattern holds: those that stand alone outside its groups, without a mark that makes them vary."""
    # an optional group that brings its own space leaves the words beside it whole
    own_space = lambda m: "" if m[3] == "?" and (m[1][0] == " " or m[1][-1] == " ") else "\0"
    flat = _GROUP.sub(own_space, pattern).split(" ")
    return {w for w, after in zip(flat, [*flat[1:], ""], strict=True) if re.fullmatch("[a-z0-9]+", w) and not after.startswith("?")}


def keywords(pattern: str) -> tuple[set[str], set[str]]:
    """Words of which all must occur in a text that the pattern matches, and words of which one must."""
    longest = lambda words: sorted(words, key=lambda w: (-len(w), w))
    if words := must_hold(pattern):
        every = set(longest(words)[:KEYWORDS])
        return every, every
    for m in _GROUP.finditer(pattern):
        one_of = [longest(must_hold(x.strip())) for x in m[1].split("|")]
        if m[3] == "" and all(one_of):
            return set(), {x[0] for x in one_of}
    raise ValueError(f"no keyword for {pattern}")


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority: strong signatures, then by form and family, then weak signatures."""
    signed = [_rule(label, text, *keywords(text), sure) for label, sure, text in signatures()]
    named = [
        _rule(label, form.format(name=name, version=version or "(?!)", lic=LIC, label=label.replace("-", " ")), words, [*any_of.split(), *(label.split("-")[:1] if "{label}" in form else [])], sure)
        for form, words, sure in FORMS
        for label, name, any_of, version in FAMILIES
        if version or "{name}) (?:version |v)(?:{version})" not in form
    ]
    return (*(r for r in signed if r.sure >= STRONG), *named, *(r for r in signed if r.sure < STRONG))


@cache
def gate_words() -> frozenset[str]:
    """All keywords, and the first words of the base phrases."""
    return frozenset().union(*(r.all_of | r.any_of for r in rules()), (p.split()[0] for p in BASE))


def detect_in(text: bytes, starts: np.ndarray, present: set[str] | frozenset[str]) -> list[tuple[int, int, Rule]]:
    """Accepted detections (first word, last word + 1, rule) in words joined by single spaces; starts: of each word, and one past the end."""
    kept: list[tuple[int, int, Rule]] = []
    for rule in rules():
        if not rule.may_match(present):
            continue
        for m in rule.pattern.finditer(text):
            a, b = (int(np.searchsorted(starts, x)) for x in (m.start(), m.end() + 1))
            if not any(x <= a and b <= y for x, y, _ in kept):
                kept.append((a, b, rule))
    return kept


def detect(words: list[str], present: set[str] | frozenset[str]) -> list[tuple[int, int, Rule]]:
    """As detect_in, for a list of words; `present`: the gate words among them."""
    coded = [w.encode() for w in words]
    return detect_in(b" ".join(coded), np.cumsum([0] + [len(w) + 1 for w in coded]), present)


_PHRASES = [(re.compile(rf"(?<!\S){phrase}(?!\S)".encode()), label) for phrase, label in BASE.items()]


def base_places(text: bytes, starts: np.ndarray) -> list[tuple[int, str]]:
    """Every place where the words of a base phrase stand consecutively (no phrase overlaps itself)."""
    return sorted((int(np.searchsorted(starts, m.start())), label) for pattern, label in _PHRASES for m in pattern.finditer(text))


def joined(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Words of a buffer with single spaces between them, and where each begins there; one start more, past the end."""
    sizes = stops - starts + 1
    edges = np.concatenate([[0], np.cumsum(sizes)])
    out = data[np.repeat(starts - edges[:-1], sizes) + np.arange(edges[-1])] if len(data) > stops[-1] else np.append(data, np.uint8(32))[np.repeat(starts - edges[:-1], sizes) + np.arange(edges[-1])]
    out[edges[1:] - 1] = 32
    return out[:-1].tobytes(), edges


def scan(docs: DataFrame) -> DataFrame:
    """Licenses in every whole text.

    Result: doc_id, n_words, n_base, first_word, last_word (null without base places), base_labels, labels (sorted,
    comma-joined, empty if none), score (1 less the product of the detections' doubts, 0 if none) and spans, the
    accepted detections as first word, last word and label. Null and empty texts have no words. Rows are scanned one
    by one, so repeated rows and null ids give rows of their own; of detections of the same words the first rule's
    stays; an empty table gives no rows; other columns are ignored.
    """
    shape = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first:long,last:long,label:string>>"
    arrow = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")], ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string())])))])

    def run(batches):
        gates, leads = sorted(gate_words()), {p.split()[0] for p in BASE}
        letters = np.frombuffer("".join(gates).encode(), np.uint8)
        ends = np.cumsum([len(g) for g in gates])
        hashes = common.span_hash(common.prefix_hash(letters), ends - [len(g) for g in gates], ends)
        by_hash = dict(zip(hashes.tolist(), gates, strict=True))
        maybe = np.zeros(1 << 16, bool)
        maybe[hashes & np.uint64(0xFFFF)] = True
        for batch in common.slices(batches):
            data, offsets = common.text_buffer(batch.column(1))
            data = common.LOWER[data]
            starts, stops, before = common.word_bounds(data, offsets, SEPARATORS)
            hashed = common.span_hash(common.prefix_hash(data), starts, stops)
            at = np.flatnonzero(maybe[hashed & np.uint64(0xFFFF)])
            at = at[np.isin(hashed[at], hashes)]
            row_of = np.searchsorted(before, at, side="right") - 1
            present: dict[int, set[str]] = {}
            for row, h in zip(row_of.tolist(), hashed[at].tolist(), strict=True):
                present.setdefault(row, set()).add(by_hash[h])
            out = {name: [None] * batch.num_rows for name in arrow.names}
            for row in range(batch.num_rows):
                out["n_base"][row], out["base_labels"][row], out["labels"][row], out["score"][row], out["spans"][row] = 0, "", "", 0.0, []
                if (seen := present.get(row, set())).isdisjoint(leads) and not any(r.may_match(seen) for r in rules()):
                    continue
                low, high = int(before[row]), int(before[row + 1])
                own = joined(data, starts[low:high], stops[low:high])
                places, found = base_places(*own), detect_in(*own, seen)
                base = {label for _, label in places}
                labels = base | {r.label for _, _, r in found}
                doubt = float(np.prod([1 - r.sure for _, _, r in found])) * (0.4 if base and not found else 1.0)
                out["n_base"][row] = len(places)
                if places:
                    out["first_word"][row], out["last_word"][row] = places[0][0], places[-1][0]
                out["base_labels"][row], out["labels"][row], out["score"][row] = ",".join(sorted(base)), ",".join(sorted(labels)), round(1 - doubt, 6)
                out["spans"][row] = [{"first": a, "last": b - 1, "label": r.label} for a, b, r in sorted(found, key=lambda x: x[:2])]
            out["doc_id"], out["n_words"] = batch.column(0), np.diff(before)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, shape)


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in all documents. Nulls, long texts, ties, repeated rows, empty tables and extra columns: as scan states."""
    return scan(common.table(spark, sf_dir, "documents")).drop("spans")
