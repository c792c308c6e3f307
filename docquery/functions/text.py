"""Text analysis as column expressions: folding, scripts, simple tokens, identifiers, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The folding table. Letters of _FROM become those of _TO at the same place; letters past its end go.
_FULLWIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_FROM = "ёЁİأإآةى" + _FULLWIDTH + "".join(chr(c) for c in range(0x064B, 0x0653)) + "ـ"
_TO = "еЕIاااهي" + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))

# The code points of each script, of which its alphabetic characters count; ties go to the earlier script.
_RANGES = {
    "latin": r"\x{41}-\x{24F}\x{1E00}-\x{1EFF}",
    "cyrillic": r"\x{400}-\x{52F}",
    "cjk": r"\x{1100}-\x{11FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{FF66}-\x{FF9F}",
    "arabic": r"\x{600}-\x{6FF}\x{750}-\x{77F}",
}
SCRIPTS = {name: rf"[{r}&&\p{{IsAlphabetic}}]" for name, r in _RANGES.items()}

#: A character of a script but the Latin one.
_NOT_LATIN = "[" + "".join(r for n, r in _RANGES.items() if n != "latin") + "]"

TOKEN = r"[\p{L}\p{N}]+"
SNIPPET_CHARS = 240


def fold(text: Column | str) -> Column:
    """Spelling variants to one form: Cyrillic yo, dotted I, full-width ASCII, Arabic letter forms; vowel marks go."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(f"[{_FROM}]"), F.translate(text, _FROM, _TO)).otherwise(text)


def script_counts(text: Column | str) -> list[Column]:
    return [F.regexp_count(text, F.lit(p)) for p in SCRIPTS.values()]


def script_of(text: Column | str) -> Column:
    """The script with the most letters; other if there are none."""
    counts = script_counts(text)
    most = F.greatest(*counts)
    out = F.when(most == 0, "other")
    for name, n in zip(SCRIPTS, counts, strict=True):
        out = out.when(n == most, name)
    return out


def script_runs(text: Column | str) -> Column:
    """Parts of one script each, split before a letter of another script; digits and marks stay with the part before them."""
    out = F.col(text) if isinstance(text, str) else text
    # a letter and all that follows it but letters of other scripts, in one pass; the last such run ends with the text
    foreign = {name: "".join(r for n, r in _RANGES.items() if n != name) for name in SCRIPTS}
    runs = "|".join(rf"{letter}[\P{{IsAlphabetic}}[^{foreign[name]}]]*+" for name, letter in SCRIPTS.items())
    marked = F.regexp_replace(out, runs, "$0\u0001")
    marked = F.when(out.rlike("|".join(SCRIPTS.values())), F.left(marked, F.length(marked) - 1)).otherwise(marked)
    return F.split(F.when(out.rlike(_NOT_LATIN), marked).otherwise(out), "\u0001")


def stem_language(word: Column | str) -> Column:
    """Language whose stems a word may take (en, ru or ar), or null: short, all-capital, camel-case and mixed words are protected."""
    word = F.col(word) if isinstance(word, str) else word
    plain = (F.length(word) > 3) & word.rlike(r"^\p{L}+$") & (word != F.upper(word)) & ~word.rlike(r"\p{Ll}\p{Lu}|\p{Lu}\p{Lu}\p{Ll}")
    unicase = word.rlike(r"^\p{Lo}+$") & (F.length(word) > 3)
    script = script_of(word)
    return F.when(plain | unicase, F.when(script == "latin", "en").when(script == "cyrillic", "ru").when(script == "arabic", "ar"))


def simple_tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def identifier_words(text: Column | str) -> Column:
    """White-space words that hold both a letter or digit and another character, joined with spaces."""
    words = r"(?<!\S)(?:[\p{L}\p{N}]++[^\s\p{L}\p{N}]|[^\s\p{L}\p{N}]++[\p{L}\p{N}])\S*+"
    return F.array_join(F.regexp_extract_all(text, F.lit(words), F.lit(0)), " ")


def snippet(text: Column | str, chars: int = SNIPPET_CHARS) -> Column:
    """The first characters, never ending between a carriage return and its line feed."""
    cut = F.substring(text, 1, chars)
    split = F.substring(text, chars, 2) == "\r\n"
    return F.when(split, F.substring(text, 1, chars - 1)).otherwise(cut)


def line_count(text: Column) -> Column:
    """Lines as an editor shows them: a final line break does not begin another."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, 0).otherwise(breaks + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1))
