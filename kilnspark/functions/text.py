"""Text functions as Column -> Column expressions; all but `similar_characters` and `normalize_any` are native,
and `normalize_exact` is for most texts."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kilnspark.functions.arrow import arrow_udf
from kilnspark.functions.wordlists import BOILERPLATE_PATTERNS, FORMAT_MARKER_PATTERN, INJECTION_PATTERNS, REFUSAL_PATTERN

SPACE = r"(?U)\s+"


def words(x: Column) -> Column:
    """Maximal runs without (Unicode) white space."""
    return F.regexp_extract_all(x, F.lit(r"(?U)(\S+)"), 1)


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"(?U)\S+"))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def is_blank(x: Column) -> Column:
    return ~x.rlike(r"(?U)\S")


def normalize(x: Column) -> Column:
    """Case folded, white space collapsed and trimmed. Native; exact for text in NFC whose only special folding is that of ß."""
    return F.trim(F.regexp_replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), SPACE, " "))


@arrow_udf("string")
def normalize_any(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The same for any Unicode text: NFC, full case folding, white space."""
    for x in batches:
        yield x.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).casefold().split()))


def _settled() -> list[tuple[int, int]]:
    """Ranges of code points that NFC leaves alone whatever stands before them and whose folding is their lower case, so that
    `normalize` is exact for texts of them alone: long runs of such, from the Unicode tables."""
    old, joined = unicodedata.ucd_3_2_0, {0x03A3, *range(0x1C, 0x20)}  # a sigma's lower case depends on its place; 1C to 1F part words only in Python
    for c in map(chr, range(0x11_0000)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<":
            joined.add(int(parts[1], 16))

    def plain(code: int) -> bool:
        c = chr(code)
        if code == 0xDF:
            return True
        known = old.category(c) not in ("Cn", "Cs", "Co")
        return known and code not in joined and not unicodedata.combining(c) and not 0x1160 <= code < 0x1200 and unicodedata.normalize("NFC", c) == c and c.lower() == c.casefold() and len(c.lower()) == 1

    runs, start = [], None
    for code in range(0x1_0000):
        if plain(code):
            start = code if start is None else start
        elif start is not None:
            runs.append((start, code - 1))
            start = None
    return [(a, b) for a, b in runs if b - a >= 15 or b < 0x250]


@cache
def settled_class() -> str:
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _settled())


@cache
def unsettled() -> str:
    """A pattern of one code point that is not settled. The JVM tries every range of a class for every character: so most characters end at
    a class of single Latin ones (a table of bits), and the others meet only the ranges of their own block."""
    runs, hexed = _settled(), lambda c: f"\\x{{{c:x}}}"
    latin = "".join(hexed(c) for a, b in runs for c in range(a, min(b, 0xFF) + 1))
    blocks, low = [], 0
    for at in range(0, len(runs), 12):
        some = runs[at : at + 12]
        high = some[-1][1] if at + 12 < len(runs) else 0x10_FFFF
        blocks.append(f"[{hexed(low)}-{hexed(high)}&&[^{''.join(f'{hexed(a)}-{hexed(b)}' for a, b in some)}]]")
        low = high + 1
    return f"(?![{latin}])[{''.join(blocks)}]"


def normalize_exact(x: Column) -> Column:
    """`normalize_any`, in which only texts that may change in ways that the JVM's functions don't know go through Python."""
    return F.coalesce(normalize_any(F.when(x.rlike(unsettled()), x)), normalize(x))


def normalized_hash(x: Column) -> Column:
    return F.sha2(normalize_exact(x), 256)


def content_handle(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24))


def approximate_tokens(x: Column) -> Column:
    """0 for the empty text, else the number of words and 1 at least."""
    return F.when(F.length(x) == 0, 0).otherwise(F.greatest(F.lit(1), word_count(x)))


def lexical_set(x: Column) -> Column:
    """Distinct words of the normalised text, stripped of all but letters and digits."""
    bare = F.transform(F.split(normalize(x), " "), lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    return F.array_distinct(F.filter(bare, lambda t: t != ""))


def ascii_tokens(x: Column) -> Column:
    """Lower-case words of a-z and 0-9 only; words that hold any other letter are left out whole."""
    found = F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.filter(found, lambda t: t.rlike("^[a-z0-9]+$"))


def without(tokens: Column, stopwords: list[str]) -> Column:
    return F.array_except(tokens, F.array(*[F.lit(w) for w in stopwords]))


def content_tokens(x: Column, stopwords: list[str], least: int = 1) -> Column:
    tokens = without(ascii_tokens(x), stopwords)
    return tokens if least == 1 else F.filter(tokens, lambda t: F.length(t) >= least)


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct-token arrays; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / F.size(F.array_union(a, b)))


def coverage(a: Column, b: Column) -> Column:
    """Share of a's tokens that b has; 0 if a is empty."""
    return F.size(F.array_intersect(a, b)).cast("double") / F.greatest(F.size(a), F.lit(1))


def repetition_ratio(tokens: Column) -> Column:
    """1 - distinct pairs / pairs of neighbouring tokens; 0 without tokens, 1 with a single one."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat_ws(" ", F.get(tokens, i - 1), F.get(tokens, i)))
    some = 1.0 - F.size(F.array_distinct(pairs)).cast("double") / F.size(pairs)
    return F.when(F.size(tokens) == 0, 0.0).when(F.size(tokens) == 1, 1.0).otherwise(some)


def strip_boilerplate(x: Column) -> Column:
    for p in BOILERPLATE_PATTERNS:
        x = F.regexp_replace(x, "(?i)" + p, "")
    return strip(x)


def sentences(x: Column, least: int = 12) -> Column:
    """Parts between sentence ends and white space, trimmed, of `least` characters or more."""
    parts = F.transform(F.split(x, r"(?<=[.!?])(?U)\s+"), strip)
    return F.filter(parts, lambda s: F.length(s) >= least)


def near_miss(x: Column) -> Column:
    """The text without its last clause and a fixed remark, or with a fixed addition if it has one clause."""
    clauses = F.split(x, r"(?<=\.)(?U)\s+")
    cut = F.concat(F.array_join(F.slice(clauses, 1, F.greatest(F.size(clauses) - 1, F.lit(0))), " "), F.lit(" (the remaining detail was not confirmed in the material)."))
    return F.when(F.size(clauses) > 1, cut).otherwise(F.concat(x, F.lit(" (this additional claim was not supported).")))


def injection_hits(x: Column) -> Column:
    """Patterns that the text matches, in order."""
    marks = F.array(*[F.when(x.rlike("(?i)" + p), F.lit(p)) for p in INJECTION_PATTERNS])
    return F.filter(marks, lambda m: m.isNotNull())


def _occurrences(x: Column, needle: str) -> Column:
    return ((F.length(x) - F.length(F.replace(x, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def artifact_features(x: Column) -> dict[str, Column]:
    bullets = F.regexp_count(x, F.lit("(?m)" + FORMAT_MARKER_PATTERN))
    return {
        "token_count": word_count(x),
        "bullet_count": bullets,
        "heading_count": _occurrences(x, "## "),
        "refusal_count": F.regexp_count(x, F.lit("(?i)" + REFUSAL_PATTERN)),
        "citation_count": _occurrences(x, "[") + _occurrences(x, "]"),
        "punct_count": F.regexp_count(x, F.lit("[!?;:]")),
        "has_format": bullets > 0,
    }


def length_ratio(chosen: Column, rejected: Column) -> Column:
    c, r = approximate_tokens(chosen), approximate_tokens(rejected)
    return F.when(r == 0, F.lit(0.0)).otherwise(c.cast("double") / F.nullif(r, F.lit(0)))


def separability(chosen: Column, rejected: Column) -> Column:
    """The largest relative difference of the superficial features (0 to 1)."""
    a, b = artifact_features(chosen), artifact_features(rejected)
    counts = [n for n in a if n != "has_format"]
    gaps = [F.abs(a[n] - b[n]).cast("double") / F.greatest(a[n], b[n], F.lit(1)) for n in counts]
    return F.greatest(*gaps, F.when(a["has_format"] != b["has_format"], 1.0).otherwise(0.0))


def collapsed(x: Column) -> Column:
    """Lower case, white space collapsed and trimmed; punctuation stays."""
    return F.trim(F.regexp_replace(F.lower(x), SPACE, " "))


@arrow_udf("double")
def similar_characters(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts (no native function equals it)."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def any_phrase(x: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | x.contains(p)
    return out


def polarity(x: Column, negations: list[str], doubles: list[str], opening: list[str]) -> Column:
    """affirmed, negated or unknown, from double negations, the first word, and the parity of negations in 15 words."""
    low = strip(F.lower(x))
    tokens = F.transform(F.slice(words(low), 1, 15), lambda t: F.regexp_replace(t, r"^[.,!?;:]+|[.,!?;:]+$", ""))
    negated = F.size(F.filter(tokens, lambda t: t.isin(negations)))
    plain = F.when(F.get(tokens, F.lit(0)).isin(opening), "negated").when(negated % 2 == 1, "negated").otherwise("affirmed")
    return F.when(is_blank(x), "unknown").when(any_phrase(low, doubles), "affirmed").otherwise(plain)
