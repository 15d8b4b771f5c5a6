"""Column expressions over plain text. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as K

CJK = rf"[\x{{3000}}-\x{{2EBEF}}&&[{K.CJK_RANGES}]]"
# A comparable word: letters, digits, underscore; apostrophes only inside.
SPOKEN_WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_']*[\p{L}\p{N}_])?"


def strip(c: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(c, F.lit(K.WS_CHARS))


def squeeze(c: Column) -> Column:
    """White-space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, f"[{K.WS}]+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it as often as ``body`` likes."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(c: Column) -> Column:
    return F.array_remove(F.split(squeeze(c), " "), "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("bigint")


def spoken_words(c: Column) -> Column:
    """Lower-cased words without punctuation, the unit of transcript comparison."""
    return F.regexp_extract_all(F.lower(c), F.lit(SPOKEN_WORD), F.lit(0))


def snippet(c: Column, n: int = 100) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def clean_speech(c: Column) -> Column:
    """Text as it is spoken: one-line, no tags, tight and single punctuation."""
    punct = "[.,!?;:¿¡]"
    c = F.replace(squeeze(c), F.lit("@"), F.lit("a"))
    c = F.regexp_replace(c, " ([.,!?;:¿¡-])", "$1")
    c = F.replace(F.replace(c, F.lit("<<"), F.lit('"')), F.lit(">>"), F.lit('"'))
    c = F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), " +", " ")
    return F.trim(F.regexp_replace(c, f"{punct}+({punct})", "$1"))


def slug(c: Column) -> Column:
    """File-safe snake case with accents folded."""
    c = F.regexp_replace(F.translate(F.lower(c), " ", "_"), "_+", "_")
    c = F.translate(F.btrim(c, F.lit("_")), K.ACCENTS, K.ACCENTS_PLAIN)
    return F.btrim(F.regexp_replace(c, "[^a-z0-9_]", ""), F.lit("_"))


def stem_title(stem: Column) -> Column:
    return F.translate(stem, "_-", "  ")


def after_reasoning(c: Column) -> Column:
    """What a model says after its reasoning block, cleaned for speech."""
    said = F.when(F.lower(c).contains("think"), F.substring_index(c, "</think>", -1)).otherwise(c)
    return clean_speech(strip(said))


def without_reasoning(c: Column) -> Column:
    return strip(F.regexp_replace(c, "(?is)<think>.*?</think>", ""))


def short_title(c: Column, limit: int = 50) -> Column:
    """Table display form: cut to ``limit`` characters with an ellipsis."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 3)), F.lit("..."))
                  ).otherwise(c)


def marker_title(c: Column) -> Column:
    return F.translate(c, "\n\r", " ")


def first_sentence_title(c: Column) -> Column:
    """A chapter's working title: its whole first sentence on one line."""
    first = F.regexp_extract(c, rf"(?s)\A(.*?(?:[{K.SENTENCE_END}]|\z))", 1)
    return squeeze(first)


def ratio_of(c: Column, keep_class: str) -> Column:
    """Share of characters that are *not* removed by deleting ``keep_class``; null when empty."""
    n = F.length(c)
    return F.when(n > 0, (n - F.length(F.regexp_replace(c, keep_class, ""))) / n)


def mojibake_ratio(c: Column) -> Column:
    return ratio_of(c, r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x80-\x9F]")


def whitespace_ratio(c: Column) -> Column:
    return ratio_of(c, r"[ \t\n\r]")


def nonword_ratio(c: Column) -> Column:
    return ratio_of(c, r"[^\p{L}\p{N} \t\n\r]")


def threshold(raw: Column | str | float | None, default: float) -> Column:
    """A threshold given as text or number; anything unusable falls back to the default."""
    if raw is None:
        return F.lit(default)
    col = raw if isinstance(raw, Column) else F.lit(raw)
    return F.coalesce(col.cast("string").try_cast("double"), F.lit(default))


def quality_reason(
    c: Column,
    mojibake_max: Column | str | float | None = None,
    nonword_max: Column | str | float | None = None,
) -> Column:
    """First failing text rule in order of cost, or ``clean``."""
    ws = whitespace_ratio(c)
    return (
        F.when(F.length(strip(F.coalesce(c, F.lit("")))) < K.MIN_CHARS, "empty")
        .when(mojibake_ratio(c) > threshold(mojibake_max, K.MOJIBAKE_MAX), "mojibake")
        .when((ws < K.WHITESPACE_MIN) | (ws > K.WHITESPACE_MAX), "whitespace")
        .when(nonword_ratio(c) > threshold(nonword_max, K.NONWORD_MAX), "nonword")
        .otherwise("clean")
    )


def verdict_of(reason: Column) -> Column:
    return F.when(reason == "clean", "clean").otherwise("garbage")


def half_up(c: Column, digits: int) -> Column:
    """Rounding that gives the same digits on every engine."""
    scale = float(10 ** digits)
    return F.floor(c * scale + 0.5) / scale


def fixed_digits(c: Column, digits: int = 2) -> Column:
    """Non-negative number as text with a fixed number of decimals."""
    scaled = F.floor(c * float(10 ** digits) + 0.5).cast("bigint")
    whole = F.floor(scaled / 10 ** digits).cast("bigint").cast("string")
    frac = F.lpad((scaled % 10 ** digits).cast("string"), digits, "0")
    return F.concat_ws(".", whole, frac)
