"""Column expressions that cut and pack text under length limits.

Each works inside one row on arrays, so no packing needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as K
from .text import CJK, clean_speech, let, squeeze, strip, word_count, words

NO_STRINGS = "array<string>"


def _empty() -> Column:
    return F.array().cast(NO_STRINGS)


def size_in(c: Column, unit: Column | str) -> Column:
    """Length in the given unit: ``bytes`` (UTF-8) or ``chars``."""
    if isinstance(unit, str):
        return F.octet_length(c) if unit == "bytes" else F.length(c)
    return F.when(unit == "bytes", F.octet_length(c)).otherwise(F.length(c))


# Greedy packing is a search for the longest stretch that fits and ends where an item ends. Items are joined by a separator of
# one character, the size of the space that will stand there, and a pattern finds stretch after stretch: each takes up to the
# limit and steps back to the last end of an item. Every character is read about twice, whatever the number of items.

def _all(text: Column, *pattern: Column | str) -> Column:
    """All matches of a pattern put together from texts and columns."""
    parts = [F.lit(p) if isinstance(p, str) else p for p in ("(?s)", *pattern)]
    return F.regexp_extract_all(text, F.concat(*parts), F.lit(0))


def _count(limit: Column | int, least: int = 0) -> Column:
    lim = F.lit(limit) if isinstance(limit, int) else limit
    return F.greatest(lim, F.lit(least)).cast("int").cast("string")


def _join(items: Column, separator: Column) -> Column:
    return F.call_function("array_join", items, separator)


# No character by the Unicode standard; where a text holds it all the same, one for private use that the text does not hold.
_SEPARATOR = "\uffff"
_PRIVATE = (0xF0000, 0x10FFFD)


def with_separator(items: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the items and a character that none of them holds."""
    def free(xs: Column) -> Column:
        every = F.transform(F.sequence(F.lit(_PRIVATE[0]), F.lit(_PRIVATE[1])), lambda code: F.decode(
            F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        used = _all(F.array_join(xs, ""), r"[\x{F0000}-\x{10FFFD}]")
        return F.when(~F.exists(xs, lambda s: s.contains(_SEPARATOR)), _SEPARATOR).otherwise(
            F.element_at(F.array_except(every, used), 1))

    return let(items, lambda xs: let(free(xs), lambda sep: body(xs, sep)))


def pack(items: Column, limit: Column | int) -> Column:
    """Greedy: join items by a space while the joined length stays within ``limit``; no blank groups."""
    lim = F.lit(limit) if isinstance(limit, int) else limit

    def cut(xs: Column, sep: Column) -> Column:
        groups = _all(_join(xs, sep), "[^", sep, "].{0,", _count(lim - 1), "}(?=", sep, "|\\z)|[^", sep, "]+")
        return F.transform(groups, lambda g: F.replace(g, sep, F.lit(" ")))

    return with_separator(items, cut)


def sentences(c: Column) -> Column:
    """Pieces ending in sentence punctuation; blank ones dropped."""
    parts = F.split(c, f"(?<=[{K.SENTENCE_END}])[{K.WS}]*", -1)
    return F.filter(parts, lambda s: F.length(strip(s)) > 0)


def contains_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def unspaced_cjk(c: Column) -> Column:
    """CJK text with too few spaces to be cut at words."""
    spaces = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return (spaces < F.length(c) / 50) & contains_cjk(c)


def split_at_words(c: Column, limit: int) -> Column:
    """Cut an over-long sentence at words; white space inside becomes single spaces.

    A first word beyond the limit comes after an empty piece.
    """
    def cut(flat: Column) -> Column:
        pieces = _all(flat, f"[^ ].{{0,{max(limit - 1, 0)}}}(?= |\\z)|[^ ]+")
        giant = F.length(F.substring_index(flat, " ", 1)) > limit
        return F.when(giant, F.concat(F.array(F.lit("")), pieces)).otherwise(pieces)

    return let(squeeze(c), lambda flat: F.when(
        F.length(flat) <= limit, F.array(flat)).otherwise(cut(flat)))


def split_at_chars(c: Column, limit: int) -> Column:
    """Cut unspaced text every ``limit`` characters, earlier when the last fifth ends a clause."""
    look = int(limit * 0.2)
    early = f".{{{limit - look},{limit - 1}}}[{K.LOOKBACK_PUNCT}]|" if look else ""
    return F.transform(_all(c, f".{{1,{limit}}}\\z|{early}.{{{limit}}}"), strip)


def split_long(parts: Column, limit: int) -> Column:
    """Cut every sentence longer than ``limit``, by characters or words as its script asks."""
    return F.flatten(F.transform(parts, lambda s: F.when(
        unspaced_cjk(s), split_at_chars(s, limit)).otherwise(split_at_words(s, limit))))


def merge_short(parts: Column, least: int, keep_leading: bool = False) -> Column:
    """Append sentences shorter than ``least`` to the one before; leading short ones vanish."""
    def merge(xs: Column, sep: Column) -> Column:
        def mark(s: Column, i: Column) -> Column:
            opens = F.length(s) >= least
            return F.concat(F.when(opens | (i == 0) if keep_leading else opens, sep).otherwise(F.lit(" ")), s)

        # What stands before the first separator found no sentence to join.
        return F.slice(F.split(F.array_join(F.transform(xs, mark), ""), sep, -1), 2, F.size(xs) + 1)

    return let(parts, lambda xs: F.when(F.size(xs) > 0, with_separator(xs, merge)).when(xs.isNotNull(), _empty()))


def sentence_pipeline(c: Column, longest: int = K.MAX_SENTENCE, least: int = K.MIN_SENTENCE
                      ) -> Column:
    """Sentences ready to be spoken: split, cut, short ones merged, cleaned."""
    parts = merge_short(split_long(sentences(c), longest - least), least)
    return F.transform(parts, clean_speech)


def segments(c: Column, limit: int = K.SEGMENT_CHARS) -> Column:
    """Spoken sentences joined into segments of at most ``limit`` characters."""
    packed = pack(sentence_pipeline(c), limit)
    return F.filter(F.transform(packed, strip), lambda s: F.length(s) > 0)


def _as_bytes(c: Column) -> Column:
    """A text with one character for each byte of ``c``: limits in bytes become limits in characters."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def _from_bytes(c: Column) -> Column:
    return F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")


def _by_unit(unit: Column | str, in_bytes: Callable[[], Column], in_chars: Callable[[], Column]) -> Column:
    if isinstance(unit, str):
        return in_bytes() if unit == "bytes" else in_chars()
    return F.when(unit == "bytes", in_bytes()).otherwise(in_chars())


def split_oversized(c: Column, limit: Column | int, unit: Column | str = "chars") -> Column:
    """Cut a sentence at words so each part fits; a word that alone is too big is cut inside.

    Parts of such a word stand alone. Bytes of one character stay together, even if they pass the limit.
    """
    lim = F.lit(limit) if isinstance(limit, int) else limit
    # From the start of a word to the last end of a word within the limit; else as much of the word as fits.
    whole = ("(?<![^ ])[^ ].{0,", _count(lim - 1), "}(?= |\\z)")
    inside = ("|[^ ]{1,", _count(lim, 1), "}")
    rest = r"[\x80-\xBF]"
    return _by_unit(
        unit, lambda: F.transform(_all(_as_bytes(squeeze(c)), *whole, *inside, f"(?!{rest})|[^ ]{rest}*"), _from_bytes),
        lambda: _all(squeeze(c), *whole, *inside))


def batches(parts: Column, limit: Column | int, unit: Column | str = "chars") -> Column:
    """Request texts within ``limit``: sentences joined by a space, oversized ones cut alone."""
    lim = F.lit(limit) if isinstance(limit, int) else limit

    def groups(xs: Column, sep: Column) -> Column:
        # Every item follows a separator, so empty ones count as well.
        found = _all(F.concat(sep, _join(xs, sep)), sep, ".{0,", _count(lim), "}(?=", sep, "|\\z)|", sep, "[^", sep, "]*")
        return F.transform(found, lambda g: F.replace(F.substring(g, 2, 2 ** 30), sep, F.lit(" ")))

    def cut(xs: Column) -> Column:
        # Bytes stand for characters up to 255, so the separator is free there.
        packed = _by_unit(unit, lambda: F.transform(groups(F.transform(xs, _as_bytes), F.lit(_SEPARATOR)), _from_bytes),
                          lambda: with_separator(xs, groups))
        pieces = F.flatten(F.transform(packed, lambda g: F.when(
            size_in(g, unit) > lim, split_oversized(g, lim, unit)).otherwise(F.array(g))))
        return F.when(F.size(xs) > 0, pieces).when(xs.isNotNull(), _empty())

    return let(parts, cut)


def batch_totals(parts: Column, limit: Column | int, unit: Column | str = "chars") -> Column:
    """(requests, chars) of ``batches``, from sentence lengths; only oversized ones are cut."""
    lim = F.lit(limit) if isinstance(limit, int) else limit
    whole = lambda x: x.cast("bigint")

    def measure(s: Column) -> Column:
        cut = let(split_oversized(s, lim, unit), lambda p: F.struct(
            whole(F.size(p)).alias("n"),
            F.aggregate(p, F.lit(0).cast("bigint"), lambda a, t: a + F.length(t)).alias("c")))
        return F.struct(whole(F.length(s)).alias("c"), whole(size_in(s, unit)).alias("size"),
                        F.when(size_in(s, unit) > lim, cut).alias("cut"))

    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("n"), zero.alias("c"), F.lit(None).cast("bigint").alias("cur"),
                     zero.alias("size"))

    def step(acc: Column, e: Column) -> Column:
        empty = acc["cur"].isNull()
        fits = e["cut"].isNull() & (empty | (acc["size"] + 1 + e["size"] <= lim))
        n = acc["n"] + F.when(empty | fits, 0).otherwise(1)
        c = acc["c"] + F.when(empty | fits, zero).otherwise(acc["cur"])
        grown = fits & ~empty
        return F.struct(
            whole(n + F.coalesce(e["cut"]["n"], zero)).alias("n"),
            whole(c + F.coalesce(e["cut"]["c"], zero)).alias("c"),
            F.when(e["cut"].isNull(), F.when(grown, acc["cur"] + 1 + e["c"]).otherwise(e["c"])).alias("cur"),
            F.when(grown, acc["size"] + 1 + e["size"]).otherwise(e["size"]).alias("size"))

    return F.aggregate(F.transform(parts, measure), start, step, lambda acc: F.struct(
        (acc["n"] + F.when(acc["cur"].isNull(), 0).otherwise(1)).alias("requests"),
        (acc["c"] + F.coalesce(acc["cur"], zero)).alias("chars")))


def chunk_fixed(c: Column, n: int = K.CHUNK_WORDS) -> Column:
    """Consecutive chunks of ``n`` words."""
    def cut(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(n))
                        ).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))

    return let(words(c), cut)


def chunk_paragraphs(c: Column, n: int = K.CHUNK_WORDS, blank_line: str = "\n\n") -> Column:
    """Chunks of at most ``n`` words that end at paragraph ends where possible."""
    paragraphs = F.filter(F.transform(F.split(c, blank_line), squeeze), lambda p: F.length(p) > 0)

    def cut(flats: Column) -> Column:
        # One letter a word, the first of a paragraph marked: chunks are stretches of this shape.
        shape = F.array_join(F.transform(flats, lambda p: F.concat(F.lit("P"), F.repeat(
            F.lit("w"), F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit("")))))), "")
        sizes = F.transform(_all(shape, f"P.{{0,{n - 1}}}(?=P|\\z)|.[^P]{{0,{n - 1}}}"), F.length)
        ends = F.aggregate(sizes, F.array(F.lit(0)), lambda done, k: F.concat(
            done, F.array(F.element_at(done, -1) + k)))
        return let(F.split(F.array_join(flats, " "), " "), lambda ws: F.zip_with(
            sizes, ends, lambda k, start: F.array_join(F.slice(ws, start + 1, k), " ")))

    parts = let(paragraphs, lambda flats: F.when(F.size(flats) > 0, F.filter(
        cut(flats), lambda x: x.isNotNull())).otherwise(F.array(c)))
    return F.when(word_count(c) <= n, F.array(c)).otherwise(parts)


def token_overflow(chunk: Column, num_ctx: int = K.NUM_CTX, num_predict: int = K.NUM_PREDICT
                   ) -> Column:
    """Does a chunk's estimated token count near the room left for input?"""
    return F.length(chunk) / 4 > (num_ctx - num_predict) * 0.9


def shrink(base: Column | int, attempt: Column) -> Column:
    """Batch length for a retry: the base divided by the attempt's number, with a floor."""
    b = F.lit(base) if isinstance(base, int) else base
    return F.greatest(F.floor(b / (attempt + 1)), F.lit(K.MIN_BATCH_CHARS)).cast("bigint")
