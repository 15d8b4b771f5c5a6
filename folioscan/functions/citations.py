"""Citations, notes, links and reference lists in plain or marked-up text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as K
from .html import tagless
from .text import squeeze

# A list of note numbers, written without a repeated group: Java matches those by recursion, and a
# very long list would exhaust the stack.
_NOTES = r"\[(?=\d)(?![\d,\-\s]*[,\-\s]{2})[\d,\-\s]*\d\]"
_CITATIONS = {**K.CITATIONS, "footnote": _NOTES}


def without_markup(c: Column) -> Column:
    """Text of a fragment that still carries tags, references decoded; untouched when it has none."""
    return F.when(c.rlike("<[^>]+>"), tagless(c)).otherwise(c)


def clean_citations(c: Column) -> Column:
    """Remove notes, citations, links and captions; mark where a reference list starts."""
    c = without_markup(c)
    for pattern in _CITATIONS.values():
        c = F.regexp_replace(c, f"(?U){pattern}", "")
    for head in K.REFERENCE_HEADS:
        c = F.regexp_replace(c, rf"(?isUd)\n{head}{K.REFERENCE_TAIL}", K.REFERENCE_MARK)
    return squeeze(F.regexp_replace(c, f"(?miUd){K.CAPTION}", ""))


def citation_counts(c: Column) -> dict[str, Column]:
    return {name: F.regexp_count(c, F.lit(f"(?U){p}")).cast("bigint")
            for name, p in _CITATIONS.items()}
