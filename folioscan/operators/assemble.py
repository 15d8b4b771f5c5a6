"""Put ordered pieces of text back together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assemble(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, sep: str
             ) -> DataFrame:
    """Join each group's pieces in order: one row per group, whatever its size.

    A value holds up to 2 GB. Where a group may be longer, work on the ordered pieces themselves.
    """
    rows = F.array_sort(F.collect_list(F.struct(*order, text)))
    glued = F.array_join(F.transform(rows, lambda r: r[text]), sep)
    return df.groupBy(*keys).agg(glued.alias(text), F.count(F.lit(1)).alias("n_pieces"))


def split_rows(df: DataFrame, pieces: Column, name: str, *keep: str) -> DataFrame:
    """One row per array element, with its 1-based position."""
    return df.select(*keep, F.posexplode(pieces).alias("_i", name)).select(
        *keep, (F.col("_i") + 1).cast("bigint").alias("pos"), name)
