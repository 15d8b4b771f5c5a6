"""Left join to a side with unique keys when some keys hold very many rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than one row in a thousand, so there are fewer than a thousand
# hot keys whatever the data: that bounds what is broadcast.
HOT_SHARE = 1000
# Below this many rows no key can overload a task.
PLAIN_ROWS = 5_000_000


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], plain_rows: int = PLAIN_ROWS
           ) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row per key.

    Rows of hot keys meet their partner by broadcast and are not shuffled; all others are joined
    by key as usual.
    """
    on = list(keys)
    total = left.count()
    if total <= plain_rows:
        return left.join(right, on, "left")
    hot = F.broadcast(left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") > total / HOT_SHARE).select(*on))
    partners = F.broadcast(right.join(hot, on, "left_semi"))
    return left.join(hot, on, "left_semi").join(partners, on, "left").unionByName(
        left.join(hot, on, "left_anti").join(right, on, "left"))
