"""Running values along an order, for groups of any size.

A window puts a whole group into one task. That is the cheapest way for groups a task can hold, but
one book may hold a third of all rows. So group sizes are counted first. Groups above
``spark.folioscan.hotRows`` rows (two million unless set) are range-partitioned by (group, order)
and so spread over many blocks: values run inside each block, and each block gets the total of the
blocks before it. Only blocks that continue a group begun earlier need such an offset, and a block
can continue just one group: the offsets have at most one row per partition, which is what makes
broadcasting them safe. All other groups take the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

BLOCK = "_block"
HOT_ROWS = 2_000_000
_WHOLE = "_whole"


@dataclass(frozen=True)
class Running:
    """One running value: ``count``, ``sum``, ``max`` or ``min`` of ``value``.

    ``before`` leaves the current row out, so the value describes the rows ahead of it.
    """

    name: str
    kind: str
    value: Column | None = None
    before: bool = False

    def aggregate(self) -> Column:
        if self.kind == "count":
            return F.count(F.lit(1))
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](self.value)

    def over(self, keys: Sequence[str], order: Sequence[Column]) -> Column:
        rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, -1 if self.before else Window.currentRow)
        value = self.aggregate().over(rows)
        return F.coalesce(value, F.lit(0)) if self.kind in ("count", "sum") else value

    def after(self, offset: Column, local: Column) -> Column:
        """The value, given the same value over all blocks before."""
        if self.kind in ("count", "sum"):
            return F.coalesce(offset, F.lit(0)) + local
        return (F.greatest if self.kind == "max" else F.least)(offset, local)


@dataclass(frozen=True)
class Ordered:
    """Rows with an order inside groups: ordinary groups as they are, hot ones cut into blocks."""

    plain: DataFrame
    blocks: DataFrame | None
    keys: tuple[str, ...]
    order: tuple[Column, ...]

    def running(self, *values: Running) -> Ordered:
        """Add running values; groups and blocks stay, so calls can follow one another."""
        plain = self.plain.select("*", *[
            v.over(self.keys, self.order).alias(v.name) for v in values])
        if self.blocks is None:
            return replace(self, plain=plain)
        local = self.blocks.select("*", *[
            v.over((*self.keys, BLOCK), self.order).alias(v.name) for v in values])
        offsets = self._offsets(values)
        on = F.col(BLOCK) == F.col("_k_block")
        for k in self.keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        kept = [F.col(c) for c in self.blocks.columns]
        blocks = local.join(F.broadcast(offsets), on, "left").select(*kept, *[
            v.after(F.col(f"_o_{v.name}"), F.col(v.name)).alias(v.name) for v in values])
        return replace(self, plain=plain, blocks=blocks)

    def _offsets(self, values: Sequence[Running]) -> DataFrame:
        """Values over all earlier blocks of the group, for blocks that have any."""
        totals = self.blocks.groupBy(*self.keys, BLOCK).agg(
            *[v.aggregate().alias(f"_t_{v.name}") for v in values])
        earlier = Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(
            Window.unboundedPreceding, -1)
        fold = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}
        return totals.select(
            *[F.col(k).alias(f"_k_{k}") for k in self.keys],
            F.col(BLOCK).alias("_k_block"),
            F.count(F.lit(1)).over(earlier).alias("_ahead"),
            *[fold[v.kind](f"_t_{v.name}").over(earlier).alias(f"_o_{v.name}") for v in values],
        ).filter("_ahead > 0").drop("_ahead")

    def rows(self) -> DataFrame:
        """All rows; those of ordinary groups form block 0."""
        plain = self.plain.withColumn(BLOCK, F.lit(0))
        return plain if self.blocks is None else plain.unionByName(self.blocks)

    def result(self) -> DataFrame:
        return self.rows().drop(BLOCK, _WHOLE)


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> Ordered:
    """Prepare ``df`` for running values; ``order`` must be a total order inside each group.

    Pass narrow rows. The input is read to count group sizes and again for the values; pass a
    durable frame where it is more than a scan.
    """
    spark = df.sparkSession
    order_cols = tuple(F.col(c) if isinstance(c, str) else c for c in order)
    if not keys:
        df, keys = df.withColumn(_WHOLE, F.lit(0)), (_WHOLE,)
    limit = int(spark.conf.get("spark.folioscan.hotRows", str(HOT_ROWS)))
    # Fewer than (rows / limit) keys can be hot, so this list stays short.
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") > limit).select(*keys)
    hot_keys = found.collect()
    if not hot_keys:
        return Ordered(df, None, tuple(keys), order_cols)
    hot = F.broadcast(spark.createDataFrame(hot_keys, found.schema).toDF(
        *[f"_h_{k}" for k in keys]))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    ranged = df.join(hot, on, "left_semi").repartitionByRange(
        *[F.col(k) for k in keys], *order_cols)
    # Written durably: a stage that runs again must see the same block numbers.
    blocks = durable(ranged.withColumn(BLOCK, F.spark_partition_id()))
    return Ordered(df.join(hot, on, "left_anti"), blocks, tuple(keys), order_cols)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
             name: str, start: int = 1) -> DataFrame:
    """Consecutive numbers along the order, per group or over all rows."""
    out = ordered(df, keys, order).running(Running(name, "count")).result()
    return out.withColumn(name, (F.col(name) + (start - 1)).cast("bigint"))
