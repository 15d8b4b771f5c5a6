"""Retry ledger over a stream of attempts: the state of a chapter is its budget and best rate.

A micro-batch runs as one job over all its chapters. What a chapter used before stands ahead of its attempts as one row of the
state, and values run on from there. The ledger rows of a batch and the state it leaves lie in folders of its number; a batch
that is run again sees the state of the batch before it and overwrites its own folders, so it leaves the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed as K
from ..operators.ledger import ATTEMPT_KEYS
from ..operators.ordered import Running, ordered
from ..session import fresh_path

OUTPUT = (
    "book_id long, chapter_id long, cycle string, ts timestamp, event_id long, attempt_no long, "
    "failed boolean, wer double, attempts_used long, remaining long, action string, "
    "best_wer double")
# Rows of a backlog one run of the stream should take.
SLICE_ROWS = 5_000_000
STATE = "book_id long, chapter_id long, cycle string, attempts long, failures long, passed long, best double"


def save_batch(batch: DataFrame, number: int, out: str) -> None:
    """What the attempts of a micro-batch did, in time order after those before it, and the state they leave."""
    spark = batch.sparkSession
    states = spark.read.schema(f"{STATE}, batch long").parquet(f"{out}/_state").filter(F.col("batch") < number)
    state = states.filter(F.col("batch") == states.agg(F.max("batch")).first()[0]).drop("batch")
    # A missing rate is passed over, as in the batch ledger; an attempt of unknown outcome did not fail.
    new = batch.select(
        *ATTEMPT_KEYS, F.lit(True).alias("new"), "ts", "event_id", F.coalesce("failed", F.lit(False)).alias("failed"),
        F.nanvl("wer", F.lit(None).cast("double")).alias("wer"), F.lit(1).cast("long").alias("attempts"),
        F.coalesce("failed", F.lit(False)).cast("long").alias("failures"), F.lit(0).cast("long").alias("passed"))
    old = state.withColumnRenamed("best", "wer").withColumn("new", F.lit(False))
    failed, before, earlier = F.col("failed"), F.col("after") - F.col("failures"), F.col("passes_before")
    good_again = F.col("new") & ~failed & (before > 0)
    order = [F.col("new"), F.col("ts").asc_nulls_last(), F.col("event_id").asc_nulls_last()]
    run = ordered(new.unionByName(old, allowMissingColumns=True), ATTEMPT_KEYS, order).running(
        Running("attempt_no", "sum", F.col("attempts")), Running("after", "sum", F.col("failures")),
        Running("best_wer", "min", F.col("wer"))).running(
        Running("passes_before", "sum", F.when(F.col("new"), good_again.cast("long")).otherwise(F.col("passed")), before=True))
    resolved = good_again & (~F.col("cycle").eqNullSafe(K.CYCLES[2]) | ((before <= K.BUDGET) & (earlier == 0)))
    action = (F.when(failed & (before < K.BUDGET), "retry").when(failed & (before == K.BUDGET), "exhausted")
              .when(failed, "beyond_budget").when(resolved, "resolved").otherwise("pass"))
    used = F.least("after", F.lit(K.BUDGET).cast("long"))
    folder = f"{out}/batch={number}"
    run.result().filter("new").select(
        *ATTEMPT_KEYS, "ts", "event_id", "attempt_no", "failed", "wer", used.alias("attempts_used"),
        (K.BUDGET - used).alias("remaining"), action.alias("action"), "best_wer").write.mode("overwrite").parquet(folder)
    # A pass after a failure is one where some of the budget is used.
    left = spark.read.schema(OUTPUT).parquet(folder).select(
        *ATTEMPT_KEYS, F.lit(1).alias("attempts"), failed.cast("long").alias("failures"),
        (~failed & (F.col("attempts_used") > 0)).cast("long").alias("passed"), F.col("wer").alias("best"))
    state.unionByName(left).groupBy(*ATTEMPT_KEYS).agg(
        *[F.sum(c).alias(c) for c in ("attempts", "failures", "passed")], F.min("best").alias("best")).write.mode(
        "overwrite").parquet(f"{out}/_state/batch={number}")


def ledger_stream(attempts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what every new attempt did. Files must arrive in time order."""
    spark = attempts.sparkSession
    spark.createDataFrame([], OUTPUT).write.mode("ignore").parquet(f"{out}/batch=-1")
    spark.createDataFrame([], STATE).write.mode("ignore").parquet(f"{out}/_state/batch=-1")
    return (attempts.writeStream.foreachBatch(lambda batch, number: save_batch(batch, number, out))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def time_slices(df: DataFrame, ts: str, rows: int = SLICE_ROWS, least: int = 2
                ) -> Iterator[DataFrame]:
    """Consecutive time ranges of a backlog, about ``rows`` rows each.

    A run of the stream holds a chapter's rows of one slice in memory; slices bound that. The
    backlog is dealt into slices once; each is then read from its own files.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "slices")
    n = max(least, math.ceil(df.count() / rows))
    df.repartitionByRange(n, ts).withColumn("_slice", F.spark_partition_id()).write.partitionBy(
        "_slice").parquet(path)
    staged = spark.read.schema(T.StructType(
        [*df.schema.fields, T.StructField("_slice", T.IntegerType())])).parquet(path)
    for i in range(n):
        yield staged.filter(F.col("_slice") == i).drop("_slice")
