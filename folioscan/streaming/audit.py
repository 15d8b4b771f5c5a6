"""Incremental audit by content: one current verdict for each document, however often and under whatever name it comes.

Every micro-batch takes the newest text of each document it holds, compares its digest with the one last audited and keeps
what is new as a version. A batch writes its versions in a folder of its own number and lists itself in the manifest
afterwards. A batch that is run again, after a crash or by a lost driver, sees the versions before it alone and overwrites
its own folder, so it leaves the same rows. Versions of a batch the manifest does not list are not read.

The comparison joins ids and digests, never texts. Rows without an id are documents of their own, known by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.quality import text_quality

ARRIVED = "arrived"
VERSION = "known_as string, doc_id long, lang string, source string, reason string, verdict string, digest string"


def stream_documents(spark: SparkSession, path: str, schema, files_per_batch: int = 1000
                     ) -> DataFrame:
    """The files of a table, be it one file or a folder of them, with the time each was written."""
    # Written as a pattern, which may stand for a single file as well.
    rows = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .parquet(f"{path[:-1]}[{path[-1]}]"))
    return rows.select("*", F.col("_metadata.file_modification_time").alias(ARRIVED))


def versions(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """All versions of finished batches, or those before a batch, with the number of their batch."""
    rows = spark.read.schema(f"{VERSION}, batch long").parquet(f"{out}/versions")
    if before is not None:
        return rows.filter(F.col("batch") < before)
    last = spark.read.schema("n long, batch long").parquet(f"{out}/manifest").agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") <= last)


def newest(rows: DataFrame, by: str) -> DataFrame:
    """The latest row of each document; of rows of one time the one with the largest digest."""
    return rows.groupBy("known_as").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "known_as"]), F.struct(
        by, "digest")).alias("r")).select("known_as", "r.*")


def current(spark: SparkSession, out: str) -> DataFrame:
    """The verdict on each document's newest text."""
    return newest(versions(spark, out), "batch")


def save_batch(batch: DataFrame, number: int, out: str) -> None:
    """Audit the documents of a micro-batch whose text is not the one last audited."""
    spark = batch.sparkSession
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    checked = text_quality(batch.withColumn("digest", digest)).select(
        F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), "digest")).alias("known_as"),
        F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "reason", "verdict", "digest", ARRIVED)
    known = newest(versions(spark, out, number).select("known_as", "digest", "batch"), "batch").select(
        "known_as", F.col("digest").alias("last"))
    fresh = newest(checked, ARRIVED).join(known, "known_as", "left").filter(
        F.col("last").isNull() | (F.col("last") != F.col("digest"))).drop("last", ARRIVED)
    fresh.write.mode("overwrite").parquet(f"{out}/versions/batch={number}")
    spark.range(1).select(F.col("id").alias("n")).write.mode("overwrite").parquet(f"{out}/manifest/batch={number}")


def audit_stream(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Audit every document whose text is new, then stop; ``current`` reads the verdicts."""
    spark = docs.sparkSession
    spark.createDataFrame([], VERSION).write.mode("ignore").parquet(f"{out}/versions/batch=-1")
    spark.range(1).select(F.col("id").alias("n")).write.mode("ignore").parquet(f"{out}/manifest/batch=-1")
    return (docs.writeStream.foreachBatch(lambda batch, number: save_batch(batch, number, out))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
