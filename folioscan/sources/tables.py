"""Views of the given tables in the shapes the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as X


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of few files. Inputs with more splits than cores stay put."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    """One row per chapter: book, document, language, whole text."""
    return spread(read(spark, folder, "documents").select(
        F.col("source").alias("book_id"), "doc_id", "lang", "text"))


def chapter_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Narrow chapter rows: title, words and characters, without the text."""
    docs = spread(read(spark, folder, "documents").select(
        "source", "doc_id", "lang", "text", "n_chars"))
    return docs.select(
        F.col("source").alias("book_id"), "doc_id", "lang",
        X.first_sentence_title(F.col("text")).alias("title"),
        X.word_count(F.col("text")).alias("n_words"),
        F.col("n_chars"))


def produced(spark: SparkSession, folder: str, facts: DataFrame) -> DataFrame:
    """Chapters with a label count as produced; toxic ones got another title on the way."""
    labels = read(spark, folder, "labels").select("doc_id", "quality", "toxic")
    return facts.join(labels, "doc_id").select(
        "book_id", "doc_id", "quality",
        F.when(F.col("toxic") == 1, F.concat(F.lit("Bonus "), "title")).otherwise(
            F.col("title")).alias("title"),
        F.when(F.col("quality") == 1, F.col("n_chars") / 4).otherwise(
            F.col("n_chars") / 16).alias("duration_s"))


def spine_items(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as spine items: ten consecutive pages make a book, the url path is the item name."""
    pages = spread(read(spark, folder, "pages").select("page_id", "url", "html"))
    return pages.select(
        F.floor(F.col("page_id") / 10).cast("bigint").alias("book_id"),
        F.col("page_id").alias("ordinal"),
        F.lower(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)).alias("item_name"),
        "html")


def toc(spark: SparkSession, folder: str) -> DataFrame:
    """Links of the tables of contents: every third page is a chapter start."""
    return read(spark, folder, "pages").filter("page_id % 3 = 0").select(
        F.floor(F.col("page_id") / 10).cast("bigint").alias("book_id"),
        F.concat(F.lit("./"), F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1),
                 F.lit("#start")).alias("href"))


def nested_toc(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of tables of contents in four levels; the first and the seventh of a book are sections without a page."""
    k = F.col("page_id") % 10
    parent = F.when(k.isin(1, 4), 0).when(k == 2, 1).when(k == 3, 2).when(k.isin(6, 8), 5).when(k == 7, 6)
    link = F.concat(F.lit("./"), F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), F.lit("#part"))
    return read(spark, folder, "pages").select(
        F.floor(F.col("page_id") / 10).cast("bigint").alias("book_id"), F.col("page_id").alias("entry_no"),
        (F.col("page_id") - k + parent).alias("parent_no"), (k * 7 % 10).alias("place"),
        F.concat(F.lit("Part "), k.cast("string")).alias("title"), F.when(~k.isin(0, 6), link).alias("href"))


def turns(spark: SparkSession, folder: str, role: str | None = None) -> DataFrame:
    df = read(spark, folder, "conversations")
    return df.filter(F.col("role") == role) if role else df


def scripts(spark: SparkSession, folder: str) -> DataFrame:
    """Narration scripts: what the assistant says in each turn."""
    return turns(spark, folder, "assistant").select(
        F.col("conv_id").alias("book_id"), F.col("turn").alias("episode_no"),
        F.col("text").alias("script"))


def turn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn with the one that follows it in its conversation."""
    df = turns(spark, folder)
    after = df.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return df.select("conv_id", "turn", F.col("text").alias("ref")).join(
        after, ["conv_id", "turn"])


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as attempts at a chapter, one retry cycle each."""
    cycle = F.element_at(F.array(*map(F.lit, K.CYCLES)), (F.col("event_id") % 3 + 1).cast("int"))
    return read(spark, folder, "events").select(
        F.floor(F.col("user_id") / 10).cast("bigint").alias("book_id"),
        F.col("user_id").alias("chapter_id"), cycle.alias("cycle"), "ts", "event_id",
        (F.col("event_type") == "error").alias("failed"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("wer"))


def episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as episodes of a supplier's book, in order of key and line."""
    return read(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("book_id"), "l_orderkey", "l_linenumber",
        F.col("l_extendedprice").alias("duration_s"))


def output_files(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as produced files: a folder per customer, parts and single files in it."""
    return read(spark, folder, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("dir"),
        F.when(F.col("o_orderstatus") == "P",
               F.concat(F.lit("track_"), F.col("o_orderkey"), F.lit(".mp3")))
        .when(F.col("o_orderstatus") == "F",
              F.concat(F.lit("Book_part"), F.col("o_orderkey"), F.lit(".m4b")))
        .otherwise(F.concat(F.lit("audiobook"), F.element_at(
            F.array(F.lit(".m4b"), F.lit(".mp3"), F.lit(".wav")),
            (F.col("o_orderkey") % 3 + 1).cast("int")))).alias("name"))


def providers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.PROVIDERS, "provider string, max_len int, unit string")


def tasks(spark: SparkSession) -> DataFrame:
    """Task dimension; register a task by appending a row."""
    rows = [(n, r, "" if n == "direct" else f"builtin:{n}", p, "single") for n, r, p in K.TASKS]
    return spark.createDataFrame(
        rows, "task string, requires_llm boolean, prompt string, "
              "llm_params map<string,double>, output_structure string")


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.LANGUAGES, "code string, name string")
