"""From raw documents to training sequences: toxicity, near-duplicates, personal data, packing.

Each stage reads all rows its predecessor kept, written as Parquet in between. The first three return the columns of
``documents``: toxic documents are gone, of each group of near-duplicates the document with the smallest id stays, and
personal data is replaced by its kind in brackets (``n_chars`` follows the text). The last returns the sequences.

Rows that share a document id stay or go together; rows without an id stay. Null texts are empty texts. The stages need the
columns doc_id, text and n_chars; others are carried through. An empty table gives no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import binary_packing, pii, setsketch, toxicity
from folioscan.llm.common import stored
from folioscan.llm.queries import table, word_bpe

SCORE = "__toxicity"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it is fitted on the labelled ones among them."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, out=SCORE)
    return scored.filter(F.col(SCORE) < 0.5).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares at least 0.8 of its shingles of five words."""
    copies = setsketch.groups(docs, setsketch.Settings(width=5)).filter(
        F.col("doc_id").isNotNull() & ~F.col("kept")).select("doc_id").distinct()
    return docs.join(stored(copies, "copies").hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose personal data is masked."""
    clean = pii.masked(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences whose lengths are powers of two."""
    return binary_packing.pack(docs, word_bpe, end_id=2)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", dedup_stage),
    ("personal_data", pii_stage),
    ("packing", packing_stage),
]
# Sketches, the fitted models and the tokenizer are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
