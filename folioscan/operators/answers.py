"""Answers of an external model, kept across runs.

Answers lie in a table bucketed by the digest of their call. A run deals its calls into the same buckets, so looking up what is
known never moves the table; only calls without an answer reach the model. What failed comes back as rows with the class of
the failure and is asked again by the next run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

KEYS = ("prompt", "language")
# Calls handed to the model at once, and how often one that stands alone is tried.
BATCH_CALLS = 64
ATTEMPTS = 3

# Replies in the order of the calls. An exception in a reply's place is the failure of that call alone.
Model = Callable[[pd.DataFrame], Sequence[str | Exception | None]]


class WrongCount(Exception):
    """The model gave more or fewer replies than it got calls."""


class EmptyReply(Exception):
    """The model gave a missing or blank reply."""


@dataclass(frozen=True)
class AnswerStore:
    table: str
    buckets: int


def open_answers(spark: SparkSession, path: str, buckets: int = 64) -> AnswerStore:
    """The answers below ``path``, which may be from earlier sessions; made where there are none.

    The number of buckets belongs to the store: another number opens another one. One run at a time may add to a store.
    """
    place = f"{path.rstrip('/')}/in-{buckets}"
    table = "answers_" + hashlib.sha256(place.encode()).hexdigest()[:24]
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {table} (key string, answer string, run_no bigint) USING parquet
                  CLUSTERED BY (key) INTO {buckets} BUCKETS LOCATION '{place}'""")
    return AnswerStore(table, buckets)


def call_key(keys: Sequence[str] = KEYS) -> Column:
    """Digest of a call; a missing part differs from an empty one."""
    return F.sha2(F.to_json(F.struct(*keys)), 256)


def _dealt(calls: DataFrame, store: AnswerStore, keys: Sequence[str]) -> DataFrame:
    return calls.withColumn("key", call_key(keys)).repartition(store.buckets, "key")


def unanswered(calls: DataFrame, store: AnswerStore, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct calls the store has no answer for, with their ``key``."""
    wanted = _dealt(calls.select(*keys).distinct(), store, keys)
    known = calls.sparkSession.table(store.table).select("key")
    return wanted.join(known.hint("merge"), "key", "left_anti")


def _replies(calls: pd.DataFrame, model: Model, attempts: int) -> list[tuple[str | None, str | None]]:
    """(answer, class of failure) of each call.

    Calls that failed by themselves, or got a blank reply, are tried again together, ``attempts`` times in all. A batch that
    raises is cut in halves until what raises stands alone, so one bad call costs no other its answer. The model is asked at
    most twice for each call and attempt.
    """
    try:
        replies = list(model(calls))
        if len(replies) != len(calls):
            raise WrongCount(f"{len(replies)} replies to {len(calls)} calls")
    except Exception as failure:  # noqa: BLE001 - whatever a model's client raises becomes a row
        if len(calls) > 1:
            half = len(calls) // 2
            return _replies(calls.iloc[:half], model, attempts) + _replies(calls.iloc[half:], model, attempts)
        replies = [failure]
    found: list[tuple[str | None, str | None]] = []
    for reply in replies:
        if isinstance(reply, Exception):
            found.append((None, type(reply).__name__))
        else:
            found.append((reply, None) if (reply or "").strip() else (None, EmptyReply.__name__))
    again = [i for i, (answer, _) in enumerate(found) if answer is None]
    if again and attempts > 1:
        for i, outcome in zip(again, _replies(calls.iloc[again], model, attempts - 1)):
            found[i] = outcome
    return found


def ask(calls: DataFrame, model: Model, keys: Sequence[str] = KEYS, batch: int = BATCH_CALLS,
        attempts: int = ATTEMPTS) -> DataFrame:
    """One row per call: ``key``, ``answer`` or null, ``error_class`` of what failed."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                replies = _replies(part[list(keys)].reset_index(drop=True), model, attempts)
                yield pd.DataFrame({"key": part["key"].to_numpy(), "answer": [a for a, _ in replies],
                                    "error_class": [e for _, e in replies]})

    return calls.select("key", *keys).mapInPandas(run, "key string, answer string, error_class string")


def answer_new(calls: DataFrame, store: AnswerStore, model: Model, run_no: int, keys: Sequence[str] = KEYS,
               batch: int = BATCH_CALLS, attempts: int = ATTEMPTS) -> DataFrame:
    """Answer the calls from the store and, where it has none, by the model; new answers are kept under ``run_no``.

    One row per distinct call: the keys, ``answer``, ``run_no`` of the run that got it, ``error_class`` where this run failed
    to. Replies are written before anything else reads them, so nothing later asks the model again; a task lost while it asks
    repeats its own calls.
    """
    replies = stored(ask(unanswered(calls, store, keys), model, keys, batch, attempts), "replies")
    new = replies.filter("answer is not null").select("key", "answer", F.lit(run_no).cast("bigint").alias("run_no"))
    new.repartition(store.buckets, "key").write.format("parquet").bucketBy(store.buckets, "key").mode(
        "append").saveAsTable(store.table)
    failed = replies.filter("answer is null").select("key", "error_class")
    known = calls.sparkSession.table(store.table)
    return _dealt(calls.select(*keys).distinct(), store, keys).join(known.hint("merge"), "key", "left").join(
        failed, "key", "left").select(*keys, "answer", "run_no", "error_class")
