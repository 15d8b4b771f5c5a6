"""Does the spoken product still say what the script says?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.text import fixed_digits, let, spoken_words, word_count
from ..functions.words import boundary_words, error_rate, expected_seconds, rate_of, word_errors
from ..session import durable
from .ledger import retry_ledger
from .ordered import Running, ordered


def window(script: Column, hypothesis: Column, side: str) -> Column:
    """(r, h): the matching end of the script and the words heard."""
    return let(spoken_words(script), lambda ref: let(spoken_words(hypothesis), lambda heard: F.struct(
        boundary_words(ref, heard, side).alias("r"), heard.alias("h"))))


def window_errors(df: DataFrame, script: Column, hypothesis: Column, side: str, *keep: str) -> DataFrame:
    """``keep``, wer and the counted word errors of a transcript window against the matching end of the script."""
    rows = df.select(*keep, window(script, hypothesis, side).alias("w"))
    n_ref, n_hyp = F.size("w.r").cast("bigint"), F.size("w.h").cast("bigint")
    rows = rows.select(*keep, n_ref.alias("ref_words"), n_hyp.alias("hyp_words"),
                       word_errors(F.col("w.r"), F.col("w.h")).alias("e"))
    return rows.select(*keep, rate_of(F.col("e.distance"), F.col("ref_words"), F.col("hyp_words")).alias("wer"),
                       "ref_words", "hyp_words", "e.*")


def fidelity_check(df: DataFrame, wer_max: float = K.WER_MAX,
                   ratio_min: float = K.FIDELITY_RATIO_MIN) -> DataFrame:
    """Judge episodes (script, head_hyp, tail_hyp, duration_s): suspect or not, and why.

    Audio without a duration fails both windows. An empty transcript matches an empty span and
    so scores 0; ``empty_transcript`` tells these apart.
    """
    dead = F.col("duration_s") <= 0
    spans = {side: window(F.col("script"), F.col(f"{side}_hyp"), side) for side in ("head", "tail")}
    out = df.withColumns({f"_{side}": w for side, w in spans.items()}).withColumns({
        **{f"{side}_wer": F.when(dead, 1.0).otherwise(error_rate(F.col(f"_{side}.r"), F.col(f"_{side}.h")))
           for side in spans},
        "ratio": F.col("duration_s") / expected_seconds(word_count(F.col("script"))),
        "empty_transcript": (F.size("_head.h") == 0) | (F.size("_tail.h") == 0),
    }).drop("_head", "_tail")
    head, tail = F.col("head_wer") > wer_max, F.col("tail_wer") > wer_max
    slow = F.col("ratio") < ratio_min
    why = F.concat_ws(
        ", ",
        F.when(head, F.concat(F.lit("head WER "), fixed_digits(F.col("head_wer")))),
        F.when(tail, F.concat(F.lit("tail WER "), fixed_digits(F.col("tail_wer")))),
        F.when(slow, F.concat(F.lit("duration ratio "), fixed_digits(F.col("ratio")))))
    return out.withColumns({
        "suspect": head | tail | slow,
        "reason": F.when(head | tail | slow, why).otherwise("below thresholds")})


def window_bounds(duration: Column, window: float = K.WINDOW_S) -> dict[str, Column]:
    """Start and end seconds of the head and tail windows."""
    w = F.lit(window)
    return {"head_start": F.lit(0.0), "head_end": F.least(w, duration),
            "tail_start": F.greatest(duration - w, F.lit(0.0)), "tail_end": duration}


def fidelity_ledger(attempts: DataFrame, keys: Sequence[str], order: Sequence[str], wer_max: float = K.WER_MAX,
                    ratio_min: float = K.FIDELITY_RATIO_MIN, budget: int = K.BUDGET) -> DataFrame:
    """The last retry cycle end to end: every attempt checked, what it did to the budget, and whose recording stands.

    ``attempts`` are as in ``fidelity_check`` and follow each other by ``order`` within ``keys``. An attempt that passes stands
    itself. While retries are left none stands; once they are spent it is the best so far, the earliest of equal ones.
    ``flag`` says why the attempt raised one.
    """
    head, tail = F.col("head_wer"), F.col("tail_wer")
    checked = fidelity_check(attempts, wer_max, ratio_min).select(
        *keys, *order, F.lit(K.CYCLES[2]).alias("cycle"), F.greatest(head, tail).alias("wer"), F.col("suspect").alias("failed"))
    ledger = retry_ledger(checked, [*keys, "cycle"], order, budget)
    best = F.struct("wer", F.struct(*order).alias("at"))
    rows = ordered(durable(ledger), list(keys), list(order)).running(Running("best", "min", best)).result()
    limit = fixed_digits(F.lit(float(wer_max)))
    flag = F.when(F.col("action") == "resolved", F.concat(
        F.lit("WER "), fixed_digits(F.col("wer")), F.lit(" within "), limit, F.lit(" after re-chunk"))).when(
        F.col("action") == "exhausted", F.concat(F.lit("WER "), fixed_digits(F.col("best.wer")), F.lit(" exceeds "), limit,
                                                 F.lit(f" after {budget} attempts")))
    stands = F.when(~F.col("failed"), F.struct(*order)).when(F.col("action") != "retry", F.col("best.at"))
    return rows.select(*keys, *order, "attempt_no", "failed", "wer", "action", "remaining", flag.alias("flag"),
                       *[stands[c].alias(f"kept_{c}") for c in order])
