"""Retries, verdicts, judge replies and transcript fidelity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import segment as G
from ..functions import text as X
from ..functions import words as W
from ..functions.text import spoken_words
from ..operators import fidelity as Fi
from ..operators import ledger as L
from ..operators.ordered import Running, numbered, ordered
from ..operators.skew import lookup
from ..sources import tables as V
from . import sql as S
from .book_queries import _SCRIPTS, numbered_scripts
from .registry import query

_CYCLE = ("list_extract([" + ", ".join(f"'{c}'" for c in K.CYCLES)
          + "], CAST(event_id % 3 AS INT) + 1)")
_ATT = f"""
    att AS (SELECT user_id // 10 AS book_id, user_id AS chapter_id, {_CYCLE} AS cycle, ts, event_id,
        event_type = 'error' AS failed, least(value / 500, 1.0) AS wer FROM events)"""
_LEDGER = f"""{_ATT},
    l1 AS (SELECT *, row_number() OVER w AS attempt_no,
        CAST(sum(CAST(failed AS INT)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT)
          - CAST(failed AS INT) AS fb,
        min(wer) OVER (w ROWS UNBOUNDED PRECEDING) AS best_wer FROM att
        WINDOW w AS (PARTITION BY book_id, chapter_id, cycle ORDER BY ts, event_id)),
    l2 AS (SELECT *, NOT failed AND fb > 0 AS again, coalesce(CAST(sum(CAST(NOT failed AND fb > 0
        AS INT)) OVER (PARTITION BY book_id, chapter_id, cycle ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS pb FROM l1),
    led AS (SELECT book_id, chapter_id, cycle, ts, event_id, attempt_no, failed, wer, best_wer,
        CAST(least(fb + CAST(failed AS INT), 3) AS BIGINT) AS attempts_used,
        CAST(3 - least(fb + CAST(failed AS INT), 3) AS BIGINT) AS remaining,
        CASE WHEN failed AND fb < 3 THEN 'retry' WHEN failed AND fb = 3 THEN 'exhausted'
          WHEN failed THEN 'beyond_budget'
          WHEN again AND (cycle <> 'cycle_3_retry' OR (fb <= 3 AND pb = 0)) THEN 'resolved'
          ELSE 'pass' END AS action FROM l2)"""
_CYC = f"""{_LEDGER},
    cyc AS (SELECT book_id, chapter_id, cycle, max(attempts_used) AS attempts_used,
        count(*) FILTER (WHERE action = 'exhausted') AS exhausted,
        count(*) FILTER (WHERE action = 'resolved') AS resolved, min(best_wer) AS best_wer
        FROM led GROUP BY 1, 2, 3)"""
_VER = f"""{_CYC},
    ver AS (SELECT book_id, chapter_id, CAST(sum(exhausted + resolved) AS BIGINT) AS n_flags,
        CAST(sum(exhausted) AS BIGINT) AS n_exhausted,
        min(best_wer) FILTER (WHERE cycle = 'cycle_3_retry') AS best_wer,
        CASE WHEN sum(exhausted) > 0 THEN 'unrecoverable'
          WHEN sum(exhausted + resolved) > 0 THEN 'flagged' ELSE 'clean' END AS verdict
        FROM cyc GROUP BY 1, 2)"""
LEDGER_SQL = f"""
    WITH {_LEDGER} SELECT book_id, chapter_id, cycle, event_id, attempt_no, failed, wer,
      attempts_used, remaining, action, best_wer FROM led"""
LEDGER_COLUMNS = ["book_id", "chapter_id", "cycle", "event_id", "attempt_no", "failed", "wer",
                  "attempts_used", "remaining", "action", "best_wer"]


def _ledger(spark, d):
    return L.retry_ledger(V.attempts(spark, d))


def _cycles(spark, d):
    return L.cycle_summary(_ledger(spark, d))


@query("retry_ledger", LEDGER_SQL)
def retry_ledger(spark, d):
    return _ledger(spark, d).select(*LEDGER_COLUMNS)


@query("best_so_far", f"""
    WITH {_LEDGER} SELECT chapter_id, cycle, event_id, best_wer FROM led""")
def best_so_far(spark, d):
    run = ordered(V.attempts(spark, d), L.ATTEMPT_KEYS, L.ATTEMPT_ORDER).running(
        Running("best_wer", "min", F.col("wer"))).result()
    return run.select("chapter_id", "cycle", "event_id", "best_wer")


@query("best_attempt", f"""
    WITH {_ATT} SELECT book_id, chapter_id, best.wer AS best_wer, best.event_id AS best_event
    FROM (SELECT book_id, chapter_id, min({{'wer': wer, 'ts': ts, 'event_id': event_id}}) AS best
          FROM att GROUP BY 1, 2)""")
def best_attempt(spark, d):
    return L.best_attempt(V.attempts(spark, d), "book_id", "chapter_id")


@query("attempts_used", f"""
    WITH {_CYC} SELECT book_id, chapter_id, cycle, attempts_used FROM cyc
    WHERE attempts_used > 0 OR exhausted > 0 OR resolved > 0""")
def attempts_used(spark, d):
    cycles = _cycles(spark, d)
    return cycles.filter("attempts_used > 0 or exhausted > 0 or resolved > 0").select(
        "book_id", "chapter_id", "cycle", "attempts_used")


@query("fired_cycles", f"""
    WITH {_CYC} SELECT book_id, chapter_id, cycle FROM cyc WHERE attempts_used > 0
    UNION SELECT book_id, chapter_id, cycle FROM cyc WHERE exhausted > 0 OR resolved > 0""")
def fired_cycles(spark, d):
    return L.fired(_cycles(spark, d))


@query("chapter_verdict", f"WITH {_VER} SELECT * FROM ver")
def chapter_verdict(spark, d):
    return L.chapter_verdicts(_cycles(spark, d))


@query("verdict_counts", f"""
    WITH {_VER} SELECT book_id, count(*) FILTER (WHERE verdict = 'clean') AS clean,
      count(*) FILTER (WHERE verdict = 'flagged') AS flagged,
      count(*) FILTER (WHERE verdict = 'unrecoverable') AS unrecoverable FROM ver GROUP BY 1""")
def verdict_counts(spark, d):
    return L.verdict_counts(L.chapter_verdicts(_cycles(spark, d)), "book_id")


@query("pipeline_status", """
    WITH c AS (SELECT source AS book_id, lang, count(*) AS expected, count(l.doc_id) AS produced
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2)
    SELECT *, CASE WHEN expected = 0 THEN 'no_chapters' WHEN produced = expected THEN 'complete'
      WHEN produced = 0 THEN 'failed' ELSE 'partial' END AS status FROM c""")
def pipeline_status(spark, d):
    docs = V.read(spark, d, "documents").select(
        F.col("source").alias("book_id"), "lang", "doc_id")
    labels = V.read(spark, d, "labels").select("doc_id", F.lit(1).alias("has"))
    return docs.join(labels, "doc_id", "left").groupBy("book_id", "lang").agg(
        F.count(F.lit(1)).alias("expected"), F.count("has").alias("produced")
    ).withColumn("status", L.pipeline_status(F.col("expected"), F.col("produced")))


_FLAGS = f"""{_VER},
    flg AS (SELECT book_id, chapter_id, cycle, ts, event_id, action = 'exhausted' AS gone,
        CASE WHEN cycle = 'cycle_3_retry' THEN 'WER ' || {S.fixed2('wer')}
          WHEN action = 'exhausted' THEN 'verdict garbage' ELSE 'verdict clean' END AS reason
        FROM led WHERE action IN ('exhausted', 'resolved'))"""
_REPORT = f"""{_FLAGS},
    used AS (SELECT book_id, chapter_id, string_agg('"' || cycle || '":' || attempts_used, ','
        ORDER BY cycle) AS used FROM cyc
        WHERE attempts_used > 0 OR exhausted > 0 OR resolved > 0 GROUP BY 1, 2),
    listed AS (SELECT book_id, chapter_id, string_agg('{{"cycle":"' || cycle || '","reason":"' ||
        reason || '","exhausted":' || gone || '}}', ',' ORDER BY cycle, ts, event_id) AS flags
        FROM flg GROUP BY 1, 2),
    rows AS (SELECT book_id, chapter_id, 'chapter_' || chapter_id AS entry,
        '{{"title":"Chapter ' || chapter_id || '","verdict":"' || verdict || '","attempts_used":{{'
        || coalesce(used, '') || '}},"best_wer":' || coalesce(CAST(CAST(
          {S.half_up('best_wer', 4)} AS DECIMAL(6, 4)) AS VARCHAR), 'null') || ',"flags":[' ||
        coalesce(flags, '') || ']}}' AS report
      FROM ver LEFT JOIN used USING (book_id, chapter_id) LEFT JOIN listed USING (book_id, chapter_id)
      UNION ALL SELECT book_id, NULL, 'summary', '{{"pipeline_status":"' ||
        CASE WHEN count(best_wer) = count(*) THEN 'complete' WHEN count(best_wer) = 0 THEN 'failed'
          ELSE 'partial' END || '","episodes_synthesised":' || count(best_wer) ||
        ',"chapters_expected":' || count(*) ||
        ',"verdict_counts":{{"clean":' || count(*) FILTER (WHERE verdict = 'clean') ||
        ',"flagged":' || count(*) FILTER (WHERE verdict = 'flagged') ||
        ',"unrecoverable":' || count(*) FILTER (WHERE verdict = 'unrecoverable') || '}}}}'
      FROM ver GROUP BY book_id)"""


@query("flag_entries", f"""
    WITH {_FLAGS} SELECT book_id, chapter_id, cycle, event_id, reason, gone AS exhausted FROM flg""")
def flag_entries(spark, d):
    return L.flag_entries(_ledger(spark, d)).drop("ts")


def _per_chapter(spark, d):
    ledger = _ledger(spark, d)
    return L.per_chapter(L.cycle_summary(ledger), L.flag_entries(ledger))


@query("flag_details", f"""
    WITH {_FLAGS},
    lines AS (SELECT f.book_id, f.chapter_id, string_agg(cycle || ' (' || CASE WHEN gone
        THEN attempts_used || '/3 attempts exhausted' ELSE 'resolved' END ||
        CASE WHEN cycle = 'cycle_3_retry' THEN ', best WER ' || {S.fixed2('v.best_wer')} ELSE '' END
        || ') — ' || reason, '; ' ORDER BY cycle, ts, event_id) AS details
      FROM flg f JOIN cyc USING (book_id, chapter_id, cycle) JOIN ver v USING (book_id, chapter_id)
      GROUP BY 1, 2)
    SELECT book_id, chapter_id, verdict, coalesce(details, '') AS details
    FROM ver LEFT JOIN lines USING (book_id, chapter_id)""")
def flag_details(spark, d):
    # A chapter with more flags than a row holds goes on in rows that begin with their number.
    mark = F.when(F.col("part") > 1, F.concat(F.lit("(part "), "part", F.lit(") "))).otherwise("")
    return _per_chapter(spark, d).select("book_id", "chapter_id", "verdict", F.concat(mark, L.flag_details(
        F.col("flags"), F.col("cycles"), F.col("best_wer"))).alias("details"))


def _report(spark, d):
    # An episode exists where the last cycle ran.
    return L.quality_report(_per_chapter(spark, d), F.concat(
        F.lit("Chapter "), F.col("chapter_id").cast("string")), F.col("best_wer").isNotNull())


@query("quality_report_json", f"WITH {_REPORT} SELECT book_id, entry, report FROM rows")
def quality_report_json(spark, d):
    return _report(spark, d).select("book_id", "entry", "report")


@query("quality_report_documents", f"""
    WITH {_REPORT} SELECT book_id, rtrim(max(report) FILTER (WHERE entry = 'summary'), '}}') ||
      '}},"chapters":{{' || string_agg('"' || entry || '":' || report, ',' ORDER BY chapter_id)
      FILTER (WHERE entry <> 'summary') || '}}}}' AS report FROM rows GROUP BY book_id""")
def quality_report_documents(spark, d):
    return L.report_documents(_report(spark, d))


@query("failure_gate", """
    SELECT user_id AS chapter_id, count(*) AS attempted,
      count(*) FILTER (WHERE event_type = 'error') AS failed_count,
      count(*) FILTER (WHERE event_type = 'error') / count(*) AS failure_rate,
      count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.05 AS aborts
    FROM events GROUP BY 1""")
def failure_gate(spark, d):
    return L.failure_gate(V.attempts(spark, d), "chapter_id")


@query("failure_streaks", """
    WITH a AS (SELECT user_id AS chapter_id, event_id, event_type <> 'view' AS failed,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    b AS (SELECT *, n - 1 - coalesce(max(CASE WHEN NOT failed THEN n END) OVER (
        PARTITION BY chapter_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS streak_before FROM a)
    SELECT chapter_id, event_id, streak_before,
      streak_before > 0 AND streak_before % 5 = 0 AS pauses FROM b""")
def failure_streaks(spark, d):
    # Only a view counts as success here, so that runs of failures do occur.
    rows = V.read(spark, d, "events").select(
        F.col("user_id").alias("chapter_id"), "ts", "event_id",
        (F.col("event_type") != "view").alias("failed"))
    return L.failure_streaks(rows, ["chapter_id"], ["ts", "event_id"]).select(
        "chapter_id", "event_id", "streak_before", "pauses")


@query("rechunk_schedule", f"""
    WITH {_CYC}, u AS (SELECT chapter_id, cycle, attempts_used,
        unnest(range(1, attempts_used + 1)) AS attempt FROM cyc WHERE attempts_used > 0)
    SELECT chapter_id, cycle, attempt, CAST(greatest(4000 // (attempt + 1), 200) AS BIGINT)
      AS max_chars FROM u""")
def rechunk_schedule(spark, d):
    spent = _cycles(spark, d).filter("attempts_used > 0")
    return spent.select("chapter_id", "cycle", F.explode(
        F.sequence(F.lit(1).cast("bigint"), "attempts_used")).alias("attempt")).withColumn(
        "max_chars", G.shrink(4000, F.col("attempt")))


# --- judge ------------------------------------------------------------------------------------

_JUDGE = f"""CASE conv_id % 5
    WHEN 0 THEN '```json' || chr(10) || '{{"verdict": "reroute", "reason": "words ' ||
      {S.n_words('text')} || '"}}' || chr(10) || '```'
    WHEN 1 THEN ' {{"verdict":"borderline","reason":"turn ' || turn || '"}} '
    WHEN 2 THEN '{{"verdict":"maybe","reason":"unknown"}}'
    WHEN 3 THEN 'I think: ' || text ELSE '{{"verdict":"pass"}}' END"""


def _reply():
    c = F.col("conv_id") % 5
    return (F.when(c == 0, F.concat(
        F.lit('```json\n{"verdict": "reroute", "reason": "words '),
        X.word_count(F.col("text")).cast("string"), F.lit('"}\n```')))
        .when(c == 1, F.concat(F.lit(' {"verdict":"borderline","reason":"turn '),
                               F.col("turn").cast("string"), F.lit('"} ')))
        .when(c == 2, F.lit('{"verdict":"maybe","reason":"unknown"}'))
        .when(c == 3, F.concat(F.lit("I think: "), "text"))
        .otherwise(F.lit('{"verdict":"pass"}')))


_VERDICT = "CASE conv_id % 5 WHEN 0 THEN 'reroute' WHEN 1 THEN 'borderline' ELSE 'pass' END"


@query("judge_verdict", f"""
    SELECT conv_id, turn, {_JUDGE} AS reply, {_VERDICT} AS verdict, CASE conv_id % 5
      WHEN 0 THEN 'words ' || {S.n_words('text')} WHEN 1 THEN 'turn ' || turn
      WHEN 2 THEN 'unknown' ELSE '' END AS reason FROM conversations""")
def judge_verdict(spark, d):
    verdict, reason = L.judge_verdict(F.col("reply"))
    return V.turns(spark, d).select("conv_id", "turn", _reply().alias("reply")).withColumns(
        {"verdict": verdict, "reason": reason})


@query("judge_prompt", f"""
    WITH {_SCRIPTS} SELECT sc.book_id, sc.number, '<source>' || chr(10)
      || left(coalesce(ch.text, ''), 8000) || chr(10) || '</source>' || chr(10) || chr(10)
      || '<script>' || chr(10) || left(script, 4000) || chr(10) || '</script>' || chr(10) AS prompt
    FROM sc LEFT JOIN ch ON sc.book_id = ch.book_id AND sc.number = ch.number""")
def judge_prompt(spark, d):
    docs = V.chapters(spark, d)
    # The judge sees the beginning only, so only that is shuffled.
    source = numbered(docs.select("book_id", "doc_id"), ["book_id"], ["doc_id"], "number").join(
        docs.select("doc_id", F.left("text", F.lit(K.JUDGE_SOURCE_CHARS)).alias("text")), "doc_id")
    scripts = numbered_scripts(spark, d).join(V.turns(spark, d, "assistant").select(
        "conv_id", "turn", F.col("text").alias("script")), ["conv_id", "turn"])
    return scripts.join(source, ["book_id", "number"], "left").select(
        "book_id", "number", L.judge_prompt(
            F.coalesce("text", F.lit("")), F.col("script")).alias("prompt"))


@query("script_validity", f"""
    WITH {_CYC}, b AS (SELECT chapter_id, 3 - attempts_used AS remaining FROM cyc
        WHERE cycle = 'cycle_2_reroute')
    SELECT conv_id, turn, {S.n_words('text')} AS n_words, coalesce(remaining, 3) AS remaining,
      CASE WHEN len({S.words('text')}) >= 200 THEN 'pass'
        WHEN {_VERDICT} <> 'reroute' THEN {_VERDICT}
        WHEN coalesce(remaining, 3) > 0 THEN 'pending' ELSE 'exhausted' END AS decision
    FROM conversations LEFT JOIN b ON conv_id = chapter_id WHERE role = 'assistant'""")
def script_validity(spark, d):
    left = _cycles(spark, d).filter(F.col("cycle") == K.CYCLES[1]).select(
        F.col("chapter_id").alias("conv_id"), (F.lit(K.BUDGET) - F.col("attempts_used"))
        .alias("remaining"))
    scripts = V.turns(spark, d, "assistant").select(
        "conv_id", "turn", X.word_count(F.col("text")).alias("n_words"),
        L.judge_verdict(_reply())[0].alias("verdict"))
    judged = lookup(scripts, left, ["conv_id"]).withColumn(
        "remaining", F.coalesce("remaining", F.lit(K.BUDGET)).cast("bigint"))
    return judged.select("conv_id", "turn", "n_words", "remaining", L.script_decision(
        F.col("n_words"), F.col("verdict"), F.col("remaining")).alias("decision"))


@query("short_scripts", f"""
    WITH {_SCRIPTS} SELECT book_id, number, replace(script, chr(10), ' ') AS title,
      {S.n_words('script')} AS n_words, CASE WHEN len({S.words('script')}) < 200 THEN 'SHORT'
        ELSE 'OK' END AS status FROM sc""")
def short_scripts(spark, d):
    texts = V.turns(spark, d, "assistant").select(
        "conv_id", "turn", X.marker_title(F.col("text")).alias("title"),
        X.word_count(F.col("text")).alias("n_words"))
    return L.short_scripts(numbered_scripts(spark, d).join(texts, ["conv_id", "turn"])).select(
        "book_id", "number", "title", "n_words", "status")


_ERRORS = ("Error: Could not connect to local LLM server.",
           "Error: Request to LLM timed out. Content might be too long.",
           "Error: API key issue. Please ensure your API key is properly configured.",
           "Error: Unable to generate script for this content.",
           "Error: Failed to generate script due to: ")


@query("error_scripts", """
    SELECT conv_id, turn, CASE conv_id % 8 WHEN 0 THEN 'connection' WHEN 1 THEN 'timeout'
      WHEN 2 THEN 'api_key' WHEN 3 THEN 'empty' WHEN 4 THEN 'other' END AS error
    FROM conversations""")
def error_scripts(spark, d):
    kind = (F.col("conv_id") % 8 + 1).cast("int")
    message = F.try_element_at(F.array(*map(F.lit, _ERRORS)), kind)
    script = F.coalesce(F.when(kind == 5, F.concat(message, "text")).otherwise(message), "text")
    return V.turns(spark, d).select("conv_id", "turn", L.error_class(script).alias("error"))


# --- transcripts --------------------------------------------------------------------------------

def distance_cte(pairs: str, ids: str) -> str:
    """Row by row edit distance. ``pairs`` has (ids, rw, hw) word lists; ends in ``dist``.

    The insertion step of a row is a running minimum over its cells, so one step does a whole row.
    """
    same = " AND ".join(f"dp.{i} = h.{i}" for i in ids.split(", "))
    return f"""
    pr AS ({pairs}),
    h AS (SELECT {ids}, unnest(hw) AS w, generate_subscripts(hw, 1) AS j FROM pr),
    dp AS (SELECT {ids}, 0 AS i, unnest(range(0, len(hw) + 1)) AS j,
        unnest(range(0, len(hw) + 1)) AS dist FROM pr
      UNION ALL
      SELECT {ids}, i + 1, j, min(t - j) OVER (PARTITION BY {ids} ORDER BY j) + j FROM (
        SELECT {', '.join('dp.' + i for i in ids.split(', '))}, dp.i, dp.j,
          CASE WHEN dp.j = 0 THEN dp.i + 1 ELSE least(dp.dist + 1, lag(dp.dist) OVER (
            PARTITION BY {', '.join('dp.' + i for i in ids.split(', '))} ORDER BY dp.j)
            + CASE WHEN pr.rw[dp.i + 1] = h.w THEN 0 ELSE 1 END) END AS t
        FROM dp JOIN pr USING ({ids}) LEFT JOIN h ON {same} AND dp.j = h.j
        WHERE dp.i < len(pr.rw))),
    dist AS (SELECT {ids}, pr.rw, pr.hw, dp.dist AS d FROM dp JOIN pr USING ({ids})
        WHERE dp.i = len(pr.rw) AND dp.j = len(pr.hw))"""


_WER = ("CASE WHEN len(rw) = 0 THEN CASE WHEN len(hw) = 0 THEN 0.0 ELSE 1.0 END "
        "ELSE least(d / len(rw), 1.0) END")


@query("wer", f"""
    WITH RECURSIVE {distance_cte(f'''
        SELECT a.conv_id, a.turn, {S.spoken('a.text')} AS rw, {S.spoken('b.text')} AS hw
        FROM conversations a JOIN conversations b
          ON a.conv_id = b.conv_id AND b.turn = a.turn + 1''', 'conv_id, turn')}
    SELECT conv_id, turn, CAST(len(rw) AS BIGINT) AS ref_words, CAST(d AS BIGINT) AS distance,
      {_WER} AS wer FROM dist""")
def wer(spark, d):
    pairs = V.spread(V.turn_pairs(spark, d)).select(
        "conv_id", "turn", spoken_words(F.col("ref")).alias("rw"),
        spoken_words(F.col("hyp")).alias("hw"))
    rows = pairs.select(
        "conv_id", "turn", F.size("rw").cast("bigint").alias("ref_words"),
        F.size("hw").alias("n_hyp"),
        W.word_distance(F.col("rw"), F.col("hw")).alias("distance"))
    return rows.select("conv_id", "turn", "ref_words", "distance", W.rate_of(
        F.col("distance"), F.col("ref_words"), F.col("n_hyp")).alias("wer"))


_HALF = "ceil(len({w}) / 2)"
_HEAD = (S.joined("list_filter(list_slice({w}, 1, CAST(" + _HALF + " AS BIGINT)), "
                  "lambda x, i: i % 7 <> 0)"))
_TAIL = (S.joined("list_filter(list_slice({w}, CAST(" + _HALF + " AS BIGINT) + 1, len({w})), "
                  "lambda x, i: i % 5 <> 0)"))


def _windows(text):
    """Transcripts that lost words: first half without every 7th, second without every 5th."""
    def cut(w):
        half = F.ceil(F.size(w) / 2).cast("int")
        head = F.filter(F.slice(w, F.lit(1), half), lambda x, i: (i + 1) % 7 != 0)
        tail = F.filter(F.slice(w, half + 1, F.size(w)), lambda x, i: (i + 1) % 5 != 0)
        return F.struct(F.array_join(head, " ").alias("head_hyp"),
                        F.array_join(tail, " ").alias("tail_hyp"))

    return X.let(X.words(text), cut)


@query("boundary_reference", f"""
    WITH t AS (SELECT conv_id, turn, text, {S.words('text')} AS w FROM conversations),
    s AS (SELECT conv_id, turn, {S.spoken('text')} AS rw,
        len({S.spoken(_HEAD.format(w='w'))}) AS hn, len({S.spoken(_TAIL.format(w='w'))}) AS tn
        FROM t)
    SELECT conv_id, turn, {S.joined('list_slice(rw, 1, hn)')} AS head,
      CASE WHEN tn = 0 THEN '' ELSE {S.joined('list_slice(rw, greatest(len(rw) - tn, 0) + 1, '
                                              'len(rw))')} END AS tail FROM s""")
def boundary_reference(spark, d):
    rows = V.turns(spark, d).select("conv_id", "turn", "text", _windows(F.col("text")).alias("h"))
    ref = spoken_words(F.col("text"))
    return rows.select(
        "conv_id", "turn",
        F.array_join(W.boundary_words(ref, spoken_words(F.col("h.head_hyp")), "head"), " ")
        .alias("head"),
        F.array_join(W.boundary_words(ref, spoken_words(F.col("h.tail_hyp")), "tail"), " ")
        .alias("tail"))


_FID_PAIRS = f"""
    SELECT conv_id, turn, side, hw, CASE WHEN len(hw) = 0 THEN CAST([] AS VARCHAR[])
      WHEN side = 0 THEN list_slice(sw, 1, len(hw))
      ELSE list_slice(sw, greatest(len(sw) - len(hw), 0) + 1, len(sw)) END AS rw
    FROM (SELECT conv_id, turn, 0 AS side, {S.spoken('text')} AS sw,
            {S.spoken(_HEAD.format(w='w'))} AS hw
          FROM (SELECT *, {S.words('text')} AS w FROM conversations WHERE role = 'assistant')
          UNION ALL SELECT conv_id, turn, 1, {S.spoken('text')}, {S.spoken(_TAIL.format(w='w'))}
          FROM (SELECT *, {S.words('text')} AS w FROM conversations WHERE role = 'assistant'))"""


@query("fidelity_check", f"""
    WITH RECURSIVE {distance_cte(_FID_PAIRS, 'conv_id, turn, side')},
    e AS (SELECT conv_id, turn, min({_WER}) FILTER (WHERE side = 0) AS h,
        min({_WER}) FILTER (WHERE side = 1) AS t, bool_or(len(hw) = 0) AS empty_transcript
        FROM dist GROUP BY 1, 2),
    r AS (SELECT conv_id, turn, empty_transcript, CASE WHEN conv_id % 5 = 0 THEN 1.0 ELSE h END
        AS head_wer, CASE WHEN conv_id % 5 = 0 THEN 1.0 ELSE t END AS tail_wer,
        (len({S.words('text')}) * (conv_id % 5) * 0.25::DOUBLE)
          / (greatest(len({S.words('text')}) / 75, 1.0) * 60) AS ratio
        FROM e JOIN conversations USING (conv_id, turn))
    SELECT conv_id, turn, head_wer, tail_wer, ratio, empty_transcript,
      head_wer > 0.3 OR tail_wer > 0.3 OR ratio < 0.5 AS suspect,
      CASE WHEN head_wer > 0.3 OR tail_wer > 0.3 OR ratio < 0.5 THEN concat_ws(', ',
        CASE WHEN head_wer > 0.3 THEN 'head WER ' || {S.fixed2('head_wer')} END,
        CASE WHEN tail_wer > 0.3 THEN 'tail WER ' || {S.fixed2('tail_wer')} END,
        CASE WHEN ratio < 0.5 THEN 'duration ratio ' || {S.fixed2('ratio')} END)
      ELSE 'below thresholds' END AS reason FROM r""")
def fidelity_check(spark, d):
    rows = V.spread(V.turns(spark, d, "assistant")).select(
        "conv_id", "turn", F.col("text").alias("script"), _windows(F.col("text")).alias("h"),
        (X.word_count(F.col("text")) * (F.col("conv_id") % 5) * F.lit(0.25)).alias("duration_s"))
    return Fi.fidelity_check(rows.select("*", "h.head_hyp", "h.tail_hyp")).select(
        "conv_id", "turn", "head_wer", "tail_wer", "ratio", "empty_transcript", "suspect",
        "reason")


_EPISODE = "(conv_id * 3 + turn) % 5"


@query("fidelity_ledger", f"""
    WITH RECURSIVE {distance_cte(_FID_PAIRS, 'conv_id, turn, side')},
    e AS (SELECT conv_id, turn, min({_WER}) FILTER (WHERE side = 0) AS h,
        min({_WER}) FILTER (WHERE side = 1) AS t FROM dist GROUP BY 1, 2),
    r AS (SELECT conv_id, turn, CASE WHEN {_EPISODE} = 0 THEN 1.0 ELSE h END AS h,
        CASE WHEN {_EPISODE} = 0 THEN 1.0 ELSE t END AS t,
        (len({S.words('text')}) * ({_EPISODE}) * 0.25::DOUBLE)
          / (greatest(len({S.words('text')}) / 75, 1.0) * 60) AS ratio
        FROM e JOIN conversations USING (conv_id, turn)),
    a AS (SELECT conv_id // 4 AS chapter_id, conv_id, turn, greatest(h, t) AS wer,
        h > 0.3 OR t > 0.3 OR ratio < 0.5 AS failed FROM r),
    l1 AS (SELECT *, row_number() OVER w AS attempt_no,
        CAST(sum(CAST(failed AS INT)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) - CAST(failed AS INT) AS fb,
        min({{'wer': wer, 'conv_id': conv_id, 'turn': turn}}) OVER (w ROWS UNBOUNDED PRECEDING) AS best FROM a
        WINDOW w AS (PARTITION BY chapter_id ORDER BY conv_id, turn)),
    l2 AS (SELECT *, coalesce(CAST(sum(CAST(NOT failed AND fb > 0 AS INT)) OVER (PARTITION BY chapter_id
        ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS pb FROM l1),
    l3 AS (SELECT *, CASE WHEN failed AND fb < 3 THEN 'retry' WHEN failed AND fb = 3 THEN 'exhausted'
          WHEN failed THEN 'beyond_budget' WHEN fb > 0 AND fb <= 3 AND pb = 0 THEN 'resolved' ELSE 'pass' END AS action
        FROM l2)
    SELECT chapter_id, conv_id, turn, attempt_no, failed, wer, action,
      CAST(3 - least(fb + CAST(failed AS INT), 3) AS BIGINT) AS remaining,
      CASE action WHEN 'resolved' THEN 'WER ' || {S.fixed2('wer')} || ' within 0.30 after re-chunk'
        WHEN 'exhausted' THEN 'WER ' || {S.fixed2('best.wer')} || ' exceeds 0.30 after 3 attempts' END AS flag,
      CASE WHEN NOT failed THEN conv_id WHEN action <> 'retry' THEN best.conv_id END AS kept_conv_id,
      CASE WHEN NOT failed THEN turn WHEN action <> 'retry' THEN best.turn END AS kept_turn FROM l3""")
def fidelity_ledger(spark, d):
    """Four conversations are the attempts at one chapter."""
    episode = (F.col("conv_id") * 3 + F.col("turn")) % 5
    rows = V.spread(V.turns(spark, d, "assistant")).select(
        F.floor(F.col("conv_id") / 4).cast("bigint").alias("chapter_id"), "conv_id", "turn", F.col("text").alias("script"),
        _windows(F.col("text")).alias("h"), (X.word_count(F.col("text")) * episode * F.lit(0.25)).alias("duration_s"))
    return Fi.fidelity_ledger(rows.select("*", "h.head_hyp", "h.tail_hyp"), ["chapter_id"], ["conv_id", "turn"])


@query("wer_documents")
def wer_documents(spark, d):
    """Whole documents against a transcript of their first half that lost every 7th word.

    No SQL: its row-by-row distance over texts of thousands of words takes too long.
    """
    rows = V.chapters(spark, d).select("book_id", "doc_id", "text", _windows(F.col("text")).alias("h"))
    return Fi.window_errors(rows, F.col("text"), F.col("h.head_hyp"), "head", "book_id", "doc_id")


@query("window_bounds", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0.0::DOUBLE AS head_start,
      least(8.0, l_quantity) AS head_end, greatest(l_quantity - 8.0, 0.0) AS tail_start,
      l_quantity AS tail_end FROM lineitem""")
def window_bounds(spark, d):
    # Quantities serve as seconds: from 1, shorter than a window, to 50.
    bounds = Fi.window_bounds(F.col("l_quantity"))
    return V.read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        *[c.alias(n) for n, c in bounds.items()])
