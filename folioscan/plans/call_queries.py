"""Routing texts to tasks, providers and model calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as K
from ..operators import answers as A
from ..operators import quality as Q
from ..operators import routing as R
from ..session import fresh_path
from ..sources import tables as V
from . import sql as S
from .registry import query
from .text_queries import _batch_cte

_TASKS = [t[0] for t in K.TASKS] + ["interview"]
_TASK_SQL = ("list_extract([" + ", ".join(f"'{t}'" for t in _TASKS)
             + "], CAST({} % 7 AS INT) + 1)")


def _task(c: str):
    return F.element_at(F.array(*map(F.lit, _TASKS)), (F.col(c) % 7 + 1).cast("int"))


_DIM = "(VALUES " + ", ".join(
    f"('{n}', {str(r).lower()}, '{'' if n == 'direct' else 'builtin:' + n}', "
    f"{p.get('temperature', 'NULL')})" for n, r, p in K.TASKS
) + ") t(task, requires_llm, prompt, temperature)"


@query("task_routing", f"""
    WITH q AS (SELECT conv_id, turn, {_TASK_SQL.format('conv_id')} AS task,
        CASE turn % 4 WHEN 1 THEN text WHEN 3 THEN CASE WHEN conv_id % 9 = 0 THEN '  ' END END
        AS prompt_file FROM conversations)
    SELECT conv_id, turn, task, coalesce(requires_llm, false) AS requires_llm, CAST(temperature AS DOUBLE) AS temperature,
      coalesce(nullif({S.strip('prompt_file')}, ''), prompt) AS resolved_prompt,
      CASE WHEN prompt_file IS NOT NULL AND nullif({S.strip('prompt_file')}, '') IS NULL
          THEN 'empty prompt file'
        WHEN nullif({S.strip('prompt_file')}, '') IS NULL AND requires_llm IS NULL
          THEN 'unknown task' END AS error
    FROM q LEFT JOIN {_DIM} USING (task)""")
def task_routing(spark, d):
    turn = F.col("turn") % 4
    asked = V.turns(spark, d).select(
        "conv_id", "turn", _task("conv_id").alias("task"),
        F.when(turn == 1, F.col("text")).when(
            (turn == 3) & (F.col("conv_id") % 9 == 0), "  ").alias("prompt_file"))
    return R.route_tasks(asked, V.tasks(spark)).select(
        "conv_id", "turn", "task", F.coalesce("requires_llm", F.lit(False)).alias("requires_llm"),
        F.try_element_at("llm_params", F.lit("temperature")).alias("temperature"),
        "resolved_prompt", "error")


@query("script_route", f"""
    WITH q AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE text END AS text,
        {_TASK_SQL.format('doc_id')} AS task FROM documents),
    c AS (SELECT doc_id, text, coalesce(requires_llm, true) AS needs,
        {S.clean_citations('text')} AS clean FROM q LEFT JOIN {_DIM} USING (task)),
    r AS (SELECT doc_id, clean, {S.n_words('clean')} AS clean_words, CASE
      WHEN length({S.strip('text')}) = 0 THEN 'fixed_sentence' WHEN NOT needs THEN 'no_model'
      WHEN len({S.words('clean')}) < 200 THEN 'too_short'
      WHEN len({S.words('clean')}) <= 2500 THEN 'one_call' ELSE 'chunked' END AS route FROM c)
    SELECT doc_id, clean_words, route, CASE WHEN route = 'fixed_sentence'
      THEN '{K.EMPTY_CHAPTER_SCRIPT}' WHEN route IN ('no_model', 'too_short') THEN clean END
      AS script FROM r""")
def script_route(spark, d):
    docs = V.chapters(spark, d).select(
        "doc_id", F.when(F.col("doc_id") % 11 == 0, "  ").otherwise(F.col("text")).alias("text"),
        _task("doc_id").alias("task"))
    routed = docs.join(F.broadcast(V.tasks(spark).select("task", "requires_llm")), "task", "left")
    return Q.script_route(routed.withColumn(
        "needs", F.coalesce("requires_llm", F.lit(True))), "needs").select(
        "doc_id", "clean_words", "route", "script")


@query("validate_prompts", f"""
    WITH q AS (SELECT conv_id, turn, unnest(string_split(text || chr(10) || ' ', chr(10)))
        AS prompt FROM conversations)
    SELECT conv_id, turn, prompt, length({S.strip('prompt')}) >= 10 AS ok,
      CASE WHEN length({S.strip('prompt')}) = 0 THEN 'Prompt cannot be empty.'
        WHEN length({S.strip('prompt')}) < 10
          THEN 'Prompt is too short. Minimum 10 characters required.'
        ELSE 'Prompt is valid.' END AS message FROM q""")
def validate_prompts(spark, d):
    # Every line serves as a prompt, with one blank line at the end of each turn.
    lines = V.turns(spark, d).select("conv_id", "turn", F.explode(F.split(
        F.concat("text", F.lit("\n ")), "\n")).alias("prompt"))
    ok, message = R.validate_prompt(F.col("prompt"))
    return lines.withColumns({"ok": ok, "message": message})


@query("language_names", "SELECT doc_id, lang, CASE lang " + " ".join(
    f"WHEN '{c}' THEN '{n}'" for c, n in K.LANGUAGES) + """ ELSE lang END AS language
    FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'x-' || lang ELSE lang END AS lang
          FROM documents)""")
def language_names(spark, d):
    docs = V.read(spark, d, "documents").select("doc_id", F.when(
        F.col("doc_id") % 10 == 0, F.concat(F.lit("x-"), "lang")).otherwise(F.col("lang"))
        .alias("lang"))
    return R.language_names(docs, V.languages(spark), "lang")


_REQUESTS = """
    WITH q AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS prompt,
        list_extract(['en', 'es', 'fr', 'de'], CAST(conv_id % 4 AS INT) + 1) AS language
        FROM conversations)"""


def _requests(spark, d):
    language = F.element_at(F.array(*map(F.lit, ("en", "es", "fr", "de"))),
                            (F.col("conv_id") % 4 + 1).cast("int"))
    return V.turns(spark, d).select(
        "conv_id", "turn", F.explode(F.split("text", "\n")).alias("prompt"),
        language.alias("language"))


@query("dedupe_calls", f"""{_REQUESTS}
    SELECT prompt, language, count(*) AS uses FROM q WHERE language <> 'en' GROUP BY 1, 2""")
def dedupe_calls(spark, d):
    return R.distinct_calls(_requests(spark, d))


@query("answer_calls", f"""{_REQUESTS}
    SELECT conv_id, turn, prompt, language, CASE WHEN language = 'en' OR length(prompt) % 5 = 0
      THEN prompt ELSE '[' || language || '] ' || prompt END AS translated FROM q""")
def answer_calls(spark, d):
    requests = _requests(spark, d)
    # A stand-in for the model: marks the language, and fails on every fifth length.
    answers = R.distinct_calls(requests).select("prompt", "language", F.when(
        F.length("prompt") % 5 != 0, F.concat(
            F.lit("["), "language", F.lit("] "), "prompt")).alias("answer"))
    return R.answer_calls(requests, answers)


def _stand_in(calls):
    """A model that marks the language, and fails on every fifth length."""
    return [f"[{language}] {prompt}" if len(prompt) % 5 else ValueError("refused")
            for prompt, language in zip(calls["prompt"], calls["language"])]


@query("kept_answers", f"""{_REQUESTS},
    c AS (SELECT prompt, language, min(conv_id // 4 % 2) AS late FROM q WHERE language <> 'en' GROUP BY 1, 2)
    SELECT prompt, language, CASE WHEN length(prompt) % 5 > 0 THEN '[' || language || '] ' || prompt END AS answer,
      CASE WHEN length(prompt) % 5 > 0 THEN CAST(late + 1 AS BIGINT) ELSE 0 END AS run_no,
      CASE WHEN length(prompt) % 5 = 0 THEN 'ValueError' END AS error_class FROM c""")
def kept_answers(spark, d):
    """Half of the conversations in a first run, all of them in a second one that asks only for what is new.

    The run that got an answer is 0 where none did.
    """
    store = A.open_answers(spark, fresh_path(spark, "answers"))
    requests = _requests(spark, d).filter("language <> 'en'")
    A.answer_new(requests.filter("conv_id div 4 % 2 = 0"), store, _stand_in, 1)
    return A.answer_new(requests, store, _stand_in, 2).fillna(0, "run_no")


def _provider(name: str, limit: int, unit: str) -> str:
    size = "strlen" if unit == "bytes" else "length"
    return _batch_cte(str(limit), size, tag=f"_{name}")


@query("request_plan", f"""
    WITH {S.pieces_cte()}, {', '.join(_provider(*p) for p in K.PROVIDERS)},
    u AS ({' UNION ALL '.join(f"SELECT '{n}' AS provider, parts FROM batches_{n}"
                              for n, _, _ in K.PROVIDERS)})
    SELECT provider, CAST(sum(len(parts)) AS BIGINT) AS requests, CAST(sum(coalesce(list_sum(
      list_transform(parts, lambda x: length(x))), 0)) AS BIGINT) AS chars FROM u GROUP BY 1""")
def request_plan(spark, d):
    return R.request_counts(V.chapters(spark, d), "text")


@query("cross_pairs_limit", """
    WITH l AS (SELECT DISTINCT p_brand AS left_item FROM part),
    r AS (SELECT DISTINCT s_name AS right_item FROM supplier)
    SELECT row_number() OVER (ORDER BY left_item, right_item) AS pair_no, left_item, right_item
    FROM l, r ORDER BY left_item, right_item LIMIT 250""")
def cross_pairs_limit(spark, d):
    return R.first_pairs(V.read(spark, d, "part").select("p_brand").distinct(),
                         V.read(spark, d, "supplier").select("s_name").distinct(), 250)


_EXT = ("list_extract(['.epub', '.PDF', '.txt', '.md', '.docx', ''], "
        "CAST(p_partkey % 6 AS INT) + 1)")


@query("source_type", f"""
    WITH f AS (SELECT p_partkey, p_name || {_EXT} AS name FROM part),
    e AS (SELECT *, lower(regexp_extract(name, '(\\.[^./]+)$', 1)) AS ext FROM f)
    SELECT p_partkey, name, CASE WHEN ext IN ('.epub', '.pdf', '.txt', '.md')
      THEN substr(ext, 2) END AS kind FROM e""")
def source_type(spark, d):
    ext = F.element_at(F.array(*map(F.lit, (".epub", ".PDF", ".txt", ".md", ".docx", ""))),
                       (F.col("p_partkey") % 6 + 1).cast("int"))
    files = V.read(spark, d, "part").select("p_partkey", F.concat("p_name", ext).alias("name"))
    return files.withColumn("kind", R.source_type(F.col("name")))
