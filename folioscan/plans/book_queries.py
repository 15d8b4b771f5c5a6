"""Source chapters against produced ones, durations, parts and library-wide reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as X
from ..functions.words import expected_seconds
from ..operators import quality as Q
from ..operators import reconcile as R
from ..operators import runs as L
from ..operators.ordered import numbered
from ..operators.packing import pack_parts
from ..session import durable
from ..sources import files as FS
from ..sources import tables as V
from . import sql as S
from .registry import query


# --- shared pieces ----------------------------------------------------------------------------

def chapter_facts(spark: SparkSession, d: str, parity: int | None = None) -> DataFrame:
    """Narrow chapter rows, written once so that texts are read only once."""
    facts = V.chapter_facts(spark, d)
    return durable(facts if parity is None else facts.filter(F.col("doc_id") % 2 == parity))


def source_titles(facts: DataFrame) -> DataFrame:
    return numbered(facts.select("book_id", "doc_id", "title"), ["book_id"], ["doc_id"], "number")


def audio_titles(spark: SparkSession, d: str, facts: DataFrame) -> DataFrame:
    return numbered(durable(V.produced(spark, d, facts)), ["book_id"],
                    [F.col("quality").desc(), F.col("doc_id")], "position", start=0)


def sides(spark: SparkSession, d: str, parity: int | None = None
          ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, source titles, audio titles)."""
    facts = chapter_facts(spark, d, parity)
    return facts, source_titles(facts), audio_titles(spark, d, facts)


def reports(spark: SparkSession, d: str, parity: int | None = None) -> DataFrame:
    """One report row per book."""
    facts, source, audio = sides(spark, d, parity)
    counts = R.verify_report(source, audio)
    out = R.issues(counts.join(R.duration_hints(facts, audio), "book_id"))
    return out.withColumn("status", F.when(F.col("passed"), "OK").otherwise("ISSUES"))


def cte(parity: int | None = None, p: str = "") -> str:
    """The same pieces in SQL; ``p`` prefixes the names so two runs fit one statement."""
    where = "" if parity is None else f"WHERE doc_id % 2 = {parity}"
    return f"""
    {p}facts AS (SELECT source AS book_id, doc_id, lang, {S.title('text')} AS title,
        {S.n_words('text')} AS n_words, n_chars,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number
        FROM documents {where}),
    {p}audio AS (SELECT book_id, doc_id, quality,
        CASE WHEN toxic = 1 THEN 'Bonus ' || title ELSE title END AS title,
        CASE WHEN quality = 1 THEN n_chars / 4 ELSE n_chars / 16 END AS duration_s,
        row_number() OVER (PARTITION BY book_id ORDER BY quality DESC, doc_id) - 1 AS position
        FROM {p}facts JOIN labels USING (doc_id)),
    {p}src AS (SELECT book_id, lower(title) AS key, max(number) AS number,
        arg_max(title, number) AS title FROM {p}facts GROUP BY 1, 2),
    {p}aud AS (SELECT book_id, lower(title) AS key, max(position) AS position
        FROM {p}audio GROUP BY 1, 2),
    {p}al AS (SELECT * FROM {p}src FULL JOIN {p}aud USING (book_id, key)),
    {p}com AS (SELECT * FROM {p}al WHERE number IS NOT NULL AND position IS NOT NULL),
    {p}late AS (SELECT * FROM {p}com c WHERE EXISTS (SELECT 1 FROM {p}com o
        WHERE o.book_id = c.book_id AND o.number < c.number AND o.position > c.position))"""


def _pct(m: str, t: str) -> str:
    return (f"CASE WHEN {t} = 0 THEN 0.0 ELSE "
            f"{S.half_up(f'{m} / greatest({t}, 1) * 100', 1)} END")


def report_cte(p: str = "") -> str:
    return f"""
    {p}cnt AS (SELECT book_id, count(*) AS total_source, sum(n_words) AS word_count
        FROM {p}facts GROUP BY 1),
    {p}cna AS (SELECT book_id, count(*) AS total_audio, sum(duration_s) AS actual_s
        FROM {p}audio GROUP BY 1),
    {p}ttl AS (SELECT book_id,
        count(*) FILTER (WHERE number IS NOT NULL AND position IS NOT NULL) AS matched,
        count(*) FILTER (WHERE position IS NULL) AS missing,
        count(*) FILTER (WHERE number IS NULL) AS extra FROM {p}al GROUP BY 1),
    {p}ord AS (SELECT book_id, count(*) AS late FROM {p}late GROUP BY 1),
    {p}raw AS (SELECT book_id, total_source, CAST(coalesce(total_audio, 0) AS BIGINT) AS total_audio,
        matched, missing, extra, coalesce(late, 0) AS order_violations,
        matched - coalesce(late, 0) AS matched_in_order,
        {_pct('matched', 'total_source')} AS match_pct,
        CAST(word_count AS BIGINT) AS word_count, coalesce(actual_s, 0.0) AS actual_s,
        greatest(word_count / 75, 1.0) * 60 AS expected_s
        FROM {p}cnt LEFT JOIN {p}cna USING (book_id) LEFT JOIN {p}ttl USING (book_id)
        LEFT JOIN {p}ord USING (book_id)),
    {p}rep AS (SELECT *, actual_s / expected_s AS ratio,
        CAST(missing > 0 AS INT) + CAST(extra > 0 AS INT) + CAST(order_violations > 0 AS INT)
        + CAST(actual_s / expected_s < 0.6 AS INT) AS issues_count FROM {p}raw)"""


FULL = f"{cte()}, {report_cte()}"


# --- titles -----------------------------------------------------------------------------------

@query("chapter_numbering", """
    SELECT source AS book_id, doc_id,
      row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number FROM documents""")
def chapter_numbering(spark, d):
    docs = V.read(spark, d, "documents").select(F.col("source").alias("book_id"), "doc_id")
    return numbered(docs, ["book_id"], ["doc_id"], "number")


@query("title_lookup", f"WITH {cte()} SELECT book_id, key, number, title FROM src")
def title_lookup(spark, d):
    return R.last_source(source_titles(chapter_facts(spark, d)))


@query("missing_chapters", f"""
    WITH {cte()} SELECT book_id, number, title, number - 1 AS expected_position FROM al
    WHERE position IS NULL""")
def missing_chapters(spark, d):
    _, source, audio = sides(spark, d)
    return R.missing(R.align(source, audio))


@query("extra_chapters", f"""
    WITH {cte()} SELECT book_id, position + 1 AS number, key AS title, position FROM al
    WHERE number IS NULL""")
def extra_chapters(spark, d):
    _, source, audio = sides(spark, d)
    return R.extra(R.align(source, audio))


@query("matched_chapters", f"WITH {cte()} SELECT book_id, key, number, position FROM com")
def matched_chapters(spark, d):
    _, source, audio = sides(spark, d)
    return R.matched(R.align(source, audio))


@query("order_violations", f"""
    WITH {cte()} SELECT book_id, number, key AS title, number - 1 AS expected_order,
      position AS actual_position FROM late""")
def order_violations(spark, d):
    _, source, audio = sides(spark, d)
    return R.order_violations(durable(R.align(source, audio)))


@query("title_except", f"""
    WITH {cte()} SELECT book_id, lower(title) AS key FROM facts
    EXCEPT SELECT book_id, lower(title) AS key FROM audio""")
def title_except(spark, d):
    facts = chapter_facts(spark, d)
    source, audio = facts, V.produced(spark, d, facts)
    return R.titles(source).subtract(R.titles(audio))


@query("title_intersect", f"""
    WITH {cte()} SELECT book_id, lower(title) AS key FROM facts
    INTERSECT SELECT book_id, lower(title) AS key FROM audio""")
def title_intersect(spark, d):
    facts = chapter_facts(spark, d)
    source, audio = facts, V.produced(spark, d, facts)
    return R.titles(source).intersect(R.titles(audio))


@query("titles_by_ordinal", f"""
    WITH {cte()} SELECT f.book_id, f.number, coalesce(nullif(a.title, ''), 'Episode ' || f.number)
      AS title FROM facts f LEFT JOIN audio a ON f.book_id = a.book_id
      AND f.number = a.position + 1""")
def titles_by_ordinal(spark, d):
    _, source, audio = sides(spark, d)
    titles = audio.select("book_id", (F.col("position") + 1).alias("number"), "title")
    return R.titles_by_ordinal(source.select("book_id", "number"), titles)


# --- reports ----------------------------------------------------------------------------------

_COUNTS = ["book_id", "total_source", "total_audio", "matched", "missing", "extra",
           "order_violations", "matched_in_order", "match_pct"]


@query("verify_report", f"WITH {FULL} SELECT {', '.join(_COUNTS)} FROM raw")
def verify_report(spark, d):
    _, source, audio = sides(spark, d)
    return R.verify_report(source, audio).select(*_COUNTS)


@query("duration_hint", f"""
    WITH {FULL} SELECT book_id, word_count, actual_s, expected_s, ratio FROM rep""")
def duration_hint(spark, d):
    facts = chapter_facts(spark, d)
    return R.duration_hints(facts, V.produced(spark, d, facts)).select(
        "book_id", "word_count", "actual_s", "expected_s", "ratio")


_CLASS = """CASE WHEN ratio < 0.5 THEN 'much_shorter' WHEN ratio < 0.9 THEN 'shorter'
    WHEN ratio > 1.5 THEN 'much_longer' WHEN ratio > 1.1 THEN 'longer' ELSE 'as_expected' END"""
_MESSAGE = "CASE cls " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in K.DURATION_CLASSES.items()) + " END"


@query("duration_class", f"""
    WITH c AS (SELECT l_suppkey AS book_id, l_orderkey, l_linenumber, l_partkey,
        l_extendedprice / (greatest(l_quantity * 25 / 75, 1.0) * 60) / 50 AS ratio FROM lineitem),
    k AS (SELECT *, {_CLASS} AS cls FROM c)
    SELECT book_id, l_orderkey, l_linenumber, l_partkey, cls, {_MESSAGE} AS message FROM k""")
def duration_class(spark, d):
    rows = V.read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("book_id"), "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("l_extendedprice") / expected_seconds(F.col("l_quantity") * 25) / 50
         ).alias("ratio"))
    return rows.withColumns({"cls": R.duration_class(F.col("ratio")),
                             "message": R.duration_message(F.col("ratio"))}).drop("ratio")


@query("chapter_duration_check", f"""
    WITH {cte()}, c AS (SELECT a.book_id, a.doc_id, n_words, duration_s,
        greatest(n_words / 75, 0.5) * 60 AS expected_s FROM audio a JOIN facts f USING (doc_id))
    SELECT book_id, doc_id, n_words, duration_s, expected_s, duration_s / expected_s AS ratio,
      duration_s / expected_s >= 0.7 AS is_ok FROM c""")
def chapter_duration_check(spark, d):
    facts = chapter_facts(spark, d)
    audio = V.produced(spark, d, facts).select("doc_id", "duration_s")
    rows = facts.select("book_id", "doc_id", "n_words").join(audio, "doc_id")
    return R.chapter_duration_check(rows, "n_words", "duration_s")


@query("book_verification", f"""
    WITH {FULL} SELECT book_id, CAST(issues_count AS BIGINT) AS issues_count,
      issues_count = 0 AS passed, concat_ws('; ',
        CASE WHEN missing > 0 THEN 'Missing chapters: ' || missing END,
        CASE WHEN extra > 0 THEN 'Extra chapters: ' || extra END,
        CASE WHEN order_violations > 0 THEN 'Order violations: ' || order_violations END,
        CASE WHEN ratio < 0.6 THEN 'Audio shorter than expected' END) AS issues FROM rep""")
def book_verification(spark, d):
    return reports(spark, d).select(
        "book_id", "issues_count", "passed", F.array_join("issues", "; ").alias("issues"))


@query("match_grade", f"""
    WITH {FULL} SELECT book_id, match_pct,
      CASE WHEN match_pct = 100 THEN 'PASS' WHEN match_pct >= 90 THEN 'NEAR MISS' ELSE 'FAIL' END
        AS status,
      CASE WHEN match_pct >= 100 THEN 'PERFECT' WHEN match_pct >= 90 THEN 'GOOD'
        WHEN match_pct >= 70 THEN 'FAIR' WHEN match_pct >= 50 THEN 'POOR' ELSE 'CRITICAL' END
        AS grade FROM raw""")
def match_grade(spark, d):
    _, source, audio = sides(spark, d)
    pct = F.col("match_pct")
    return R.verify_report(source, audio).select(
        "book_id", "match_pct", R.status_line(pct).alias("status"), R.grade(pct).alias("grade"))


@query("first_issues", f"""
    WITH {cte()}, n AS (SELECT book_id, title, row_number() OVER (PARTITION BY book_id
        ORDER BY key) AS rn FROM al WHERE position IS NULL)
    SELECT book_id, string_agg(title, ', ' ORDER BY rn) AS titles FROM n WHERE rn <= 3
    GROUP BY book_id""")
def first_issues(spark, d):
    _, source, audio = sides(spark, d)
    gone = R.align(source, audio).filter("position is null").select("book_id", "key", "title")
    return R.first_per_book(gone, ["key"], 3, "title")


@query("library_summary", f"""
    WITH {FULL} SELECT count(*) AS total, count(*) FILTER (WHERE issues_count = 0) AS ok,
      count(*) FILTER (WHERE issues_count > 0) AS with_issues, CAST(0 AS BIGINT) AS errors,
      min(ratio) AS min_ratio, max(ratio) AS max_ratio,
      count(*) FILTER (WHERE ratio < 0.60) AS short_books,
      count(*) FILTER (WHERE matched < total_source) AS incomplete_books,
      {S.half_up('avg(ratio)', 3)} AS avg_ratio FROM rep""")
def library_summary(spark, d):
    return L.library_summary(reports(spark, d))


@query("short_books", f"WITH {FULL} SELECT book_id, ratio FROM rep WHERE ratio < 0.60")
def short_books(spark, d):
    return L.short_books(reports(spark, d))


@query("incomplete_books", f"""
    WITH {FULL} SELECT book_id, matched, total_source FROM rep WHERE matched < total_source""")
def incomplete_books(spark, d):
    return L.incomplete_books(reports(spark, d))


_LANG_CTE = f"""{FULL},
    lang AS (SELECT book_id, min(lang) AS lang FROM (SELECT book_id, lang, count(*) AS n,
        row_number() OVER (PARTITION BY book_id ORDER BY count(*) DESC, lang) AS rn FROM facts
        GROUP BY book_id, lang) WHERE rn = 1 GROUP BY book_id)"""


@query("match_summary_rollup", f"""
    WITH {_LANG_CTE} SELECT lang, count(*) AS n_books,
      count(*) FILTER (WHERE match_pct >= 100) AS perfect,
      count(*) FILTER (WHERE match_pct >= 90 AND match_pct < 100) AS good,
      count(*) FILTER (WHERE match_pct < 90) AS poor,
      {S.half_up('avg(floor(match_pct * 10.0::DOUBLE + 0.5)) / 10', 1)} AS avg_match
    FROM rep JOIN lang USING (book_id) GROUP BY ROLLUP (lang)""")
def match_summary_rollup(spark, d):
    # A book's language: the one it uses most, ties by code.
    facts, source, audio = sides(spark, d)
    per = facts.groupBy("book_id", "lang").agg(F.count(F.lit(1)).alias("n"))
    lang = per.groupBy("book_id").agg(F.min(F.struct(-F.col("n"), "lang")).alias("m")).select(
        "book_id", "m.lang")
    return L.match_summary(R.verify_report(source, audio).join(lang, "book_id"), "lang")


@query("rank_worst", f"""
    WITH {FULL} SELECT book_id, ratio, row_number() OVER (ORDER BY ratio, book_id) AS rank
    FROM rep""")
def rank_worst(spark, d):
    facts = chapter_facts(spark, d)
    ratios = R.duration_hints(facts, V.produced(spark, d, facts)).select("book_id", "ratio")
    return numbered(ratios, [], ["ratio", "book_id"], "rank")


@query("top_worst", f"""
    WITH {FULL} SELECT book_id, ratio, CASE WHEN ratio < 0.25 THEN 'CRITICAL'
      WHEN ratio < 0.45 THEN 'POOR' WHEN ratio < 0.60 THEN 'ACCEPTABLE' ELSE 'GOOD' END AS band
    FROM rep ORDER BY ratio, book_id LIMIT 5""")
def top_worst(spark, d):
    facts = chapter_facts(spark, d)
    ratios = R.duration_hints(facts, V.produced(spark, d, facts))
    return L.worst(ratios.select("book_id", "ratio")).withColumn(
        "band", L.ratio_band(F.col("ratio")))


@query("limit_per_book", """
    SELECT book_id, doc_id, number FROM (SELECT source AS book_id, doc_id,
      row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number FROM documents)
    WHERE number <= 5""")
def limit_per_book(spark, d):
    docs = V.read(spark, d, "documents").select(F.col("source").alias("book_id"), "doc_id")
    return R.limit_per_book(docs, ["doc_id"], 5)


# --- runs -------------------------------------------------------------------------------------

def run_names(spark, d, parity):
    """Books of one run in name order, which is the order its file lists them in."""
    docs = V.read(spark, d, "documents").filter(F.col("doc_id") % 2 == parity)
    names = docs.select(F.col("source").alias("name")).distinct()
    return numbered(names, [], ["name"], "pos")


def run_rows(spark, d, parity):
    """Report rows of one run with their place in its file."""
    rows = reports(spark, d, parity).select(
        F.col("book_id").alias("source"), "status", "ratio", "matched", "total_source",
        "issues_count")
    return rows.join(run_names(spark, d, parity).withColumnRenamed("name", "source"), "source")


_RUNS = f"""{cte(0, 'a_')}, {report_cte('a_')}, {cte(1, 'b_')}, {report_cte('b_')},
    ra AS (SELECT *, row_number() OVER (ORDER BY book_id) AS pos FROM a_rep),
    rb AS (SELECT *, row_number() OVER (ORDER BY book_id) AS pos FROM b_rep),
    hit AS (SELECT a.book_id, min(b.pos) AS bpos FROM ra a JOIN rb b
        ON contains(lower(b.book_id), lower(a.book_id)) OR contains(lower(a.book_id),
           lower(b.book_id)) GROUP BY a.book_id),
    cmp AS (SELECT a.book_id AS source, a.pos,
        {S.half_up('a.ratio', 3)} AS baseline_ratio, {S.half_up('b.ratio', 3)} AS improved_ratio,
        {S.half_up('CASE WHEN a.ratio > 0 THEN (b.ratio - a.ratio) / a.ratio * 100 ELSE 0 END', 1)}
          AS ratio_improvement_percent,
        a.matched AS baseline_chapters, b.matched AS improved_chapters,
        b.matched - a.matched AS chapter_improvement,
        CAST(a.issues_count AS BIGINT) AS baseline_issues,
        CAST(b.issues_count AS BIGINT) AS improved_issues,
        CAST(a.issues_count - b.issues_count AS BIGINT) AS issue_improvement
        FROM ra a JOIN hit USING (book_id) JOIN rb b ON b.pos = hit.bpos)"""


@query("fuzzy_match_runs", f"""
    WITH {_RUNS} SELECT book_id AS name, bpos AS pos FROM hit""")
def fuzzy_match_runs(spark, d):
    return L.fuzzy_match(run_names(spark, d, 0).select("name"), run_names(spark, d, 1))


@query("compare_runs", f"WITH {_RUNS} SELECT * FROM cmp")
def compare_runs(spark, d):
    return L.compare_runs(durable(run_rows(spark, d, 0)), durable(run_rows(spark, d, 1))).orderBy(
        F.col("ratio_improvement_percent").desc(), "pos")


@query("compare_summary", f"""
    WITH {_RUNS} SELECT count(*) AS total_books,
      {S.half_up('avg(floor(ratio_improvement_percent * 10.0::DOUBLE + 0.5)) / 10', 1)}
        AS avg_ratio_improvement_percent,
      {S.half_up('avg(chapter_improvement)', 2)} AS avg_chapter_improvement,
      {S.half_up('avg(issue_improvement)', 2)} AS avg_issue_improvement,
      count(*) FILTER (WHERE ratio_improvement_percent > 0) AS books_improved,
      count(*) FILTER (WHERE ratio_improvement_percent < 0) AS books_regressed,
      count(*) FILTER (WHERE ratio_improvement_percent = 0) AS books_same,
      {S.half_up('count(*) FILTER (WHERE ratio_improvement_percent > 0) / count(*) * 100', 1)}
        AS improvement_rate,
      max(ratio_improvement_percent) AS best_improvement_percent,
      (SELECT source FROM cmp ORDER BY ratio_improvement_percent DESC, pos LIMIT 1)
        AS best_improvement_book,
      min(ratio_improvement_percent) AS worst_regression_percent,
      (SELECT source FROM cmp ORDER BY ratio_improvement_percent, pos LIMIT 1)
        AS worst_regression_book FROM cmp""")
def compare_summary(spark, d):
    return L.compare_summary(L.compare_runs(
        durable(run_rows(spark, d, 0)), durable(run_rows(spark, d, 1))))


# --- scripts against sources --------------------------------------------------------------------

_SCRIPTS = """
    sc AS (SELECT 'src' || (conv_id % 20) AS book_id, conv_id, turn, text AS script,
        row_number() OVER (PARTITION BY conv_id % 20 ORDER BY conv_id, turn) AS number
        FROM conversations WHERE role = 'assistant'),
    ch AS (SELECT source AS book_id, doc_id, text,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number FROM documents)"""


def numbered_scripts(spark, d):
    """Scripts of a book in order; twenty conversations in turn make up the books."""
    rows = V.turns(spark, d, "assistant").select(
        F.concat(F.lit("src"), F.col("conv_id") % 20).alias("book_id"), "conv_id", "turn")
    return numbered(rows, ["book_id"], ["conv_id", "turn"], "number")


def script_pairs(spark, d):
    """Scripts next to their source chapter by number; a missing source counts as empty."""
    facts = V.chapter_facts(spark, d).select("doc_id", "n_words")
    docs = V.read(spark, d, "documents").select(F.col("source").alias("book_id"), "doc_id")
    source = numbered(docs, ["book_id"], ["doc_id"], "number").join(facts, "doc_id")
    words = V.turns(spark, d, "assistant").select(
        "conv_id", "turn", X.word_count(F.col("text")).alias("script_words"))
    scripts = numbered_scripts(spark, d).join(words, ["conv_id", "turn"])
    return scripts.join(source, ["book_id", "number"], "left").select(
        "book_id", "number", "doc_id", "script_words",
        F.coalesce("n_words", F.lit(0)).cast("bigint").alias("source_words"))


@query("script_source_pairs", f"""
    WITH {_SCRIPTS} SELECT sc.book_id, sc.number, doc_id, {S.n_words('script')} AS script_words,
      CAST(coalesce({S.n_words('text')}, 0) AS BIGINT) AS source_words
    FROM sc LEFT JOIN ch ON sc.book_id = ch.book_id AND sc.number = ch.number""")
def script_source_pairs(spark, d):
    return script_pairs(spark, d)


@query("content_preservation", f"""
    WITH {_SCRIPTS}, p AS (SELECT sc.book_id, {S.n_words('script')} AS sw,
        CAST(coalesce({S.n_words('text')}, 0) AS BIGINT) AS ow
      FROM sc LEFT JOIN ch ON sc.book_id = ch.book_id AND sc.number = ch.number)
    SELECT book_id, count(*) AS n_scripts, CAST(sum(sw) AS BIGINT) AS script_words,
      CAST(sum(ow) AS BIGINT) AS source_words,
      count(*) FILTER (WHERE ow > 0 AND sw / ow < 0.60) AS n_short,
      CASE WHEN sum(ow) > 0 THEN sum(sw) / sum(ow) END AS kept FROM p GROUP BY book_id""")
def content_preservation(spark, d):
    return Q.preservation(script_pairs(spark, d), "book_id")


@query("checkable_episodes", f"""
    WITH {_SCRIPTS} SELECT book_id, number FROM ch
    WHERE doc_id IN (SELECT doc_id FROM labels)
      AND EXISTS (SELECT 1 FROM sc WHERE sc.book_id = ch.book_id AND sc.number = ch.number)""")
def checkable_episodes(spark, d):
    docs = V.read(spark, d, "documents").select(F.col("source").alias("book_id"), "doc_id")
    wanted = numbered(docs, ["book_id"], ["doc_id"], "number")
    return R.checkable(wanted, numbered_scripts(spark, d),
                       V.read(spark, d, "labels").select("doc_id")).select("book_id", "number")


# --- episodes -----------------------------------------------------------------------------------

_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "duration_s"]
_EP = """ep AS (SELECT l_suppkey AS book_id, l_orderkey, l_linenumber, l_partkey,
    l_extendedprice AS duration_s, CAST(floor(l_extendedprice * 1000) AS BIGINT) AS ms,
    row_number() OVER w AS episode_no,
    CAST(sum(CAST(floor(l_extendedprice * 1000) AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING)
      AS BIGINT) AS end_ms FROM lineitem
    WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey,
      l_extendedprice))"""


def _episodes(spark, d):
    return V.read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("book_id"), "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_extendedprice").alias("duration_s"))


@query("total_duration", """
    SELECT l_suppkey AS book_id, CAST(sum(CAST(floor(l_extendedprice * 1000) AS BIGINT)) AS BIGINT)
      AS total_ms FROM lineitem GROUP BY 1""")
def total_duration(spark, d):
    return _episodes(spark, d).groupBy("book_id").agg(
        F.sum(F.coalesce(F.floor(F.col("duration_s") * 1000), F.lit(0)).cast("bigint"))
        .alias("total_ms"))


@query("chapter_offsets", f"""
    WITH {_EP} SELECT book_id, episode_no, end_ms - ms AS start_ms, end_ms FROM ep""")
def chapter_offsets(spark, d):
    return R.offsets(_episodes(spark, d), _ORDER).select(
        "book_id", F.col("episode_no").cast("bigint").alias("episode_no"), "start_ms", "end_ms")


_BLOCK = ("'[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || (end_ms - ms) || "
          "chr(10) || 'END=' || end_ms || chr(10) || 'title=Episode ' || episode_no || chr(10)")
_HEADER = " || chr(10) || ".join(
    [f"'{line}'" for line in K.MARKER_HEADER.split("\n")[:-1]]) + " || chr(10)"


@query("emit_chapter_markers", f"""
    WITH {_EP} SELECT book_id, episode_no AS block_no, {_BLOCK} AS block FROM ep
    UNION ALL SELECT DISTINCT book_id, 0, {_HEADER} FROM ep""")
def emit_chapter_markers(spark, d):
    rows = R.offsets(_episodes(spark, d), _ORDER)
    return FS.marker_rows(rows, F.concat(F.lit("Episode "), "episode_no"))


@query("pack_parts_14h", """
    WITH RECURSIVE e AS (SELECT l_suppkey AS book_id,
        CAST(floor(l_extendedprice / 20 * 1000) AS BIGINT) AS ms,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey,
          l_extendedprice) AS n FROM lineitem),
    p AS (SELECT book_id, n, ms AS cur, 1 AS part_no, ms FROM e WHERE n = 1
      UNION ALL
      SELECT e.book_id, e.n, CASE WHEN p.cur + e.ms > 50400000 THEN e.ms ELSE p.cur + e.ms END,
        CASE WHEN p.cur + e.ms > 50400000 THEN p.part_no + 1 ELSE p.part_no END, e.ms
      FROM p JOIN e ON e.book_id = p.book_id AND e.n = p.n + 1)
    SELECT book_id, CAST(part_no AS BIGINT) AS part_no, count(*) AS n_episodes,
      CAST(sum(ms) AS BIGINT) AS total_ms FROM p GROUP BY 1, 2""")
def pack_parts_14h(spark, d):
    # A twentieth of the price: three quarters of an hour on average, some twenty to a part.
    episodes = _episodes(spark, d).withColumn("duration_s", F.col("duration_s") / 20)
    parts = pack_parts(episodes, ["book_id"], _ORDER, "duration_s")
    return parts.groupBy("book_id", "part_no").agg(
        F.count(F.lit(1)).alias("n_episodes"),
        F.sum(F.floor(F.col("duration_s") * 1000).cast("bigint")).alias("total_ms"))


# Orders are the parts of a customer's product, their lines the chapters inside a part.
_LINES = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("multipart_index", f"""
    SELECT o_custkey AS book_id, o_orderkey AS part, {', '.join(_LINES)},
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, {', '.join(_LINES)}) - 1
        AS chapter_index FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def multipart_index(spark, d):
    orders = V.read(spark, d, "orders").select(
        F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("part"))
    lines = V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("part"), *_LINES)
    return numbered(orders.join(lines, "part"), ["book_id"], ["part", *_LINES],
                    "chapter_index", start=0)


@query("multipart_group", r"""
    WITH f AS (SELECT 'c' || o_custkey AS dir, CASE o_orderstatus
        WHEN 'P' THEN 'track_' || o_orderkey || '.mp3'
        WHEN 'F' THEN 'Book_part' || o_orderkey || '.m4b'
        ELSE 'audiobook' || list_extract(['.m4b', '.mp3', '.wav'], CAST(o_orderkey % 3 AS INT) + 1)
        END AS name, o_orderkey FROM orders),
    g AS (SELECT dir, name, TRY_CAST(nullif(regexp_extract(name, '(?i)_part(\d+)\.[^.]*$', 1), '')
        AS BIGINT) AS part_no FROM f)
    SELECT dir, name, coalesce(part_no, 0) AS part_no, part_no IS NOT NULL AS multipart,
      CASE WHEN part_no IS NULL THEN name ELSE 'book.m4b' END AS grp,
      row_number() OVER (PARTITION BY dir, CASE WHEN part_no IS NULL THEN name ELSE 'book.m4b' END,
        part_no IS NULL ORDER BY part_no, name) AS part_index FROM g""")
def multipart_group(spark, d):
    return FS.multipart_files(V.output_files(spark, d))


@query("pick_by_priority", """
    WITH f AS (SELECT 'c' || o_custkey AS dir, CASE o_orderstatus
        WHEN 'P' THEN 'track_' || o_orderkey || '.mp3'
        WHEN 'F' THEN 'Book_part' || o_orderkey || '.m4b'
        ELSE 'audiobook' || list_extract(['.m4b', '.mp3', '.wav'], CAST(o_orderkey % 3 AS INT) + 1)
        END AS name FROM orders),
    r AS (SELECT *, CASE WHEN name = 'audiobook.m4b' THEN 0 WHEN name = 'audiobook.mp3' THEN 1
        WHEN name LIKE '%.m4b' THEN 2 WHEN name LIKE '%.mp3' THEN 3 END AS priority FROM f)
    SELECT dir, name, CAST(priority AS BIGINT) AS priority FROM (SELECT *, row_number() OVER (
      PARTITION BY dir ORDER BY priority, name) AS rn FROM r WHERE priority IS NOT NULL)
    WHERE rn = 1""")
def pick_by_priority(spark, d):
    return L.pick_by_priority(V.output_files(spark, d), L.audio_priority(F.col("name")))


_EXT = "list_extract(['.epub', '.pdf', '.txt', '.md', '.PDF'], CAST(p_partkey % 5 AS INT) + 1)"


@query("pick_source", f"""
    WITH f AS (SELECT 'brand ' || p_brand AS dir, p_name || {_EXT} AS name,
        CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE p_brand END AS book FROM part),
    r AS (SELECT dir, name, CASE WHEN lower(name) = lower(book) || '.epub' THEN 0
        WHEN lower(name) = lower(book) || '.pdf' THEN 1
        WHEN lower(name) = lower(book) || '.txt' THEN 2
        WHEN lower(name) LIKE '%.epub' THEN 3 WHEN lower(name) LIKE '%.pdf' THEN 4 END AS priority
        FROM f)
    SELECT dir, name, CAST(priority AS BIGINT) AS priority FROM (SELECT *, row_number() OVER (
      PARTITION BY dir ORDER BY priority, name) AS rn FROM r WHERE priority IS NOT NULL)
    WHERE rn = 1""")
def pick_source(spark, d):
    ext = F.element_at(F.array(*map(F.lit, (".epub", ".pdf", ".txt", ".md", ".PDF"))),
                       (F.col("p_partkey") % 5 + 1).cast("int"))
    files = V.read(spark, d, "part").select(
        F.concat(F.lit("brand "), "p_brand").alias("dir"), F.concat("p_name", ext).alias("name"),
        F.when(F.col("p_partkey") % 7 == 0, F.col("p_name")).otherwise(F.col("p_brand"))
        .alias("book"))
    return L.pick_by_priority(files, L.source_priority(F.col("name"), F.lower("book")))


# --- pairing, resuming, selecting -----------------------------------------------------------------

@query("pair_by_slug", """
    WITH s AS (SELECT c_name AS name, trim(regexp_replace(regexp_replace(replace(lower(c_name),
        ' ', '_'), '_+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_') AS slug FROM customer),
    o AS (SELECT DISTINCT 'customer' || lpad(CAST(o_custkey + 3 AS VARCHAR), 9, '0') AS slug
          FROM orders)
    SELECT slug, name, CASE WHEN name IS NULL THEN 'NO SOURCE' WHEN o.slug IS NULL
      THEN 'NO OUTPUT' ELSE 'PAIRED' END AS status FROM s FULL JOIN o USING (slug)""")
def pair_by_slug(spark, d):
    sources = V.read(spark, d, "customer").select(F.col("c_name").alias("name"))
    # Output folders are named three customers on, so both sides have rows without a partner.
    outputs = V.read(spark, d, "orders").select(F.concat(F.lit("customer"), F.lpad(
        (F.col("o_custkey") + 3).cast("string"), 9, "0")).alias("dir"))
    return L.pair_by_slug(sources, outputs)


@query("resume_remaining", """
    SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders
      WHERE o_orderstatus IN ('F', 'P'))""")
def resume_remaining(spark, d):
    done = V.read(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "P")).select(
        F.col("o_custkey").alias("c_custkey"))
    return L.remaining(V.read(spark, d, "customer").select("c_custkey"), done, "c_custkey")


@query("select_books", """
    SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'es')
      AND contains(lower(source), 'src1')""")
def select_books(spark, d):
    docs = V.read(spark, d, "documents").select("doc_id", "lang", "source")
    return L.select_books(docs, ("en", "es"), "SRC1", "source")


@query("merge_results", f"""
    WITH {cte(0, 'a_')}, {report_cte('a_')}, {cte()}, {report_cte()},
    old AS (SELECT book_id, matched, total_source FROM a_rep WHERE total_source % 2 = 0)
    SELECT * FROM old UNION ALL SELECT book_id, matched, total_source FROM rep
    WHERE book_id NOT IN (SELECT book_id FROM old)""")
def merge_results(spark, d):
    cols = ["book_id", "matched", "total_source"]
    old = reports(spark, d, 0).select(*cols).filter("total_source % 2 = 0")
    return L.merge_results(old, reports(spark, d).select(*cols), "book_id")
