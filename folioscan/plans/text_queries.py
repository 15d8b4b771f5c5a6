"""Cleaning, checking and cutting text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import segment as G
from ..functions import citations as C
from ..functions import text as X
from ..functions.html import heading_class
from ..operators import quality as Q
from ..operators.assemble import assemble, split_rows
from ..operators.long_texts import text_parts
from ..sources import tables as V
from . import sql as S
from .registry import query

DOCS = "FROM documents"


def _docs(spark, d):
    return V.spread(V.read(spark, d, "documents").select("doc_id", "lang", "source", "text"))


def _per_doc(name: str, column, sql: str, out: str = "result"):
    """A query that computes one value per document."""
    @query(name, f"SELECT doc_id, {sql} AS {out} {DOCS}")
    def run(spark, d):
        return _docs(spark, d).select("doc_id", column(F.col("text")).alias(out))


_per_doc("clean_text", X.clean_speech, S.clean_speech("text"), "cleaned")
_per_doc("clean_citations", C.clean_citations, S.clean_citations("text"), "cleaned")
_per_doc("snippet_words", X.snippet, S.joined(f"list_slice({S.words('text')}, 1, 100)"),
         "snippet")
_per_doc("normalize_words", lambda c: F.array_join(X.spoken_words(c), " "),
         S.joined(S.spoken("text")), "normalized")
_per_doc("mojibake_ratio", X.mojibake_ratio, S.ratio("text", S.MOJIBAKE), "ratio")
_per_doc("whitespace_ratio", X.whitespace_ratio, S.ratio("text", S.SPACES), "ratio")
_per_doc("nonword_ratio", X.nonword_ratio, S.ratio("text", S.NONWORD), "ratio")


@query("citation_counts", "SELECT doc_id, " + ", ".join(
    f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS {n}"
    for n, p in K.CITATIONS.items()) + f" {DOCS}")
def citation_counts(spark, d):
    counts = C.citation_counts(F.col("text"))
    return _docs(spark, d).select("doc_id", *[c.alias(n) for n, c in counts.items()])


@query("slugify", f"SELECT doc_id, {S.slug(S.title('text'))} AS slug {DOCS}")
def slugify(spark, d):
    return _docs(spark, d).select(
        "doc_id", X.slug(X.first_sentence_title(F.col("text"))).alias("slug"))


_REPLY = ("CASE WHEN conv_id % 2 = 0 THEN '<think>' || text || '</think> ' || text "
          "ELSE text END")


@query("strip_reasoning", f"""
    WITH r AS (SELECT conv_id, turn, {_REPLY} AS reply FROM conversations)
    SELECT conv_id, turn,
      {S.clean_speech("CASE WHEN contains(lower(reply), 'think') THEN "
                      "list_extract(string_split(reply, '</think>'), -1) ELSE reply END")}
        AS said,
      {S.strip("regexp_replace(reply, '(?is)<think>.*?</think>', '', 'g')")} AS kept FROM r""")
def strip_reasoning(spark, d):
    reply = F.when(F.col("conv_id") % 2 == 0, F.concat(
        F.lit("<think>"), "text", F.lit("</think> "), "text")).otherwise(F.col("text"))
    return V.turns(spark, d).select(
        "conv_id", "turn", X.after_reasoning(reply).alias("said"),
        X.without_reasoning(reply).alias("kept"))


@query("title_display", rf"""
    WITH t AS (SELECT conv_id, turn, regexp_extract(text, '(?s)\A(.*?\n?[^.]*)', 1) AS raw
               FROM conversations),
    c AS (SELECT conv_id, turn, replace(replace(raw, chr(10), ' '), chr(13), '') AS title FROM t)
    SELECT conv_id, turn, title,
      CASE WHEN length(title) > 50 THEN left(title, 47) || '...' ELSE title END AS display
    FROM c""")
def title_display(spark, d):
    raw = F.regexp_extract("text", r"(?s)\A(.*?\n?[^.]*)", 1)
    return V.turns(spark, d).select("conv_id", "turn", X.marker_title(raw).alias("title")
                                    ).withColumn("display", X.short_title(F.col("title")))


@query("text_quality_verdict", f"""
    SELECT lang, {S.reason('text')} AS reason, count(*) AS n_chapters,
      CAST(sum(length(text)) AS BIGINT) AS n_chars {DOCS} GROUP BY ALL""")
def text_quality_verdict(spark, d):
    return Q.quality_summary(_docs(spark, d), "lang")


@query("text_quality_rows", f"""
    SELECT doc_id, {S.reason('text')} AS reason,
      CASE WHEN {S.reason('text')} = 'clean' THEN 'clean' ELSE 'garbage' END AS verdict {DOCS}""")
def text_quality_rows(spark, d):
    return Q.text_quality(_docs(spark, d)).select("doc_id", "reason", "verdict")


@query("min_content", f"SELECT doc_id, length(text) AS n_chars {DOCS} WHERE length(text) >= 100")
def min_content(spark, d):
    n = F.length("text").cast("bigint")
    return _docs(spark, d).filter(n >= K.MIN_CONTENT_CHARS).select("doc_id", n.alias("n_chars"))


@query("contains_cjk", rf"""
    SELECT doc_id, regexp_matches(text, '[{K.CJK_RANGES}]') AS plain,
      regexp_matches(translate(text, 'ae', '一。'), '[{K.CJK_RANGES}]') AS folded {DOCS}""")
def contains_cjk(spark, d):
    return _docs(spark, d).select(
        "doc_id", G.contains_cjk(F.col("text")).alias("plain"),
        G.contains_cjk(F.translate("text", "ae", "一。")).alias("folded"))


@query("book_word_count", f"""
    SELECT source AS book_id, CAST(sum(len({S.words('text')})) AS BIGINT) AS n_words {DOCS}
    GROUP BY ALL""")
def book_word_count(spark, d):
    return _docs(spark, d).groupBy(F.col("source").alias("book_id")).agg(
        F.sum(X.word_count(F.col("text"))).alias("n_words"))


# --- cutting and packing ----------------------------------------------------------------------

@query("split_sentences", f"""
    WITH p AS (SELECT doc_id, {S.sentences('text')} AS parts {DOCS}) {S.exploded('p')}""")
def split_sentences(spark, d):
    return split_rows(_docs(spark, d), G.sentences(F.col("text")), "piece", "doc_id")


@query("split_long_sentences", f"""
    WITH s AS (SELECT doc_id, {S.sentences('text')} AS s {DOCS}),
    u AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM s),
    w AS (SELECT doc_id, i, {S.words('x')} AS w FROM u),
    f AS (SELECT doc_id, i, {S._fold('w', "''",
          "CASE WHEN length(a.cur) + length(e.cur) > 60 "
          "THEN {'done': list_append(a.done, trim(a.cur)), 'cur': e.cur || ' '} "
          "ELSE {'done': a.done, 'cur': a.cur || e.cur || ' '} END")} AS f FROM w),
    p AS (SELECT doc_id, flatten(list(list_append(f.done, trim(f.cur)) ORDER BY i)) AS parts
          FROM f GROUP BY doc_id)
    {S.exploded('p')}""")
def split_long_sentences(spark, d):
    pieces = G.split_long(G.sentences(F.col("text")), 60)
    return split_rows(_docs(spark, d), pieces, "piece", "doc_id")


_FOLD_FROM = "abcdefghijklmnopqrstuvwxyz ."
_FOLD_TO = "一乙丁七乃九了二人儿入八几刀力十又三干于亏士土工才寸。。"


@query("split_cjk", f"""
    WITH RECURSIVE t AS (SELECT doc_id,
        translate(lower(text), '{_FOLD_FROM}', '{_FOLD_TO}') AS body {DOCS}),
    cut AS (
      SELECT doc_id, 0 AS pos, CAST('' AS VARCHAR) AS piece, body AS rest FROM t
      UNION ALL
      SELECT doc_id, pos + 1, {S.strip('left(rest, k)')}, substr(rest, k + 1) FROM (
        SELECT doc_id, pos, rest, CASE WHEN length(rest) <= 60 THEN length(rest)
            WHEN stop > 0 THEN 48 + stop ELSE 60 END AS k FROM (
          SELECT doc_id, pos, rest, length(regexp_extract(substr(rest, 49, 12),
            '(?s)\\A(.*[{K.LOOKBACK_PUNCT}])', 1)) AS stop FROM cut WHERE length(rest) > 0)))
    SELECT doc_id, CAST(pos AS BIGINT) AS pos, piece FROM cut WHERE pos > 0""")
def split_cjk(spark, d):
    body = F.translate(F.lower("text"), _FOLD_FROM, _FOLD_TO)
    return split_rows(_docs(spark, d), G.split_at_chars(body, 60), "piece", "doc_id")


@query("merge_short_sentences", f"""
    WITH s AS (SELECT doc_id, {S.sentences('text')} AS s {DOCS}),
    m AS (SELECT doc_id, {S.merge_short('s', 20)} AS m FROM s),
    p AS (SELECT doc_id, {S.closed('m')} AS parts FROM m) {S.exploded('p')}""")
def merge_short_sentences(spark, d):
    pieces = G.merge_short(G.sentences(F.col("text")), K.MIN_SENTENCE)
    return split_rows(_docs(spark, d), pieces, "piece", "doc_id")


@query("sentence_pipeline", f"""
    WITH {S.pieces_cte()}
    SELECT doc_id, CAST(pos AS BIGINT) AS pos, sentence FROM spoken""")
def sentence_pipeline(spark, d):
    return split_rows(_docs(spark, d), G.sentence_pipeline(F.col("text")), "sentence", "doc_id")


@query("pack_segments_200", f"""
    WITH {S.pieces_cte()},
    g AS (SELECT doc_id, list(sentence ORDER BY pos) AS s FROM spoken GROUP BY doc_id),
    f AS (SELECT doc_id, {S.pack('s', '200')} AS f FROM g),
    p AS (SELECT doc_id, list_filter(list_transform({S.closed('f')}, lambda x: trim(x)),
            lambda x: length(x) > 0) AS parts FROM f)
    {S.exploded('p', value='segment')}""")
def pack_segments_200(spark, d):
    return split_rows(_docs(spark, d), G.segments(F.col("text")), "segment", "doc_id")


def _batch_cte(limit: str, size: str, parts: str = "spoken", tag: str = "") -> str:
    """CTE ``batches``: sentences packed under a limit, oversized ones cut at words alone."""
    step = (
        f"CASE WHEN {size}(e.cur) > {limit} THEN {{'done': list_concat(CASE WHEN a.cur IS NULL "
        "THEN a.done ELSE list_append(a.done, a.cur) END, e.done), 'cur': CAST(NULL AS VARCHAR)} "
        f"WHEN a.cur IS NULL OR {size}(a.cur || ' ' || e.cur) <= {limit} "
        "THEN {'done': a.done, 'cur': coalesce(a.cur || ' ' || e.cur, e.cur)} "
        "ELSE {'done': list_append(a.done, a.cur), 'cur': e.cur} END")
    start = S.STATE % "CAST(NULL AS VARCHAR)"
    return f"""
    w{tag} AS (SELECT doc_id, pos, sentence, CASE WHEN {size}(sentence) > {limit}
             THEN {S.pack(S.words('sentence'), limit, size)} END AS o FROM {parts}),
    i{tag} AS (SELECT doc_id, list({{'done': CASE WHEN o IS NULL THEN CAST([] AS VARCHAR[])
             ELSE list_append(o.done, o.cur) END, 'cur': sentence}} ORDER BY pos) AS items
           FROM w{tag} GROUP BY doc_id),
    b{tag} AS (SELECT doc_id, list_reduce(list_concat([{start}], items),
             lambda a, e: {step}) AS f FROM i{tag}),
    batches{tag} AS (SELECT doc_id, {S.closed('f')} AS parts FROM b{tag})"""


@query("pack_batches_chars", f"""
    WITH {S.pieces_cte()}, {_batch_cte('300', 'length')}
    {S.exploded('batches', value='batch')}""")
def pack_batches_chars(spark, d):
    b = G.batches(G.sentence_pipeline(F.col("text")), 300, "chars")
    return split_rows(_docs(spark, d), b, "batch", "doc_id")


@query("pack_batches_bytes", f"""
    WITH {S.pieces_cte()}, {_batch_cte('300', 'strlen')}
    {S.exploded('batches', value='batch')}""")
def pack_batches_bytes(spark, d):
    b = G.batches(G.sentence_pipeline(F.col("text")), 300, "bytes")
    return split_rows(_docs(spark, d), b, "batch", "doc_id")


_CAND = "(CASE WHEN a.cur = '' THEN e.cur ELSE a.cur || ' ' || e.cur END)"
_FLUSH = "(CASE WHEN a.cur = '' THEN a.done ELSE list_append(a.done, a.cur) END)"


@query("split_oversized", f"""
    WITH s AS (SELECT doc_id, {S.sentences('text')} AS s {DOCS}),
    u AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS sentence_no FROM s),
    w AS (SELECT doc_id, sentence_no, {S.words('x')} AS w FROM u),
    f AS (SELECT doc_id, sentence_no, list_reduce(list_concat([{S.STATE % "''"}],
        list_transform(w, lambda v: {{'done': CASE WHEN length(v) > 12 THEN
            list_transform(range(0, length(v), 12), lambda k: substr(v, k + 1, 12))
            ELSE CAST([] AS VARCHAR[]) END, 'cur': v}})),
        lambda a, e: CASE WHEN length({_CAND}) <= 12 THEN {{'done': a.done, 'cur': {_CAND}}}
          WHEN length(e.cur) > 12 THEN {{'done': list_concat({_FLUSH}, e.done), 'cur': ''}}
          ELSE {{'done': {_FLUSH}, 'cur': e.cur}} END) AS f FROM w),
    p AS (SELECT doc_id, sentence_no, CASE WHEN f.cur = '' THEN f.done
            ELSE list_append(f.done, f.cur) END AS parts FROM f)
    SELECT doc_id, CAST(sentence_no AS BIGINT) AS sentence_no,
      CAST(generate_subscripts(parts, 1) AS BIGINT) AS pos, unnest(parts) AS piece FROM p""")
def split_oversized(spark, d):
    rows = split_rows(_docs(spark, d), G.sentences(F.col("text")), "s", "doc_id"
                      ).withColumnRenamed("pos", "sentence_no")
    return split_rows(rows, G.split_oversized(F.col("s"), 12), "piece", "doc_id", "sentence_no")


@query("split_oversized_bytes")
def split_oversized_bytes(spark, d):
    rows = split_rows(_docs(spark, d), G.sentences(F.col("text")), "s", "doc_id"
                      ).withColumnRenamed("pos", "sentence_no")
    return split_rows(rows, G.split_oversized(F.col("s"), 12, "bytes"), "piece",
                      "doc_id", "sentence_no")


@query("chunk_paragraphs", rf"""
    WITH p0 AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)),
        lambda x: {S.strip('x')}), lambda x: length(x) > 0) AS ps {DOCS}),
    p1 AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM p0),
    p2 AS (SELECT doc_id, i, {S.words('p')} AS w FROM p1),
    items AS (SELECT doc_id, list({{'done': CASE WHEN len(w) > 100 THEN list_transform(
          range(0, len(w), 100), lambda k: {S.joined('list_slice(w, k + 1, k + 100)')})
          ELSE CAST([] AS VARCHAR[]) END, 'cur': w}} ORDER BY i) AS items FROM p2 GROUP BY doc_id),
    f AS (SELECT doc_id, list_reduce(list_concat([{{'done': CAST([] AS VARCHAR[]),
          'cur': CAST([] AS VARCHAR[])}}], items), lambda a, e:
        CASE WHEN len(e.cur) > 100 THEN {{'done': list_concat(CASE WHEN len(a.cur) = 0
               THEN a.done ELSE list_append(a.done, {S.joined('a.cur')}) END, e.done),
               'cur': CAST([] AS VARCHAR[])}}
          WHEN len(a.cur) + len(e.cur) > 100 THEN {{'done': CASE WHEN len(a.cur) = 0
               THEN a.done ELSE list_append(a.done, {S.joined('a.cur')}) END, 'cur': e.cur}}
          ELSE {{'done': a.done, 'cur': list_concat(a.cur, e.cur)}} END) AS f FROM items),
    p AS (SELECT d.doc_id, CASE WHEN len({S.words('d.text')}) <= 100 THEN [d.text]
        WHEN len(f.cur) = 0 THEN f.done ELSE list_append(f.done, {S.joined('f.cur')}) END AS parts
        FROM documents d JOIN f USING (doc_id))
    {S.exploded('p', value='chunk')}""")
def chunk_paragraphs(spark, d):
    # Documents separate paragraphs by one line break, so that is the blank line here.
    c = G.chunk_paragraphs(F.col("text"), 100, "\n")
    return split_rows(_docs(spark, d), c, "chunk", "doc_id")


_FIXED = (f"list_transform(range(0, len({S.words('text')}), 2500), lambda k: "
          f"{S.joined('list_slice(' + S.words('text') + ', k + 1, k + 2500)')})")


@query("chunk_fixed_words", f"""
    WITH p AS (SELECT doc_id, {_FIXED} AS parts {DOCS}) {S.exploded('p', value='chunk')}""")
def chunk_fixed_words(spark, d):
    return split_rows(_docs(spark, d), G.chunk_fixed(F.col("text")), "chunk", "doc_id")


@query("chunk_token_overflow", f"""
    WITH p AS (SELECT doc_id, {_FIXED} AS parts {DOCS}), e AS ({S.exploded('p', value='chunk')})
    SELECT doc_id, pos, length(chunk) / 4 AS estimated_tokens,
      length(chunk) / 4 > (4096 - 512) * 0.9 AS overflows FROM e""")
def chunk_token_overflow(spark, d):
    # A model with a small window, so that some chunks do overflow.
    rows = split_rows(_docs(spark, d), G.chunk_fixed(F.col("text")), "chunk", "doc_id")
    return rows.select("doc_id", "pos", (F.length("chunk") / 4).alias("estimated_tokens"),
                       G.token_overflow(F.col("chunk"), 4096, 512).alias("overflows"))


@query("reassemble_chunks", f"""
    SELECT doc_id, {S.joined(S.words('text'))} AS text,
      CAST(ceil(len({S.words('text')}) / 50) AS BIGINT) AS n_pieces {DOCS}""")
def reassemble_chunks(spark, d):
    chunks = split_rows(_docs(spark, d), G.chunk_fixed(F.col("text"), 50), "text", "doc_id")
    return assemble(chunks, ["doc_id"], ["pos"], "text", " ")


@query("language_volumes", f"""
    WITH b AS (SELECT lang, doc_id, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY lang ORDER BY doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before {DOCS} WHERE text IS NOT NULL)
    SELECT lang, min(before) AS start, count(*) AS n_pieces,
      CAST(length(string_agg(text, chr(10) ORDER BY doc_id)) AS BIGINT) AS n_chars,
      sha256(string_agg(text, chr(10) ORDER BY doc_id)) AS text_sha256
    FROM b GROUP BY lang, before // 100000""")
def language_volumes(spark, d):
    # All texts of a language, far longer than a value should be, as parts.
    docs = _docs(spark, d).select("lang", "doc_id", "text")
    return text_parts(docs, ["lang"], ["doc_id"], "text", "\n", 100_000).select(
        "lang", "start", "n_pieces", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


_HEADING_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(line, '(?{'i' if n in K.CASELESS_HEADINGS else ''}s)\\A(?:{p})') "
    f"THEN '{n}'" for n, p in K.HEADING_PATTERNS.items()) + " ELSE 'none' END"
_HEAD = ("list_extract(['Chapter ', 'PART ', 'IX. ', 'Prologue: ', 'The ', 'Chapter Two - '], "
         "CAST(doc_id % 6 AS INT) + 1) || ")


@query("heading_class", rf"""
    WITH h AS (SELECT doc_id, {_HEAD}
        CASE WHEN doc_id % 6 < 2 THEN CAST(doc_id AS VARCHAR) || ': ' ELSE '' END ||
        {S.title('text')} AS line {DOCS}
      UNION ALL SELECT doc_id, CAST(doc_id AS VARCHAR) || '. ' || {S.title('text')} {DOCS})
    SELECT doc_id, line, {_HEADING_CASE} AS heading FROM h""")
def heading(spark, d):
    title = X.first_sentence_title(F.col("text"))
    lead = F.element_at(F.array(*[F.lit(x) for x in (
        "Chapter ", "PART ", "IX. ", "Prologue: ", "The ", "Chapter Two - ")]),
        (F.col("doc_id") % 6 + 1).cast("int"))
    number = F.when(F.col("doc_id") % 6 < 2, F.concat(
        F.col("doc_id").cast("string"), F.lit(": "))).otherwise("")
    docs = _docs(spark, d)
    lines = docs.select("doc_id", F.explode(F.array(
        F.concat(lead, number, title),
        F.concat(F.col("doc_id").cast("string"), F.lit(". "), title))).alias("line"))
    return lines.withColumn("heading", heading_class(F.col("line")))
