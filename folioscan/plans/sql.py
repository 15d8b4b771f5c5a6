"""SQL fragments shared by the oracles. DuckDB dialect, RE2 patterns."""

from __future__ import annotations

from ..functions import fixed as K

BLANKS = "' ' || chr(10)"
ENDS = f"[{K.SENTENCE_END}]"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def words(x: str) -> str:
    return rf"regexp_extract_all({x}, '\S+')"


def n_words(x: str) -> str:
    return f"CAST(len({words(x)}) AS BIGINT)"


def spoken(x: str) -> str:
    return (rf"regexp_extract_all(lower({x}), "
            r"'[\p{L}\p{N}_](?:[\p{L}\p{N}_'']*[\p{L}\p{N}_])?')")


def joined(ws: str) -> str:
    return f"array_to_string({ws}, ' ')"


def clean_speech(x: str) -> str:
    c = f"replace({squeeze(x)}, '@', 'a')"
    c = rf"regexp_replace({c}, ' ([.,!?;:¿¡-])', '\1', 'g')"
    c = f"replace(replace({c}, '<<', '\"'), '>>', '\"')"
    c = f"regexp_replace(regexp_replace({c}, '<[^>]*>', '', 'g'), ' +', ' ', 'g')"
    return rf"trim(regexp_replace({c}, '([.,!?;:¿¡]){{2,}}', '\1', 'g'))"


# A tag: the sign and a letter; quoted values may hold ">".
TAG = """</?[A-Za-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
HIDDEN = "(?is)<!--.*?(?:-->|\\z)|" + "".join(
    rf"<{n}\b[^>]*>.*?(?:</{n}\s*>|\z)|" for n in ("script", "style", "template")) + "<[!?][^>]*>"


def entities(x: str) -> str:
    """Decode the references that occur in the tables, "&amp;" last."""
    c = f"replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"')"
    # A reference cut off before its semicolon still counts.
    return f"regexp_replace({c}, '&amp;?', '&', 'g')"


def tagless(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, '{HIDDEN}', '', 'g'), '{TAG}', '', 'g')"
    return entities(bare)


def clean_citations(x: str) -> str:
    """Without the three reference-list patterns: RE2 has no look-ahead, and no document holds
    such a heading on a line of its own."""
    c = f"CASE WHEN regexp_matches({x}, '<[^>]+>') THEN {tagless(x)} ELSE {x} END"
    for p in K.CITATIONS.values():
        c = f"regexp_replace({c}, '{p}', '', 'g')"
    return squeeze(f"regexp_replace({c}, '(?mi){K.CAPTION}', '', 'g')")


def title(x: str) -> str:
    first = rf"regexp_extract({x}, '(?s)\A(.*?(?:{ENDS}|\z))', 1)"
    return squeeze(first)


def slug(x: str) -> str:
    c = f"trim(regexp_replace(replace(lower({x}), ' ', '_'), '_+', '_', 'g'), '_')"
    c = f"translate({c}, '{K.ACCENTS}', '{K.ACCENTS_PLAIN}')"
    return f"trim(regexp_replace({c}, '[^a-z0-9_]', '', 'g'), '_')"


def ratio(x: str, cls: str) -> str:
    return (f"CASE WHEN length({x}) > 0 THEN (length({x}) - "
            f"length(regexp_replace({x}, '{cls}', '', 'g'))) / length({x}) END")


MOJIBAKE = r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x80-\x9F]"
SPACES = r"[ \t\n\r]"
NONWORD = r"[^\p{L}\p{N} \t\n\r]"


def reason(x: str) -> str:
    ws = ratio(x, SPACES)
    return (f"CASE WHEN length({strip(x)}) < 10 THEN 'empty' "
            f"WHEN {ratio(x, MOJIBAKE)} > 0.10 THEN 'mojibake' "
            f"WHEN {ws} < 0.05 OR {ws} > 0.70 THEN 'whitespace' "
            f"WHEN {ratio(x, NONWORD)} > 0.30 THEN 'nonword' ELSE 'clean' END")


def sentences(x: str) -> str:
    marked = rf"regexp_replace({x}, '({ENDS})\s*', '\1' || chr(1), 'g')"
    return (f"list_filter(string_split({marked}, chr(1)), "
            f"lambda s: length({strip('s')}) > 0)")


STATE = "{'done': CAST([] AS VARCHAR[]), 'cur': %s}"


def _fold(items: str, first: str, step: str) -> str:
    """Left fold over strings; ``a`` is the state, ``e.cur`` the item."""
    start = f"[{STATE % first}]"
    rows = f"list_transform({items}, lambda v: {STATE % 'v'})"
    return f"list_reduce(list_concat({start}, {rows}), lambda a, e: {step})"


def split_words(x: str, limit: int) -> str:
    """An over-long sentence cut at words: a list."""
    flat = joined(words(x))
    fold = _fold(words(x), "''", (
        f"CASE WHEN length(a.cur) + length(e.cur) > {limit} "
        "THEN {'done': list_append(a.done, trim(a.cur)), 'cur': e.cur || ' '} "
        "ELSE {'done': a.done, 'cur': a.cur || e.cur || ' '} END"))
    return (f"CASE WHEN length({flat}) <= {limit} THEN [{flat}] "
            f"ELSE (SELECT list_append(f.done, trim(f.cur)) FROM (SELECT {fold} AS f)) END")


def merge_short(items: str, least: int) -> str:
    return _fold(items, "CAST(NULL AS VARCHAR)", (
        f"CASE WHEN length(e.cur) < {least} "
        "THEN {'done': a.done, 'cur': a.cur || ' ' || e.cur} "
        "ELSE {'done': CASE WHEN a.cur IS NULL THEN a.done ELSE list_append(a.done, a.cur) END, "
        "'cur': e.cur} END"))


def pack(items: str, limit: str, size: str = "length") -> str:
    cand = "(CASE WHEN a.cur = '' THEN e.cur ELSE a.cur || ' ' || e.cur END)"
    return _fold(items, "''", (
        f"CASE WHEN a.cur = '' OR {size}({cand}) <= {limit} "
        f"THEN {{'done': a.done, 'cur': {cand}}} "
        "ELSE {'done': list_append(a.done, a.cur), 'cur': e.cur} END"))


def closed(state: str) -> str:
    """Final list of a fold that ends with an open item."""
    return (f"CASE WHEN {state}.cur IS NULL THEN {state}.done "
            f"ELSE list_append({state}.done, {state}.cur) END")


def pieces_cte(longest: int = K.MAX_SENTENCE, least: int = K.MIN_SENTENCE,
               source: str = "documents", key: str = "doc_id") -> str:
    """CTEs ending in ``spoken(doc_id, pos, sentence)``, the whole sentence pipeline."""
    return f"""
    s0 AS (SELECT {key} AS doc_id, {sentences('text')} AS s FROM {source}),
    s1 AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM s0),
    s2 AS (SELECT doc_id, i, {joined(words('x'))} AS flat, {words('x')} AS w FROM s1),
    s3 AS (SELECT doc_id, i, CASE WHEN length(flat) <= {longest - least} THEN NULL ELSE
             {_fold('w', "''",
                    f"CASE WHEN length(a.cur) + length(e.cur) > {longest - least} "
                    "THEN {'done': list_append(a.done, trim(a.cur)), 'cur': e.cur || ' '} "
                    "ELSE {'done': a.done, 'cur': a.cur || e.cur || ' '} END")} END AS f, flat
           FROM s2),
    s4 AS (SELECT doc_id, i, CASE WHEN f IS NULL THEN [flat]
             ELSE list_append(f.done, trim(f.cur)) END AS parts FROM s3),
    s5 AS (SELECT doc_id, flatten(list(parts ORDER BY i)) AS parts FROM s4 GROUP BY doc_id),
    s6 AS (SELECT doc_id, {merge_short('parts', least)} AS m FROM s5),
    s7 AS (SELECT doc_id, {closed('m')} AS parts FROM s6),
    spoken AS (SELECT doc_id, generate_subscripts(parts, 1) AS pos,
                 {clean_speech('unnest(parts)')} AS sentence FROM s7)"""


def exploded(cte: str, key: str = "doc_id", value: str = "piece") -> str:
    return (f"SELECT {key}, CAST(generate_subscripts(parts, 1) AS BIGINT) AS pos, "
            f"unnest(parts) AS {value} FROM {cte}")


def half_up(x: str, digits: int) -> str:
    scale = f"{10 ** digits}.0::DOUBLE"
    return f"floor(({x}) * {scale} + 0.5) / {scale}"


def fixed2(x: str) -> str:
    v = f"CAST(floor(({x}) * 100.0::DOUBLE + 0.5) AS BIGINT)"
    return f"(CAST({v} // 100 AS VARCHAR) || '.' || lpad(CAST({v} % 100 AS VARCHAR), 2, '0'))"
