"""SQL twins of the queries in ``reference``, for DuckDB on the same tables.

Written from the operators' definitions, with the fixed values of
``reference_values``; nothing is taken from the operators' modules.
"""

from __future__ import annotations

from quern.plans import reference_values as v

_W = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_NL2 = "chr(10) || chr(10)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(words) -> str:
    return ", ".join(map(q, words))


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^[{_W}]+|[{_W}]+$', '', 'g')"


def tokens(e: str) -> str:
    return f"greatest(1, CAST(floor(len(regexp_extract_all(coalesce({e}, ''), '[^{_W}]+')) * 1.3e0) AS BIGINT))"


def clean(e: str) -> str:
    a = f"regexp_replace({e}, '\\r\\n?', chr(10), 'g')"
    b = f"replace({a}, chr(160), ' ')"
    c = f"regexp_replace(regexp_replace({b}, '[ \\t\\x0b\\f]+(\\n)', '\\1', 'g'), '[ \\t\\x0b\\f]+$', '', 'g')"
    return strip(f"regexp_replace({c}, '\\n{{4,}}', chr(10) || {_NL2}, 'g')")


def grounding(e: str) -> str:
    return strip(f"regexp_replace(regexp_replace(lower(coalesce({e}, '')), '[^\\p{{L}}\\p{{N}}_{_W}]', '', 'g'), '[{_W}]+', ' ', 'g')")


def token_list(e: str) -> str:
    return f"regexp_extract_all(lower({e}), '[\\p{{L}}\\p{{N}}_]+')"


def key(e: str, noise, none: str, empty: str) -> str:
    kept = f"list_filter({token_list(e)}, lambda w: w NOT IN ({names(noise)}))" if noise else token_list(e)
    joined = f"array_to_string(list_sort(list_distinct({kept})), '_')"
    return f"CASE WHEN {e} IS NULL OR {e} = '' THEN {q(none)} WHEN {joined} = '' THEN {q(empty)} ELSE {joined} END"


ENTITY_KEY = key("entity_raw", v.LEGAL_NOISE, "unknown_entity", "entity")
ATTRIBUTE_KEY = key("attribute_raw", (), "general_attribute", "attribute")


def ascii_digits(e: str) -> str:
    return f"translate({e}, '०१२३४५६७८९', '0123456789')"


def value_unit() -> tuple[str, str]:
    value = strip("coalesce(raw_value, '')")
    both = f"lower({value} || ' ' || {strip('coalesce(canonical_unit, ' + q('') + ')')})"
    money = " ".join(f"WHEN contains({both}, {q(m)}) THEN {q(c)}" for m, c in v.CURRENCY_MARKS)
    percent = " OR ".join(f"contains({both}, {q(m)})" for m in v.PERCENT_MARKS)
    digits = f"regexp_replace(replace({ascii_digits(value)}, ',', ''), '[^0-9.\\-]', ' ', 'g')"
    number = f"TRY_CAST(nullif(regexp_extract({digits}, '[-+]?[0-9]*\\.?[0-9]+'), '') AS DOUBLE)"
    # digits of any script are letters to a word boundary
    word = f"regexp_extract({ascii_digits(both)}, '\\b({'|'.join(v.MULTIPLIERS)})\\b', 1)"
    scale = "CASE " + word + " " + " ".join(f"WHEN {q(k)} THEN {n:.1f}e0" for k, n in v.MULTIPLIERS.items()) + " ELSE 1e0 END"
    return (
        f"CASE WHEN {value} <> '' THEN {number} * {scale} END",
        f"CASE WHEN {value} = '' THEN 'RAW' WHEN {percent} THEN 'PERCENT' {money} ELSE 'COUNT' END",
    )


VALUE, UNIT = value_unit()


def year(e: str) -> str:
    n = f"TRY_CAST(nullif({e}, '') AS INTEGER)"
    return f"CASE WHEN {n} < 100 THEN {n} + 2000 ELSE {n} END"


def stated(source: str) -> str:
    """CTEs ending in ``p`` (all columns of ``source`` with start_date2, end_date2, granularity2)."""
    low = f"lower({strip('temporal_raw')})"
    fiscal = f"(f1 <> '' AND (contains({low}, 'fy') OR contains({low}, 'fiscal') OR contains({low}, '-')))"
    cal = f"(cal <> '' AND (contains({low}, 'cy') OR length(cal) = 4))"
    blank = f"(temporal_raw IS NULL OR temporal_raw = '' OR {low} IN ({names(v.PERPETUAL_TEXTS)}))"
    day = "regexp_replace(regexp_replace(regexp_replace(t, '(?i)^(?:as of|dated|ended)\\s+', ''), '(?i)([0-9])(?:st|nd|rd|th)\\b', '\\1', 'g'), '\\s+', ' ', 'g')"
    formats = "['%B %-d, %Y', '%b %-d, %Y', '%-d %B %Y', '%-d %b %Y', '%B %-d %Y', '%b %-d %Y']"
    shape = "regexp_full_match(d, '(?i)[0-9]{1,2} [a-z]+ [0-9]{4}|[a-z]+ [0-9]{1,2},? [0-9]{4}')"
    q_start = "CASE qq WHEN '1' THEN y0 || '-04-01' WHEN '2' THEN y0 || '-07-01' WHEN '3' THEN y0 || '-10-01' ELSE y1 || '-01-01' END"
    q_end = "CASE qq WHEN '1' THEN y0 || '-06-30' WHEN '2' THEN y0 || '-09-30' WHEN '3' THEN y0 || '-12-31' ELSE y1 || '-03-31' END"
    pick = lambda a, b, c, d, e: f"CASE WHEN blank THEN {a} WHEN fiscal AND qq <> '' THEN {b} WHEN fiscal THEN {c} WHEN calendar THEN {d} WHEN iso IS NOT NULL THEN {e} END"
    return f"""a AS (SELECT *, {strip('temporal_raw')} AS t, {ascii_digits(strip('temporal_raw'))} AS n FROM {source}),
b AS (SELECT *, regexp_extract(n, '([0-9]{{2,4}})(?:[-/]([0-9]{{2,4}}))?', 1) AS f1, regexp_extract(n, '([0-9]{{2,4}})(?:[-/]([0-9]{{2,4}}))?', 2) AS f2,
  regexp_extract(n, '(?i)Q([1-4])', 1) AS qq, regexp_extract(n, '(?i)^(?:CY\\s*)?([0-9]{{2,4}})$', 1) AS cal, {day} AS d FROM a),
c AS (SELECT *, {blank} AS blank, {fiscal} AS fiscal, {cal} AS calendar, CASE WHEN {shape} THEN strftime(try_strptime(d, {formats}), '%Y-%m-%d') END AS iso,
  {year('f1')} AS g1, TRY_CAST(nullif(f2, '') AS INTEGER) AS g2 FROM b),
e AS (SELECT *, CASE WHEN f2 = '' THEN g1 WHEN g2 < 100 THEN (g1 // 100) * 100 + g2 ELSE g2 END AS y1, CASE WHEN f2 = '' THEN g1 - 1 ELSE g1 END AS y0, {year('cal')} AS yc FROM c),
p AS (SELECT *, {pick('NULL', q_start, "y0 || '-04-01'", "yc || '-01-01'", 'iso')} AS start_date2,
  {pick('NULL', q_end, "y1 || '-03-31'", "yc || '-12-31'", 'iso')} AS end_date2,
  coalesce({pick("'PERPETUAL'", "'QUARTER'", "'YEAR'", "'YEAR'", "'EXACT_DATE'")}, 'UNKNOWN') AS granularity2 FROM e)"""


def periods(where: str) -> str:
    out = "{0} AS {1}".format
    return (
        f"WITH s AS (SELECT DISTINCT temporal_raw FROM facts), {stated('s')} SELECT {out('temporal_raw', 'temporal_raw')}, {out('start_date2', 'start_date')}, "
        f"{out('end_date2', 'end_date')}, granularity2 AS granularity FROM p WHERE {where}"
    )


def extracted(e: str) -> str:
    t = strip(f"regexp_replace({e}, '₹|\\$|Rs\\.?|INR|,', '', 'g')")
    has = lambda p: f"regexp_matches({t}, '(?i)\\b(?:{p})\\b')"
    scale = "CASE " + " ".join(f"WHEN {has(p)} THEN {n:.1f}e0" for p, n in v.EXTRACTED_SCALES) + " ELSE 1e0 END"
    bare = "CASE " + " ".join(f"WHEN {has(p)} THEN regexp_replace({t}, '(?i)\\b(?:{p})\\b', '', 'g')" for p, _ in v.EXTRACTED_SCALES) + f" WHEN ends_with({t}, '%') THEN replace({t}, '%', '') ELSE {t} END"
    number = strip(f"regexp_replace({strip(bare)}, '^[>~<]+', '')")
    return f"CASE WHEN regexp_full_match({number}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({number} AS DOUBLE) END * {scale}"


PAGES = (
    f"pages AS (SELECT doc_hash, page_number, string_agg(clean_text, {_NL2} ORDER BY chunk_index, clean_text) AS page_text FROM "
    "(SELECT DISTINCT doc_hash, page_number, chunk_index, clean_text FROM page_chunks WHERE clean_text IS NOT NULL) GROUP BY doc_hash, page_number)"
)
PAGED = f"{PAGES}, paged AS (SELECT f.*, coalesce(p.page_text, '') AS page_text FROM facts f LEFT JOIN pages p USING (doc_hash, page_number))"


def hint(source: str, quote: str, page: str) -> str:
    """CTEs ending in ``h``: ``source`` with hint_start, hint_end, hint_granularity, hint_raw."""
    date = "(?:[a-z]+\\s+[0-9]{1,2},\\s*[0-9]{4}|[0-9]{1,2}\\s+[a-z]+\\s+[0-9]{4})"
    get = lambda e, p: f"nullif(regexp_extract(coalesce({e}, ''), '(?i){p}'), '')"
    fy = "\\b(?:fy\\s*20[0-9][0-9]|fy\\s*[0-9][0-9]|fiscal\\s*20[0-9][0-9]|fiscal\\s*[0-9][0-9])\\b"
    fy_page = "\\b(?:fy\\s*20[0-9][0-9]|fy\\s*[0-9][0-9]|fiscal\\s*20[0-9][0-9])\\b"
    ends = lambda e: year(f"regexp_extract({e}, '[0-9]+')")
    kind = lambda a, b, c, d, e, f: f"CASE WHEN ever THEN {a} WHEN dated IS NOT NULL THEN {b} WHEN own IS NOT NULL THEN {c} WHEN quart IS NOT NULL THEN {d} WHEN yr IS NOT NULL THEN {e} WHEN around IS NOT NULL THEN {f} END"
    start, end = (lambda e: f"({ends(e)} - 1) || '-04-01'"), (lambda e: f"({ends(e)}) || '-03-31'")
    return f"""h0 AS (SELECT *, regexp_matches(coalesce({quote}, ''), '(?i)\\bsince inception\\b') OR regexp_matches(coalesce({page}, ''), '(?i)\\bsince inception\\b') AS ever,
  coalesce({get(quote, f'(?:as of|dated|ended)\\s+{date}')}, {get(page, f'(?:as of|dated|ended)\\s+{date}')}) AS dated, {get(quote, fy)} AS own,
  {get(quote, '\\bq[1-4]\\s*(?:fy\\s*[0-9][0-9]|20[0-9][0-9])?\\b')} AS quart, {get(quote, '\\b(?:19|20)[0-9][0-9]\\b')} AS yr, {get(page, fy_page)} AS around FROM {source}),
h AS (SELECT *, {kind('NULL', 'NULL', start('own'), 'NULL', "yr || '-01-01'", start('around'))} AS hint_start,
  {kind('NULL', 'NULL', end('own'), 'NULL', "yr || '-12-31'", end('around'))} AS hint_end,
  {kind("'PERPETUAL'", "'EXACT_DATE'", "'YEAR'", "'QUARTER'", "'YEAR'", "'YEAR'")} AS hint_granularity,
  {kind("'since inception'", strip('dated'), strip('own'), strip('quart'), 'yr', f"{strip('around')} || ' (page context)'")} AS hint_raw FROM h0)"""


def matches(pattern: str, label: bool) -> str:
    p = q("(?i)" + pattern)
    groups = f", unnest(regexp_extract_all(clean_text, {p}, 1)) AS label, unnest(regexp_extract_all(clean_text, {p}, 2)) AS value" if label else ""
    return (
        f"SELECT chunk_id, doc_name, page_number, clean_text, unnest(range(len(regexp_extract_all(clean_text, {p})))) AS match_pos, "
        f"unnest(regexp_extract_all(clean_text, {p})) AS m{groups} FROM page_chunks WHERE clean_text IS NOT NULL"
    )


_ROW = "chunk_id, doc_name, page_number, clean_text, match_pos"
_OUT = "chunk_id, pattern_no, CAST(match_pos AS BIGINT) AS match_pos, attribute, raw_value, canonical_unit, verbatim_quote"


def kpi() -> str:
    parts = []
    number = strip(f"regexp_extract({strip('m')}, {q(v.KPI_NUMBER)})")
    for n, (pattern, attribute, unit) in enumerate(v.KPI_RULES):
        parts.append(
            f"SELECT {_ROW}, {n} AS pattern_no, {q(attribute)} AS attribute, CASE WHEN {number} <> '' THEN {number} ELSE {strip('m')} END AS raw_value, "
            f"{q(unit)} AS canonical_unit, {strip('m')} AS verbatim_quote FROM ({matches(pattern, False)})"
        )
    return " UNION ALL ".join(parts)


def labelled(pattern: str, fallback: str | None, unit: str | None, where: str = "true", quote: str | None = None) -> str:
    value, label = strip("value"), strip("label")
    marks = " OR ".join(f"contains({value}, {q(m)})" for m in v.RUPEE_MARKS)
    attribute = f"CASE WHEN length({label}) < {v.LONGEST_LABEL} THEN {label} ELSE {q(fallback)} END" if fallback else label
    return (
        f"SELECT {_ROW}, 0 AS pattern_no, {attribute} AS attribute, {value} AS raw_value, {q(unit) if unit else f'CASE WHEN {marks} THEN {q("INR")} ELSE {q("USD")} END'} AS canonical_unit, "
        f"{quote or strip('m')} AS verbatim_quote FROM ({matches(pattern, True)}) WHERE {where}"
    )


MONEY = labelled(v.MONEY_RULE, v.MONEY_FALLBACK, None, f"NOT regexp_matches(lower(label), '{'|'.join(v.SKIPPED_LABELS)}')")
PERCENT = labelled(v.PERCENT_RULE, None, "PERCENT")
CHART = labelled(v.CHART_RULE, v.CHART_FALLBACK, None, f"{strip('value')} <> ''", f"'[Visual Chart]: ' || {strip('m')} || ' (X-Axis: ' || doc_name || ' Pg ' || page_number || ')'")

_STEM = strip("translate(replace(replace(regexp_replace(doc_name, '^[0-9]+\\s*[\\-_]?', ''), '-excerpt.pdf', ''), '.pdf', ''), '-_', '  ')")
_NAMED = "regexp_extract(clean_text, '\\b([A-Z][A-Za-z0-9&.\\s]{2,35}\\s+(?:Limited|Ltd|Corporation|Corp|Bank|Ministry|Department|Government|Inc|LLP|Authority|Council|Institute|Company))\\b', 1)"
_ENTITY = (
    f"CASE WHEN {_NAMED} <> '' THEN {strip(_NAMED)} WHEN regexp_matches(lower({_STEM}), 'economic survey|pib|press release|bulletin|budget') THEN 'Government of India' "
    f"ELSE array_to_string(list_transform(string_split(lower({_STEM}), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') END"
)


def numeric() -> str:
    words = " OR ".join(f"contains(lower(coalesce(attribute_raw, '')), {q(w)})" for w in v.NUMERIC_WORDS)
    return f"(canonical_value_num IS NOT NULL OR coalesce(regexp_matches(raw_value, '\\p{{Nd}}'), false) OR {words})"


VISUAL = f"(coalesce(provenance_modality = 'VISUAL_CHART', false) OR coalesce(starts_with(verbatim_quote, {q(v.CHART_QUOTE)}), false))"
GROUNDED = f"(coalesce({strip('verbatim_quote')} <> '', false) AND contains({grounding('page_text')}, {grounding('verbatim_quote')}))"
ADRIFT = f"(coalesce({strip('temporal_raw')} = '', true) OR coalesce(granularity = 'UNKNOWN', true))"
LATEST = "latest AS (SELECT unnest(arg_max(f, ingest_seq)) FROM facts f GROUP BY fact_id)"
RELATION = """CASE WHEN coalesce(a.granularity = 'PERPETUAL', false) OR coalesce(b.granularity = 'PERPETUAL', false)
    OR coalesce(a.start_date, '') = '' OR coalesce(a.end_date, '') = '' OR coalesce(b.start_date, '') = '' OR coalesce(b.end_date, '') = '' THEN 'PERPETUAL'
  WHEN a.start_date = b.start_date AND a.end_date = b.end_date THEN 'EQUAL' WHEN a.end_date < b.start_date OR b.end_date < a.start_date THEN 'DISJOINT'
  WHEN a.start_date >= b.start_date AND a.end_date <= b.end_date THEN 'SUBSET' WHEN a.start_date <= b.start_date AND a.end_date >= b.end_date THEN 'SUPERSET'
  ELSE 'OVERLAPPING' END"""
_NUM = "coalesce((a.canonical_value_num = 0 AND b.canonical_value_num = 0) OR abs(a.canonical_value_num - b.canonical_value_num) <= greatest(abs(a.canonical_value_num), abs(b.canonical_value_num)) * 0.005e0, false)"
_STR = lambda t: f"lower({strip(f'coalesce(CASE WHEN {t}.canonical_value_num IS NOT NULL THEN coalesce({t}.canonical_value_str, CAST({t}.canonical_value_num AS VARCHAR)) END, {t}.canonical_value_str)')})"
SAME_VALUE = f"CASE WHEN a.canonical_value_num IS NOT NULL AND b.canonical_value_num IS NOT NULL THEN {_NUM} ELSE coalesce({_STR('a')} = {_STR('b')}, false) END"
SAME_SCOPE = f"coalesce(lower({strip('a.scope')}) = lower({strip('b.scope')}), false)"
SAME_UNIT = "coalesce(a.canonical_unit = b.canonical_unit, false)"
FREE = "NOT coalesce(a.is_quarantined, false) AND NOT coalesce(b.is_quarantined, false) AND NOT (a.doc_hash = b.doc_hash AND a.page_number = b.page_number)"
TESTED = f"{RELATION} AS relation, {SAME_SCOPE} AS same_scope, {SAME_UNIT} AS same_unit, {SAME_VALUE} AS same_value"
_SETTLED = "relation IN ('EQUAL', 'PERPETUAL') AND same_scope AND same_unit"
CASE = f"CASE WHEN {_SETTLED} AND same_value THEN {q(v.CORROBORATION)} WHEN {_SETTLED} THEN {q(v.CONTRADICTION)} ELSE {q(v.RECONCILED)} END"
JOINED = (
    "FROM latest a JOIN latest b ON a.attribute_canonical = b.attribute_canonical AND a.entity_canonical = b.entity_canonical AND a.doc_hash <> b.doc_hash "
    "AND a.ingest_seq < b.ingest_seq WHERE NOT coalesce(a.is_quarantined, false) AND NOT coalesce(b.is_quarantined, false)"
)
RECORDED = "FROM relationships l JOIN latest a ON a.fact_id = l.fact_id_a JOIN latest b ON b.fact_id = l.fact_id_b"
_VS = lambda label, c: f"{q(label + ' (')} || coalesce(a_{c}, 'None') || ' vs ' || coalesce(b_{c}, 'None') || ')'"
_DIMS = f"""list_filter([CASE WHEN relation IN ('EQUAL', 'PERPETUAL') THEN NULL WHEN relation = 'DISJOINT' THEN {_VS('Temporal Progression/Evolution', 'temporal_raw')}
  WHEN relation IN ('SUBSET', 'SUPERSET') THEN {q(v.AGGREGATION)} ELSE {_VS('Different Time Windows', 'temporal_raw')} END,
  CASE WHEN NOT same_scope THEN {_VS('Organizational Scope', 'scope')} END, CASE WHEN NOT same_unit THEN {_VS('Unit/Measurement Scale', 'canonical_unit')} END], lambda d: d IS NOT NULL)"""
CLASSIFIED = f"""tested AS (SELECT l.id, l.case_type AS recorded, {TESTED}, a.temporal_raw AS a_temporal_raw, b.temporal_raw AS b_temporal_raw, a.scope AS a_scope, b.scope AS b_scope,
  a.canonical_unit AS a_canonical_unit, b.canonical_unit AS b_canonical_unit {RECORDED} WHERE {FREE}),
classified AS (SELECT *, {CASE} AS case_type, {_DIMS} AS dims FROM tested)"""
_STEMS = lambda n: f"list_distinct(list_transform({_KEPT(n)}, lambda w: w[1:4]))"
_KEPT = lambda n: f"CASE WHEN len(list_filter({token_list(n)}, lambda w: w NOT IN ({names(v.NAME_NOISE)}))) > 0 THEN list_filter({token_list(n)}, lambda w: w NOT IN ({names(v.NAME_NOISE)})) ELSE {token_list(n)} END"
_SHORT = "replace(replace(source_doc_name, '-excerpt.pdf', ''), '.pdf', '')"
_TITLE = lambda e, none: f"coalesce(nullif(array_to_string(list_transform(regexp_extract_all({e}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: upper(w[1:1]) || lower(w[2:])), ''), ''), {q(none)})"
_CARD = lambda t: f"replace(replace({t}.source_doc_name, '-excerpt.pdf', ''), '.pdf', '') AS document_{t}, {t}.page_number AS page_{t}, coalesce({t}.provenance_modality = 'VISUAL_CHART' OR contains(lower({t}.provenance_modality), 'visual chart'), false) AS visual_{t}"
_VALID = "NOT coalesce(is_quarantined, false)"
_PLAIN = "upper(regexp_replace(regexp_replace({}, '^\\s+|\\s+$', '', 'g'), '[\\s_]+', '_', 'g'))"

SQL = {
    "q01_doc_hash_dedup": "SELECT sha256(text) AS doc_hash, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "q02_token_estimate": f"SELECT chunk_id, {tokens('clean_text')} AS tokens FROM page_chunks",
    "q03_clean_text": f"SELECT chunk_id, length({clean('clean_text')}) AS n_chars, sha256({clean('clean_text')}) AS digest FROM page_chunks WHERE clean_text IS NOT NULL",
    "q04_paragraph_chunks": f"""
WITH RECURSIVE t AS (SELECT chunk_id, has_images, {clean("coalesce(clean_text, '')")} AS c FROM page_chunks),
k AS (SELECT chunk_id, CASE WHEN c = '' THEN '[Visual Page]' ELSE c END AS c, c = '' AS bare, {tokens('c')} AS n FROM t WHERE c <> '' OR has_images),
p AS (SELECT chunk_id, generate_subscripts(string_split(c, {_NL2}), 1) AS i, unnest(string_split(c, {_NL2})) AS para FROM k WHERE n > 2048),
pn AS (SELECT *, {tokens('para')} AS tn FROM p),
walk(chunk_id, i, n, piece) AS (
  SELECT chunk_id, i, tn, 0 FROM pn WHERE i = 1
  UNION ALL
  SELECT w.chunk_id, q.i, CASE WHEN w.n + q.tn > 2048 THEN q.tn ELSE w.n + q.tn END, CASE WHEN w.n + q.tn > 2048 THEN w.piece + 1 ELSE w.piece END
  FROM walk w JOIN pn q ON q.chunk_id = w.chunk_id AND q.i = w.i + 1
), packed AS (SELECT w.chunk_id, w.piece, string_agg(pn.para, {_NL2} ORDER BY w.i) AS c FROM walk w JOIN pn USING (chunk_id, i) GROUP BY w.chunk_id, w.piece)
SELECT chunk_id, piece AS chunk_index, {tokens('c')} AS tokens, sha256(c) AS digest FROM packed
UNION ALL SELECT chunk_id, 0, CASE WHEN bare THEN 50 ELSE {tokens('c')} END, sha256(c) FROM k WHERE n <= 2048
""",
    "q05_norm_text": f"SELECT doc_id, sha256({grounding('text')}) AS digest FROM documents WHERE text IS NOT NULL",
    "q06_entity_key": f"SELECT DISTINCT entity_raw, {ENTITY_KEY} AS entity_key FROM facts",
    "q07_attribute_key": f"SELECT DISTINCT attribute_raw, {ATTRIBUTE_KEY} AS attribute_key FROM facts",
    "q08_value_unit": f"SELECT DISTINCT raw_value, canonical_unit, round({VALUE}, 2) AS value, {UNIT} AS unit FROM facts",
    "q09_fiscal_interval": periods("granularity2 = 'YEAR' AND start_date2 LIKE '%-04-01'"),
    "q10_calendar_interval": periods("granularity2 = 'YEAR' AND start_date2 LIKE '%-01-01'"),
    "q11_quarter_interval": periods("granularity2 = 'QUARTER'"),
    "q12_exact_date": periods("granularity2 IN ('EXACT_DATE', 'PERPETUAL')"),
    "q13_extractor_number": f"SELECT DISTINCT raw_value, round({extracted('raw_value')}, 2) AS value FROM facts",
    "q14_temporal_hint": f"WITH {PAGED}, {hint('paged', 'verbatim_quote', 'page_text')} SELECT ingest_seq, hint_start AS start_date, hint_end AS end_date, hint_granularity AS granularity, hint_raw AS raw FROM h",
    "q15_jaccard_prefix": f"""
WITH {LATEST}, pairs AS (SELECT DISTINCT a.entity_raw AS name_a, b.entity_raw AS name_b {RECORDED}),
s AS (SELECT name_a, name_b, {_STEMS('name_a')} AS x, {_STEMS('name_b')} AS y FROM pairs)
SELECT name_a, name_b, coalesce(round(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 6), 0.0) AS jaccard FROM s
""",
    "q17_interval_relation": f"WITH {LATEST} SELECT l.id, {RELATION} AS relation {RECORDED}",
    "q18_values_match": f"WITH {LATEST} SELECT l.id, {_NUM} AS same_value {RECORDED}",
    "q19_fact_id": f"""
SELECT ingest_seq, substr(sha256(lower({strip("coalesce(entity_raw, '')")}) || '|' || lower({strip("coalesce(attribute_raw, '')")}) || '|' || coalesce(doc_hash, '') || '|'
  || coalesce(CAST(page_number AS VARCHAR), '') || '|' || {strip("coalesce(raw_value, '')")}), 1, 16) AS fact_id FROM facts""",
    "q20_extract_percent": f"SELECT {_OUT} FROM ({PERCENT})",
    "q21_extract_money": f"SELECT {_OUT} FROM ({MONEY})",
    "q22_extract_kpi": f"SELECT {_OUT} FROM ({kpi()})",
    "q23_extract_chart": f"SELECT {_OUT} FROM ({CHART})",
    "q24_extract_dedup": f"""
WITH every AS (
  SELECT *, 1 AS rule, 'India' AS scope, 0.92e0 AS confidence_score, 'TEXT' AS provenance_modality FROM ({kpi()})
  UNION ALL SELECT *, 2, 'Consolidated', 0.90e0, 'TEXT' FROM ({MONEY}) UNION ALL SELECT *, 3, 'GLOBAL', 0.88e0, 'TEXT' FROM ({PERCENT})
  UNION ALL SELECT *, 4, 'Consolidated', 0.92e0, 'VISUAL_CHART' FROM ({CHART})
), once AS (
  SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY chunk_id, lower({strip('verbatim_quote')}) ORDER BY rule, pattern_no, match_pos) = 1
), {hint('once', 'verbatim_quote', 'clean_text')}
SELECT chunk_id, rule, {_ENTITY} AS entity, attribute, raw_value, round({extracted('raw_value')}, 2) AS value, canonical_unit, scope, confidence_score,
  hint_granularity AS granularity, hint_raw AS temporal_raw, verbatim_quote, provenance_modality FROM h
""",
    "q25_quote_exact": f"WITH {PAGED} SELECT ingest_seq, {GROUNDED} AS is_grounded FROM paged",
    "q27_numeric_fact": f"SELECT ingest_seq, {numeric()} AS is_numeric FROM facts",
    "q28_gate": f"""
WITH {PAGED}, judged AS (SELECT ingest_seq, coalesce(CASE WHEN NOT {VISUAL} AND NOT {GROUNDED} THEN {q(v.UNVERIFIED)}
  WHEN ({numeric()} OR {VISUAL}) AND {ADRIFT} THEN CASE WHEN {VISUAL} THEN {q(v.NO_AXIS)} ELSE {q(v.NO_HORIZON)} END END, nullif(quarantine_reason, '')) AS reason FROM paged)
SELECT ingest_seq, reason IS NOT NULL AS is_quarantined, reason AS quarantine_reason FROM judged
""",
    "q29_candidates": f"WITH {LATEST} SELECT a.attribute_canonical AS attribute, a.entity_canonical AS entity, count(*) AS pairs {JOINED} GROUP BY 1, 2",
    "q30_reconcile": f"""
WITH {LATEST}, tested AS (SELECT a.attribute_canonical AS attribute, {TESTED} {JOINED})
SELECT attribute, {CASE} AS case_type, relation, count(*) AS pairs FROM tested GROUP BY 1, 2, 3""",
    "q31_reconcile_detail": f"""
WITH {LATEST}, {CLASSIFIED}
SELECT id, case_type, CASE case_type WHEN {q(v.CORROBORATION)} THEN '' WHEN {q(v.CONTRADICTION)} THEN {q(v.CONFLICT)} ELSE array_to_string(dims, ' | ') END AS dimensions,
  CASE case_type WHEN {q(v.CORROBORATION)} THEN {q(v.WHY[v.CORROBORATION])} WHEN {q(v.CONTRADICTION)} THEN {q(v.WHY[v.CONTRADICTION])}
    ELSE {q(v.WHY[v.RECONCILED])} || array_to_string(dims, ', ') || '.' END AS rationale FROM classified""",
    "q32_incremental_equals_bulk": f"WITH {LATEST}, tested AS (SELECT {TESTED} {JOINED}) SELECT {CASE} AS case_type, count(*) AS pairs FROM tested GROUP BY 1",
    "q33_upsert_latest": f"WITH {LATEST} SELECT fact_id, confidence_score, provenance_modality, ingest_seq FROM latest",
    "q34_case_counts": f"SELECT {_PLAIN.format('case_type')} AS case_type, count(*) AS n FROM relationships GROUP BY 1",
    "q35_doc_filter": f"""
WITH {LATEST}, en AS (SELECT doc_hash FROM source_docs WHERE lang = 'en')
SELECT l.id, a.doc_hash AS a_doc_hash, b.doc_hash AS b_doc_hash {RECORDED} WHERE a.doc_hash IN (SELECT doc_hash FROM en) AND b.doc_hash IN (SELECT doc_hash FROM en)""",
    "q36_quarantine_report": f"""
SELECT entity_raw AS entity, attribute_raw AS attribute, raw_value AS value, quarantine_reason AS reason, {_SHORT} AS document, page_number AS page,
  verbatim_quote AS quote, coalesce(provenance_modality, 'TEXT') AS modality FROM facts WHERE is_quarantined""",
    "q37_fact_directory": f"""
SELECT fact_id, entity_raw AS entity, attribute_raw AS attribute, raw_value AS raw, canonical_value_num AS value, canonical_unit AS unit, scope, temporal_raw AS period,
  {_SHORT} AS document, page_number AS page, confidence_score AS confidence,
  array_to_string(list_transform(regexp_extract_all(replace(attribute_canonical, '_', ' '), '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: upper(w[1:1]) || lower(w[2:])), '') AS heading
FROM facts WHERE {_VALID}""",
    "q38_index_stats": f"""
SELECT count(*) FILTER ({_VALID}) AS valid_facts, count(*) FILTER (NOT ({_VALID})) AS quarantined_facts, count(DISTINCT lower(attribute_raw)) FILTER ({_VALID}) AS attributes,
  count(DISTINCT doc_hash) FILTER ({_VALID}) AS documents, max(ingest_seq) AS last_seq FROM facts""",
    "q39_page_visuals": """
SELECT coalesce(has_tables, false) AS has_tables, CASE WHEN coalesce(has_images, false) THEN 'VISUAL_CHART' ELSE 'TEXT' END AS modality,
  provenance_modality = CASE WHEN coalesce(has_images, false) THEN 'VISUAL_CHART' ELSE 'TEXT' END AS as_recorded, count(*) AS n FROM page_chunks GROUP BY 1, 2, 3""",
    "q40_metrics": f"""
WITH {LATEST}, {CLASSIFIED}, c AS (SELECT {_PLAIN.format('recorded')} AS t, case_type AS p, count(*) AS n FROM classified GROUP BY 1, 2),
labels AS (SELECT DISTINCT label FROM (SELECT t AS label FROM c UNION SELECT p FROM c) WHERE label IS NOT NULL),
s AS (SELECT label, coalesce(sum(n) FILTER (t = label AND p = label), 0)::DOUBLE AS hit, coalesce(sum(n) FILTER (t = label), 0) AS real, coalesce(sum(n) FILTER (p = label), 0) AS said FROM labels, c GROUP BY label),
pr AS (SELECT label, CAST(real AS BIGINT) AS support, coalesce(hit / nullif(said, 0), 0.0) AS pre, coalesce(hit / nullif(real, 0), 0.0) AS rec FROM s)
SELECT label, support, round(pre, 6) AS precision, round(rec, 6) AS recall, round(coalesce(2 * pre * rec / nullif(pre + rec, 0), 0.0), 6) AS f1 FROM pr""",
    "q41_event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "q42_canonicalize": f"""
WITH {stated('facts')}
SELECT ingest_seq, {ENTITY_KEY} AS entity_canonical, {ATTRIBUTE_KEY} AS attribute_canonical, round(coalesce(canonical_value_num, {VALUE}), 2) AS value, {UNIT} AS canonical_unit,
  coalesce(CASE WHEN coalesce({strip('temporal_raw')} <> '', false) THEN granularity2 ELSE granularity END, 'UNKNOWN') AS granularity FROM p""",
    "q43_unseen_documents": "SELECT ingest_seq FROM facts f WHERE NOT EXISTS (SELECT 1 FROM page_chunks c WHERE c.doc_hash = f.doc_hash)",
    "q44_violations": """
WITH v AS (
  SELECT 'page_number' AS broken FROM facts WHERE NOT coalesce(page_number >= 1, false)
  UNION ALL SELECT 'confidence_score' FROM facts WHERE NOT coalesce(confidence_score BETWEEN 0 AND 1, false)
  UNION ALL SELECT 'granularity' FROM facts WHERE granularity IS NOT NULL AND granularity NOT IN ('EXACT_DATE', 'MONTH', 'QUARTER', 'YEAR', 'PERPETUAL', 'UNKNOWN')
  UNION ALL SELECT 'provenance_modality' FROM facts WHERE provenance_modality IS NOT NULL AND provenance_modality NOT IN ('TEXT', 'VISUAL_CHART', 'HYBRID')
  UNION ALL SELECT 'fact_id' FROM facts WHERE fact_id IS NULL UNION ALL SELECT 'doc_hash' FROM facts WHERE doc_hash IS NULL
) SELECT broken, count(*) AS n FROM v GROUP BY broken""",
    "q49_documents_without_pictures": "SELECT ingest_seq FROM facts f WHERE NOT EXISTS (SELECT 1 FROM page_chunks c WHERE c.doc_hash = f.doc_hash AND c.has_images)",
    "q50_cases_chosen": f"""
WITH r AS (SELECT id, {_PLAIN.format('case_type')} AS c FROM relationships)
SELECT 'All' AS choice, id FROM r UNION ALL SELECT '1', id FROM r WHERE c = 'CASE_1_CORROBORATION' UNION ALL SELECT '2', id FROM r WHERE c = 'CASE_2_GENUINE_CONTRADICTION'
UNION ALL SELECT '3', id FROM r WHERE c = 'CASE_3_CONTEXT_RECONCILED'""",
    "q51_document_names": "SELECT DISTINCT source_doc_name FROM facts WHERE source_doc_name IS NOT NULL",
    "q52_ingest_totals": f"""
WITH {LATEST}, n AS (SELECT a.source_doc_name, count(*) AS n FROM relationships l JOIN latest a ON a.fact_id = l.fact_id_b GROUP BY 1)
SELECT f.source_doc_name, count(*) AS facts, coalesce(any_value(n.n), 0) AS relations FROM facts f LEFT JOIN n USING (source_doc_name) GROUP BY 1""",
    "q53_evidence_cards": f"""
WITH {LATEST}
SELECT l.id, {_TITLE('a.entity_raw', 'Entity')} || ' — ' || {_TITLE("replace(a.attribute_raw, '_', ' ')", 'Attribute')} AS title, {_CARD('a')}, {_CARD('b')},
  a.start_date IS NOT NULL AND b.start_date IS NOT NULL AND (a.start_date <> b.start_date OR a.end_date IS DISTINCT FROM b.end_date) AS bounds_differ {RECORDED}""",
    "q54_scale_error": f"""
WITH {LATEST}
SELECT l.id, round(abs(a.canonical_value_num - b.canonical_value_num) / greatest(a.canonical_value_num, b.canonical_value_num), 6) AS error {RECORDED}
WHERE a.canonical_value_num IS NOT NULL AND b.canonical_value_num IS NOT NULL AND greatest(a.canonical_value_num, b.canonical_value_num) > 0""",
    "q56_values_match_texts": f"WITH {LATEST} SELECT l.id, {SAME_VALUE} AS same_value {RECORDED} WHERE (a.canonical_value_num IS NULL) = (b.canonical_value_num IS NULL)",
    "q57_dimensions_json": "SELECT id, '[' || array_to_string(list_transform(differing_dimensions, lambda d: '\"' || replace(replace(d, '\\', '\\\\'), '\"', '\\\"') || '\"'), ', ') || ']' AS dimensions FROM relationships",
}
SQL["q55_macro_scores"] = f"""
WITH s AS ({SQL["q40_metrics"].replace("round(pre, 6) AS precision, round(rec, 6) AS recall, round(coalesce(2 * pre * rec / nullif(pre + rec, 0), 0.0), 6) AS f1", "pre, rec, coalesce(2 * pre * rec / nullif(pre + rec, 0), 0.0) AS f")}),
m AS (SELECT avg(pre) AS p, avg(rec) AS r, avg(f) AS f FROM s), k AS (SELECT *, 10 * (p + r + f) / 3 AS k FROM m)
SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round(k, 6) AS score, k >= 8 AS passed FROM k"""
