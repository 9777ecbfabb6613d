"""DuckDB oracle SQL for the registered queries.

Each query is rebuilt independently in SQL over the pre-registered table views
(RE2 regular expressions, list lambdas, window functions).  Fixed values
(patterns, blocklist, label maps, pools) are rendered from
``shroud.functions.patterns`` so both sides read the same lists.

Dialect notes: RE2 has no look-ahead, so the SSN pattern becomes its plain
shape plus exclusions; RE2's \\d \\s \\b are ASCII, which agrees with the JVM's
Unicode classes on this data.  Decimal literals are cast to DOUBLE so score
arithmetic is IEEE on both sides.
"""

from __future__ import annotations

from shroud.functions import patterns as P
from shroud.operators.detect import DICTIONARY_TERMS, GAZETTEER_PRIO_BASE, SCORED_PRIO_BASE, SECRET_PATTERN
from shroud.sources.corpus import ARABIC_INDIC, JCB_DIGITS, MONTHS, PAGES_FROM, TURNS_FROM

WS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]"
NONBLANK = r"[^\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]"
TOKEN = r"[\p{L}\p{N}\p{M}_#]+"
TOKEN_CHUNK = r"[^\p{L}\p{N}\p{M}_#]*[\p{L}\p{N}\p{M}_#]+"
SPAN_COLS = 'doc_id, segment_index, "start", "end", entity_type, text, score, source, prio'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def normalize(x: str) -> str:
    return f"lower({strip(x)})"


def lpad(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS VARCHAR), {n}, '0')"


def str_list(xs) -> str:
    return "[" + ", ".join(lit(x) for x in xs) + "]"


def luhn_ok(d: str) -> str:
    dig = f"CAST(substring({d}, length({d}) - li, 1) AS INTEGER)"
    body = f"CASE WHEN li % 2 = 1 THEN (CASE WHEN {dig} * 2 > 9 THEN {dig} * 2 - 9 ELSE {dig} * 2 END) ELSE {dig} END"
    return (f"(length({d}) >= 13 AND coalesce(list_sum(list_transform(range(0, length({d})), "
            f"lambda li: {body})), 0) % 10 = 0)")


def luhn_check_digit(p: str) -> str:
    dig = f"CAST(substring({p}, length({p}) - lj, 1) AS INTEGER)"
    body = f"CASE WHEN lj % 2 = 0 THEN (CASE WHEN {dig} * 2 > 9 THEN {dig} * 2 - 9 ELSE {dig} * 2 END) ELSE {dig} END"
    s = f"list_sum(list_transform(range(0, length({p})), lambda lj: {body}))"
    return f"((10 - {s} % 10) % 10)"


def digits_only(x: str) -> str:
    return f"translate(regexp_replace({x}, '[^\\p{{Nd}}]', '', 'g'), '{ARABIC_INDIC}', '0123456789')"


# --- corpus and segments ----------------------------------------------------------

def planted_ctes() -> str:
    months = str_list(MONTHS)
    payload = f"concat('4', {lpad('k * 7919 % 10000000', 7)}, {lpad('o % 10000000', 7)})"
    return f"""
planted_base AS (
  SELECT o.o_orderkey AS o, o.o_custkey AS k, o.o_orderpriority, c.c_name, c.c_mktsegment, n.n_name, r.r_name, s.s_name
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN supplier s ON s.s_suppkey = o.o_orderkey % (SELECT count(*) FROM supplier)
),
planted_parts AS (
  SELECT *, CAST(1940 + k % 60 AS VARCHAR) AS yyyy, {lpad('1 + k % 12', 2)} AS mm, {lpad('1 + k % 28', 2)} AS dd,
         {payload} AS payload
  FROM planted_base
),
planted_vals AS (
  SELECT *,
    concat('customer', k, '@mail', k % 7, '.example.com') AS email,
    concat('+1 (2', {lpad('k % 100', 2)}, ') 555-', {lpad('k % 10000', 4)}) AS phone,
    concat(CASE WHEN o % 10 = 0 THEN '000' ELSE {lpad('1 + k % 665', 3)} END, '-',
           CASE WHEN o % 10 = 5 THEN '00' ELSE {lpad('1 + k % 99', 2)} END, '-', {lpad('1 + k % 9999', 4)}) AS ssn,
    (o % 10) NOT IN (0, 5) AS ssn_ok,
    CASE WHEN k % 3 = 0 THEN concat('DOB: ', mm, '/', dd, '/', yyyy)
         WHEN k % 3 = 1 THEN concat('Born ', {months}[CAST(k % 12 + 1 AS INTEGER)], ' ', CAST(1 + k % 28 AS VARCHAR), ', ', yyyy)
         ELSE concat('Date of Birth - ', yyyy, '-', mm, '-', dd) END AS dob,
    CASE WHEN k % 3 = 0 THEN ' noted.' WHEN k % 3 = 1 THEN ' in town.' ELSE ' recorded.' END AS dob_tail,
    concat(payload, CAST(CASE WHEN o % 5 <> 0 THEN {luhn_check_digit('payload')}
                              ELSE ({luhn_check_digit('payload')} + 1) % 10 END AS VARCHAR)) AS card,
    o % 5 <> 0 AS card_ok,
    o % 7 = 0 AS jcb,
    concat('10.', k % 256, '.', o % 256, '.', (k + o) % 256) AS ip
  FROM planted_parts
),
planted AS (
  SELECT -1 - o AS doc_id,
    concat_ws(chr(10),
      concat('Order placed by ', c_name, ' of ', n_name, ' in ', r_name, ', via ', s_name, ' for the Company, per QX and the Board.'),
      concat('Contact ', email, ' or ', phone, ' today, not 555.1234567.'),
      concat('SSN ', ssn, ' on file.'),
      '',
      concat(dob, dob_tail),
      concat('Card ', card, ' charged.', CASE WHEN jcb THEN ' Also {JCB_DIGITS}.' ELSE '' END),
      concat('Login from ', ip, ' ok, not 10.300.1.1, repeat ', c_name, ' and ', c_name, '.')) AS text,
    [c_name, n_name, c_mktsegment, o_orderpriority] AS cells
  FROM planted_vals
)"""


def planted_truth_cte() -> str:
    L = "length"
    rows = [
        (0, "16", "PERSON", "c_name", "true"),
        (0, f"16 + {L}(c_name) + 4", "ADDRESS", "n_name", "true"),
        (0, f"16 + {L}(c_name) + 4 + {L}(n_name) + 4", "ADDRESS", "r_name", "true"),
        (0, f"16 + {L}(c_name) + 4 + {L}(n_name) + 4 + {L}(r_name) + 6", "ORG", "s_name", "true"),
        (1, "8", "EMAIL", "email", "true"),
        (1, f"8 + {L}(email) + 4", "PHONE", "phone", "true"),
        (2, "4", "SSN", "ssn", "ssn_ok"),
        (3, "0", "DATE_OF_BIRTH", "dob", "true"),
        (4, "5", "CREDIT_CARD", "card", "card_ok"),
        (4, f"5 + {L}(card) + 15", "CREDIT_CARD", lit(JCB_DIGITS), "jcb"),
        (5, "11", "IP_ADDRESS", "ip", "true"),
        (5, f"11 + {L}(ip) + 28", "PERSON", "c_name", "true"),
        (5, f"11 + {L}(ip) + 28 + {L}(c_name) + 5", "PERSON", "c_name", "true"),
    ]
    sel = "\n  UNION ALL ".join(
        f"SELECT -1 - o AS doc_id, CAST({seg} AS BIGINT) AS segment_index, CAST({st} AS BIGINT) AS \"start\", "
        f"CAST({st} + {L}({v}) AS BIGINT) AS \"end\", '{et}' AS entity_type, {v} AS text FROM planted_vals WHERE {ok}"
        for seg, st, et, v, ok in rows)
    return f"planted_truth AS (\n  {sel}\n)"


def corpus_cte(sources=("documents", "planted")) -> str:
    parts = []
    if "documents" in sources:
        parts.append("SELECT doc_id, text, CAST(NULL AS VARCHAR[]) AS cells FROM documents")
    if "planted" in sources:
        parts.append("SELECT doc_id, text, cells FROM planted")
    if "pages" in sources:
        parts.append(f"SELECT page_id + {PAGES_FROM} AS doc_id, html AS text, CAST(NULL AS VARCHAR[]) AS cells FROM pages")
    if "conversations" in sources:
        parts.append(f"SELECT conv_id * 1000000 + turn + {TURNS_FROM} AS doc_id, text, CAST(NULL AS VARCHAR[]) AS cells FROM conversations")
    return "corpus AS (\n  " + "\n  UNION ALL ".join(parts) + "\n)"


def segments_cte(which: str = "all") -> str:
    body = (f"list_filter(list_transform(string_split(text, chr(10)), lambda x, i: {{'paragraph_index': i - 1, "
            f"'table_index': CAST(NULL AS INTEGER), 'row_index': CAST(NULL AS INTEGER), 'cell_index': CAST(NULL AS BIGINT), "
            f"'is_table_cell': false, 'text': x}}), lambda s: regexp_matches(s.text, '{NONBLANK}'))")
    cells = (f"list_filter(list_transform(coalesce(cells, CAST([] AS VARCHAR[])), lambda x, i: {{'paragraph_index': CAST(NULL AS BIGINT), "
             f"'table_index': 0, 'row_index': 0, 'cell_index': i - 1, 'is_table_cell': true, 'text': x}}), "
             f"lambda s: regexp_matches(s.text, '{NONBLANK}'))")
    segs = {"all": f"list_concat({body}, {cells})", "body": body, "cells": cells}[which]
    return f"""
seg_lists AS (SELECT doc_id, {segs} AS segs FROM corpus),
seg_rows AS (SELECT doc_id, generate_subscripts(segs, 1) - 1 AS segment_index, unnest(segs) AS s FROM seg_lists WHERE len(segs) > 0),
segments AS (
  SELECT doc_id, CAST(segment_index AS BIGINT) AS segment_index, CAST(s.paragraph_index AS BIGINT) AS paragraph_index,
         CAST(s.table_index AS BIGINT) AS table_index, CAST(s.row_index AS BIGINT) AS row_index,
         CAST(s.cell_index AS BIGINT) AS cell_index, s.is_table_cell AS is_table_cell, s.text AS text
  FROM seg_rows
)"""


def base_ctes(sources=("documents", "planted"), which: str = "all") -> str:
    out = []
    if "planted" in sources:
        out.append(planted_ctes())
    out.append(corpus_cte(sources))
    out.append(segments_cte(which))
    return ",".join(out)


# --- matches with offsets -----------------------------------------------------------

def located(name: str, pattern: str, extra_cols: str, src: str = "segments") -> str:
    """CTE ``name``: one row per match with 0-based start/end, from relation ``src``
    (doc_id, segment_index, text)."""
    p = lit(pattern)
    if src == "ascii_digits":  # RE2's classes are ASCII: match where digits of the planted script are 0-9, then cut from the text
        inner = located(f"{name}_a", pattern, extra_cols, f"(SELECT doc_id, segment_index, translate(text, '{ARABIC_INDIC}', '0123456789') AS text FROM segments)")
        return f"""{inner},
{name} AS (
  SELECT a.* REPLACE (substring(s.text, a."start" + 1, a."end" - a."start") AS text, s.text AS seg_text)
  FROM {name}_a a JOIN segments s ON a.doc_id = s.doc_id AND a.segment_index = s.segment_index
)"""
    return f"""
{name}_m AS (SELECT doc_id, segment_index, text, regexp_extract_all(text, {p}) AS m FROM {src}),
{name}_u AS (
  SELECT doc_id, segment_index, text, unnest(m) AS mt, unnest(string_split_regex(text, {p})[1:len(m)]) AS gp,
         generate_subscripts(m, 1) AS k
  FROM {name}_m WHERE len(m) > 0
),
{name} AS (
  SELECT doc_id, segment_index, text AS seg_text, k, mt AS text, {extra_cols},
         CAST(sum(length(gp) + length(mt)) OVER (PARTITION BY doc_id, segment_index ORDER BY k
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(mt) AS BIGINT) AS "start",
         CAST(sum(length(gp) + length(mt)) OVER (PARTITION BY doc_id, segment_index ORDER BY k
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS "end"
  FROM {name}_u
)"""


def re2_regex(etype: str, pat: str, ic: bool) -> str:
    if etype == "SSN":
        pat = P.SSN_SHAPE
    return P.re2_pattern(pat, ic)


SSN_BAD = ("(substring(text, 1, 3) IN ('000', '666') OR substring(text, 1, 1) = '9' "
           "OR substring(text, 5, 2) = '00' OR substring(text, 8, 4) = '0000')")


def regex_ctes(types=None) -> tuple[str, str]:
    """CTEs for the regex layer; returns (ctes, name of the span relation)."""
    ctes, sels = [], []
    for i, (etype, pat, ic) in enumerate(P.REGEX_PATTERNS):
        if types is not None and etype not in types:
            continue
        name = f"rx{i}"
        src = "ascii_digits" if etype == "CREDIT_CARD" else "segments"
        ctes.append(located(name, re2_regex(etype, pat, ic), f"'{etype}' AS entity_type, {i} AS prio", src))
        cond = "true"
        if etype == "SSN":
            cond = f"NOT {SSN_BAD}"
        if etype == "CREDIT_CARD":
            cond = luhn_ok(digits_only("text"))
        sels.append(f"SELECT doc_id, segment_index, \"start\", \"end\", entity_type, text, {dbl(1.0)} AS score, "
                    f"'regex' AS source, prio FROM {name} WHERE {cond}")
    ctes.append("regex_spans AS (\n  " + "\n  UNION ALL ".join(sels) + "\n)")
    return ",".join(ctes), "regex_spans"


def _values(rows, cols, alias) -> str:
    vals = ", ".join("(" + ", ".join(lit(v) if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)
    return f"(VALUES {vals}) AS {alias}({', '.join(cols)})"


def label_values() -> str:
    return _values(P.SCORED_LABEL_MAP, ["label", "mapped"], "lm")


def scored_ctes(threshold=P.CONFIDENCE_THRESHOLD) -> str:
    """scored_raw (raw labels, threshold applied) and scored_spans (labels mapped)."""
    ctes, sels = [], []
    for j, (label, pat, base, validator, words, window, boost) in enumerate(P.SCORED_RECOGNIZERS):
        name = f"sc{j}"
        ctes.append(located(name, P.re2_pattern(pat), f"'{label}' AS entity_type"))
        if validator == "luhn":
            score, cond = dbl(1.0), luhn_ok(digits_only("text"))
        elif words:
            lo = f"greatest(\"start\" - {window}, 0)"
            ctx = f"lower(substring(seg_text, {lo} + 1, \"end\" + {window} - {lo}))"
            hit = " OR ".join(f"instr({ctx}, {lit(w)}) > 0" for w in words)
            score, cond = f"CASE WHEN {hit} THEN {dbl(base)} + {dbl(boost)} ELSE {dbl(base)} END", "true"
        else:
            score, cond = dbl(float(base)), "true"
        sels.append(f"SELECT doc_id, segment_index, \"start\", \"end\", entity_type, text, {score} AS score, "
                    f"'scored' AS source, {SCORED_PRIO_BASE + j} AS prio FROM {name} WHERE {cond}")
    thr = f"WHERE score >= {dbl(threshold)}" if threshold is not None else ""
    ctes.append("scored_all AS (\n  " + "\n  UNION ALL ".join(sels) + "\n)")
    ctes.append(f"scored_raw AS (SELECT * FROM scored_all {thr})")
    ctes.append(f"""scored_spans AS (
  SELECT s.doc_id, s.segment_index, s."start", s."end", lm.mapped AS entity_type, s.text, s.score, s.source, s.prio
  FROM scored_raw s JOIN {label_values()} ON s.entity_type = lm.label
)""")
    return ",".join(ctes)


def gazetteer_ctes() -> str:
    """One token list per segment; only tokens that begin an entry grow to n-grams."""
    ner = _values([(lab, et, GAZETTEER_PRIO_BASE + i) for i, (lab, et) in enumerate(P.NER_LABEL_MAP)],
                  ["label", "etype", "prio"], "l")
    terms = " UNION ".join(f"SELECT {lit(e)}, {lit(lab)}" for e, lab in DICTIONARY_TERMS)
    chunk = TOKEN_CHUNK
    return f"""
dict_raw AS (
  SELECT c_name AS entry, 'PERSON' AS label FROM customer
  UNION SELECT s_name, 'ORG' FROM supplier
  UNION SELECT n_name, 'GPE' FROM nation
  UNION SELECT r_name, 'LOC' FROM region
  UNION {terms}
),
dict AS (
  SELECT d.entry, l.etype AS entity_type, l.prio, regexp_extract_all(d.entry, {lit(TOKEN)}) AS tk
  FROM dict_raw d JOIN {ner} ON d.label = l.label WHERE d.entry IS NOT NULL
),
entries AS (SELECT *, tk[1] AS first_token FROM dict WHERE len(tk) > 0),
tok_lists AS (SELECT doc_id, segment_index, regexp_extract_all(text, {lit(TOKEN)}) AS tk, regexp_extract_all(text, {lit(chunk)}) AS ck FROM segments),
tok_rows AS (
  SELECT doc_id, segment_index, tk, ck, unnest(tk) AS token, generate_subscripts(tk, 1) AS k FROM tok_lists WHERE len(tk) > 0
),
grams AS (
  SELECT doc_id, segment_index, unnest(range(1, (SELECT max(len(tk)) FROM entries) + 1)) AS n, k, token, tk, ck
  FROM tok_rows WHERE token IN (SELECT first_token FROM entries)
),
gram_texts AS (
  SELECT doc_id, segment_index, array_to_string(ck[1:k], '') AS upto, token,
         token || array_to_string(ck[k + 1:k + n - 1], '') AS gram
  FROM grams WHERE k + n - 1 <= len(tk)
),
gazetteer_spans AS (
  SELECT g.doc_id, g.segment_index, CAST(length(g.upto) - length(g.token) AS BIGINT) AS "start",
         CAST(length(g.upto) - length(g.token) + length(g.gram) AS BIGINT) AS "end", d.entity_type, g.gram AS text,
         {dbl(P.GAZETTEER_SCORE)} AS score, 'gazetteer' AS source, d.prio
  FROM gram_texts g JOIN entries d ON g.gram = d.entry
)"""


def blocklisted(text: str) -> str:
    return f"{normalize(text)} IN ({', '.join(lit(x) for x in P.IGNORED_ENTITIES)})"


def short_name(etype: str, text: str) -> str:
    types = ", ".join(lit(t) for t in P.SHORT_NAME_TYPES)
    return f"({etype} IN ({types}) AND length({strip(text)}) <= 2)"


def numeric_dob(etype: str, source: str, text: str) -> str:
    return f"({etype} = 'DATE_OF_BIRTH' AND {source} <> 'regex' AND regexp_matches({text}, '^\\p{{Nd}}+$'))"


def resolve_list(lst: str) -> str:
    """The D2 fold over a DuckDB list of structs with fields k1..k4, s_start, s_end, score."""
    last = "acc[-1]"
    ov = f"(c.s_start < {last}.s_end AND {last}.s_start < c.s_end)"
    clen, llen = "(c.s_end - c.s_start)", f"({last}.s_end - {last}.s_start)"
    better = f"({clen} > {llen} OR ({clen} = {llen} AND c.score > {last}.score))"
    srt = f"list_sort({lst})"
    return (f"list_reduce({srt}, lambda acc, c: CASE WHEN len(acc) = 0 THEN [c] "
            f"WHEN {ov} THEN (CASE WHEN {better} THEN list_append(acc[1:len(acc) - 1], c) ELSE acc END) "
            f"ELSE list_append(acc, c) END, {srt}[1:0])")


SPAN_STRUCT = ("{'k1': \"start\", 'k2': \"start\" - \"end\", 'k3': -score, 'k4': prio, 's_start': \"start\", "
               "'s_end': \"end\", 'etype': entity_type, 'txt': text, 'score': score, 'source': source, 'prio': prio}")


def pipeline_ctes(layers=("regex", "gazetteer", "scored")) -> str:
    """candidates -> filtered -> resolved -> preds (after base_ctes)."""
    ctes, sels = [], []
    if "regex" in layers:
        c, _ = regex_ctes()
        ctes.append(c)
        sels.append(f"SELECT {SPAN_COLS} FROM regex_spans")
    if "gazetteer" in layers:
        ctes.append(gazetteer_ctes())
        sels.append(f"SELECT {SPAN_COLS} FROM gazetteer_spans")
    if "scored" in layers:
        ctes.append(scored_ctes())
        sels.append(f"SELECT {SPAN_COLS} FROM scored_spans")
    ctes.append("candidates AS (\n  " + "\n  UNION ALL ".join(sels) + "\n)")
    ctes.append(f"""filtered AS (
  SELECT * FROM candidates
  WHERE NOT {blocklisted('text')} AND NOT {short_name('entity_type', 'text')}
    AND NOT {numeric_dob('entity_type', 'source', 'text')}
),
resolved_lists AS (
  SELECT doc_id, segment_index, {resolve_list(f'list({SPAN_STRUCT})')} AS r FROM filtered GROUP BY doc_id, segment_index
),
resolved_u AS (SELECT doc_id, segment_index, unnest(r) AS s FROM resolved_lists),
resolved AS (
  SELECT doc_id, segment_index, CAST(s.s_start AS BIGINT) AS "start", CAST(s.s_end AS BIGINT) AS "end",
         s.etype AS entity_type, s.txt AS text, s.score AS score, s.source AS source, CAST(s.prio AS BIGINT) AS prio
  FROM resolved_u
),
preds AS (
  SELECT doc_id, segment_index, "start", "end", entity_type, {strip('text')} AS text, score, source FROM resolved
  WHERE length({strip('text')}) > 0
)""")
    return ",".join(ctes)


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip().rstrip(",") for c in ctes if c.strip())


def full(body: str, layers=("regex", "gazetteer", "scored"), sources=("documents", "planted")) -> str:
    return with_(base_ctes(sources), pipeline_ctes(layers)) + "\n" + body


# --- surrogates -------------------------------------------------------------------

def salt_sql(scope: str = "corpus", doc_id: str = "doc_id") -> str:
    if scope == "document":
        return f"concat({lit(P.SURROGATE_SALT)}, '::', CAST({doc_id} AS VARCHAR))"
    return lit(P.SURROGATE_SALT)


def consistency_key(etype: str, orig: str) -> str:
    return f"concat_ws('::', {etype}, {normalize(orig)})"


def surrogate(etype: str, orig: str, salt: str | None = None) -> str:
    salt = salt or lit(P.SURROGATE_SALT)
    md = f"md5(concat({salt}, '::', {consistency_key(etype, orig)}))"
    h = [f"CAST(('0x' || substring({md}, {8 * i + 1}, 8)) AS BIGINT)" for i in range(4)]

    def pick(pool, hx):
        return f"{str_list(pool)}[CAST({hx} % {len(pool)} + 1 AS INTEGER)]"

    first, last = pick(P.FIRST_NAMES, h[0]), pick(P.LAST_NAMES, h[1])
    payload = f"concat('4', {lpad(f'{h[0]} % 10000000', 7)}, {lpad(f'{h[1]} % 10000000', 7)})"
    return f"""(CASE
  WHEN {etype} = 'PERSON' THEN concat({first}, ' ', {last})
  WHEN {etype} = 'EMAIL' THEN concat(lower({first}), '.', lower({last}), CAST({h[2]} % 100 AS VARCHAR), '@', {pick(P.EMAIL_DOMAINS, h[3])})
  WHEN {etype} = 'PHONE' THEN concat('(', CAST(200 + {h[0]} % 800 AS VARCHAR), ') 555-', {lpad(f'{h[1]} % 10000', 4)})
  WHEN {etype} = 'ORG' THEN concat({pick(P.COMPANY_WORDS, h[0])}, ' ', {pick(P.COMPANY_SUFFIXES, h[1])})
  WHEN {etype} = 'ADDRESS' THEN {pick(P.CITIES, h[0])}
  WHEN {etype} = 'SSN' THEN concat({lpad(f'1 + {h[0]} % 665', 3)}, '-', {lpad(f'1 + {h[1]} % 99', 2)}, '-', {lpad(f'1 + {h[2]} % 9999', 4)})
  WHEN {etype} = 'CREDIT_CARD' THEN concat({payload}, CAST({luhn_check_digit(payload)} AS VARCHAR))
  WHEN {etype} = 'DATE_OF_BIRTH' THEN strftime(DATE '{P.SURROGATE_AS_OF}' - CAST(6575 + {h[0]} % 22645 AS INTEGER), '%m/%d/%Y')
  WHEN {etype} = 'IP_ADDRESS' THEN concat('10.', CAST({h[0]} % 256 AS VARCHAR), '.', CAST({h[1]} % 256 AS VARCHAR), '.', CAST(1 + {h[2]} % 254 AS VARCHAR))
  ELSE concat('[REDACTED_', {etype}, ']') END)"""


PAIRS_CTE = f"""pairs AS (
  SELECT doc_id, original, f.entity_type AS entity_type, f.segment_index AS first_segment, f."start" AS first_start,
         {surrogate('f.entity_type', 'original')} AS surrogate
  FROM (SELECT doc_id, text AS original, min({{'segment_index': segment_index, 'start': "start", 'entity_type': entity_type}}) AS f
        FROM preds GROUP BY doc_id, text)
)"""

PAIRS_DOC_CTE = PAIRS_CTE.replace("pairs AS", "pairs_doc AS").replace(
    surrogate('f.entity_type', 'original'), surrogate('f.entity_type', 'original', salt_sql('document')))

REDACT_SPANS_CTE = f"""{PAIRS_CTE},
red_spans AS (
  SELECT p.doc_id, p.segment_index,
         list_sort(list({{'b': p."start", 'e': p."end", 'sur': o.surrogate}})) AS sp
  FROM preds p JOIN pairs o ON p.doc_id = o.doc_id AND p.text = o.original GROUP BY p.doc_id, p.segment_index
),
red_fold AS (
  SELECT s.doc_id, s.segment_index, s.paragraph_index, s.cell_index, s.text,
         CASE WHEN r.sp IS NULL THEN s.text ELSE
           (SELECT f.out || substring(s.text, f.pos + 1)
            FROM (SELECT list_reduce(r.sp, lambda acc, x: {{'pos': x.e, 'out': acc.out || substring(s.text, acc.pos + 1, x.b - acc.pos) || x.sur}},
                                     {{'pos': CAST(0 AS BIGINT), 'out': ''}}) AS f)) END AS redacted
  FROM segments s LEFT JOIN red_spans r ON s.doc_id = r.doc_id AND s.segment_index = r.segment_index
)"""

REPLACE_FIRST = ("CASE WHEN instr({t}, {o}) > 0 THEN substring({t}, 1, instr({t}, {o}) - 1) || {r} || "
                 "substring({t}, instr({t}, {o}) + length({o})) ELSE {t} END")

REDACT_LITERAL_CTE = f"""pair_lists AS (
  SELECT doc_id, list_sort(list({{'k_len': -length(original), 'k_seg': first_segment, 'k_start': first_start,
                                   'o': original, 'r': surrogate}})) AS pl
  FROM pairs GROUP BY doc_id
),
red_literal AS (
  SELECT s.doc_id, s.segment_index, s.text,
         CASE WHEN p.pl IS NULL THEN s.text ELSE
           list_reduce(p.pl, lambda t, x: {REPLACE_FIRST.format(t='t', o='x.o', r='x.r')}, s.text) END AS redacted
  FROM segments s LEFT JOIN pair_lists p ON s.doc_id = p.doc_id
)"""

PLACE = """concat_ws(' ', doc_id, segment_index, "start", "end")"""

EVAL_CTES = f"""gt AS (SELECT entity_type, {normalize('text')} AS norm FROM planted_truth),
pr AS (SELECT entity_type, {normalize('text')} AS norm FROM preds),
gk AS (SELECT DISTINCT entity_type, norm FROM gt),
pk AS (SELECT DISTINCT entity_type, norm FROM pr),
types AS (SELECT entity_type FROM gt UNION SELECT entity_type FROM pr),
tp AS (SELECT pk.entity_type, count(*) AS tp FROM pk SEMI JOIN gk ON pk.entity_type = gk.entity_type AND pk.norm = gk.norm GROUP BY pk.entity_type),
fp AS (SELECT pr.entity_type, count(*) AS fp FROM pr ANTI JOIN gk ON pr.entity_type = gk.entity_type AND pr.norm = gk.norm GROUP BY pr.entity_type),
fn AS (SELECT gt.entity_type, count(*) AS fn FROM gt ANTI JOIN pk ON gt.entity_type = pk.entity_type AND gt.norm = pk.norm GROUP BY gt.entity_type),
counts AS (
  SELECT t.entity_type, CAST(coalesce(tp.tp, 0) AS BIGINT) AS tp, CAST(coalesce(fp.fp, 0) AS BIGINT) AS fp,
         CAST(coalesce(fn.fn, 0) AS BIGINT) AS fn
  FROM types t LEFT JOIN tp USING (entity_type) LEFT JOIN fp USING (entity_type) LEFT JOIN fn USING (entity_type)
),
counts_all AS (
  SELECT * FROM counts
  UNION ALL SELECT 'AGGREGATE', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM counts
),
m1 AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN {dbl(0.0)} ELSE tp / (tp + fp) END AS precision,
            CASE WHEN tp + fn = 0 THEN {dbl(0.0)} ELSE tp / (tp + fn) END AS recall,
            CASE WHEN tp + fp + fn = 0 THEN {dbl(0.0)} ELSE tp / (tp + fp + fn) END AS accuracy
  FROM counts_all
),
metrics AS (
  SELECT entity_type, tp, fp, fn, precision, recall,
         CASE WHEN precision + recall = 0 THEN {dbl(0.0)} ELSE {dbl(2.0)} * precision * recall / (precision + recall) END AS f1,
         accuracy
  FROM m1
)"""


# --- the oracle strings ---------------------------------------------------------------

def _detect_one(etype: str) -> str:
    c, _ = regex_ctes([etype])
    return with_(base_ctes(), c) + '\nSELECT doc_id, segment_index, "start", "end", text FROM regex_spans'


def _filter_report(cond: str) -> str:
    return full(f"SELECT entity_type, source, count(*) AS n_in, CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS n_removed "
                f"FROM candidates GROUP BY entity_type, source")


def _surrogate_of(etype: str) -> str:
    return full(f"SELECT original, {surrogate(lit(etype), 'original')} AS surrogate "
                f"FROM (SELECT DISTINCT text AS original FROM preds WHERE entity_type = '{etype}')")


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["src_documents"] = with_(planted_ctes(), corpus_cte(("documents", "planted", "pages", "conversations"))) + f"""
SELECT 'documents' AS source, doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents
UNION ALL SELECT 'planted', doc_id, length(text), len(string_split(text, chr(10))) FROM planted
UNION ALL SELECT 'pages', page_id + {PAGES_FROM}, length(html), len(string_split(html, chr(10))) FROM pages
UNION ALL SELECT 'conversations', conv_id * 1000000 + turn + {TURNS_FROM}, length(text), len(string_split(text, chr(10))) FROM conversations"""
    q["segments_body"] = with_(base_ctes(which="body")) + "\nSELECT doc_id, segment_index, paragraph_index, text FROM segments"
    cells = "SELECT doc_id, segment_index, table_index, row_index, cell_index, text FROM segments"
    for k, (name, key, columns) in enumerate([("customer", "c_custkey", ["c_name", "c_mktsegment"]), ("supplier", "s_suppkey", ["s_name"]),
                                              ("orders", "o_orderkey", ["o_orderstatus", "o_orderpriority"])], 1):
        for j, c in enumerate(columns):
            cells += (f"\nUNION ALL SELECT {key}, {j}, {k}, {key}, {j}, CAST({c} AS VARCHAR) FROM {name} "
                      f"WHERE regexp_matches(CAST({c} AS VARCHAR), '{NONBLANK}')")
    q["segments_cells"] = with_(base_ctes(which="cells")) + "\n" + cells
    q["segments_all"] = with_(base_ctes()) + \
        "\nSELECT doc_id, segment_index, paragraph_index, table_index, row_index, cell_index, is_table_cell, text FROM segments"
    q["predictions"] = full('SELECT doc_id, segment_index, "start", "end", entity_type, text, score, source FROM preds')
    q["redacted_documents"] = with_(base_ctes(), pipeline_ctes(), REDACT_SPANS_CTE) + """
SELECT t.doc_id, t.text, c.cells
FROM (SELECT l.doc_id, string_agg(coalesce(r.redacted, l.line), chr(10) ORDER BY l.idx) AS text
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM corpus) l
      LEFT JOIN red_fold r ON l.doc_id = r.doc_id AND l.idx = r.paragraph_index GROUP BY l.doc_id) t
LEFT JOIN (SELECT l.doc_id, string_agg(coalesce(r.redacted, l.cell), chr(9) ORDER BY l.idx) AS cells
      FROM (SELECT doc_id, unnest(cells) AS cell, generate_subscripts(cells, 1) - 1 AS idx FROM corpus WHERE cells IS NOT NULL) l
      LEFT JOIN red_fold r ON l.doc_id = r.doc_id AND l.idx = r.cell_index GROUP BY l.doc_id) c ON t.doc_id = c.doc_id"""
    q["normalize_values"] = full(f'SELECT doc_id, segment_index, "start", entity_type, {strip("text")} AS stripped, '
                                 f'{normalize("text")} AS norm FROM candidates')
    q["label_map"] = with_(base_ctes(), scored_ctes()) + """
SELECT s.doc_id, s.segment_index, s."start", s."end", s.entity_type AS label, lm.mapped AS entity_type, s.score
FROM scored_raw s JOIN """ + label_values() + " ON s.entity_type = lm.label"
    q["score_threshold"] = with_(base_ctes(), scored_ctes()) + \
        '\nSELECT doc_id, segment_index, "start", "end", entity_type AS label, score FROM scored_raw'
    q["blocklist_filter"] = _filter_report(blocklisted("text"))
    q["short_name_filter"] = _filter_report(short_name("entity_type", "text"))
    q["numeric_dob_filter"] = _filter_report(numeric_dob("entity_type", "source", "text"))
    etype, pat, ic = P.REGEX_PATTERNS[3]
    q["luhn_valid_cards"] = with_(base_ctes(), located("cards", P.re2_pattern(pat, ic), "1 AS one", "ascii_digits")) + \
        f'\nSELECT doc_id, segment_index, "start", text, {luhn_ok(digits_only("text"))} AS luhn_ok FROM cards'
    q["span_text_check"] = full("""SELECT r.entity_type, count(*) AS n_spans,
  CAST(sum(CASE WHEN substring(s.text, r."start" + 1, r."end" - r."start") = r.text THEN 1 ELSE 0 END) AS BIGINT) AS n_ok
FROM resolved r JOIN segments s ON r.doc_id = s.doc_id AND r.segment_index = s.segment_index GROUP BY r.entity_type""")
    for key, et in [("detect_email", "EMAIL"), ("detect_ssn", "SSN"), ("detect_ip", "IP_ADDRESS"),
                    ("detect_credit_card", "CREDIT_CARD"), ("detect_dob", "DATE_OF_BIRTH"), ("detect_phone", "PHONE")]:
        q[key] = _detect_one(et)
    rc, _ = regex_ctes()
    regex_out = 'SELECT doc_id, segment_index, "start", "end", entity_type, text, CAST(prio AS BIGINT) AS prio FROM '
    q["regex_spans"] = with_(base_ctes(), rc) + "\n" + regex_out + "regex_spans"
    q["gazetteer_spans"] = with_(base_ctes(), gazetteer_ctes()) + "\n" + regex_out + "gazetteer_spans"
    q["scored_spans"] = with_(base_ctes(), scored_ctes()) + \
        '\nSELECT doc_id, segment_index, "start", "end", entity_type, text, score, CAST(prio AS BIGINT) AS prio FROM scored_spans'
    q["spans_union"] = full(f"SELECT doc_id, segment_index, \"start\", \"end\", entity_type, text, score, source, "
                            f"CAST(prio AS BIGINT) AS prio FROM candidates")
    q["hybrid_spans"] = full(f"SELECT {SPAN_COLS} FROM resolved")
    q["detect_distinct"] = q["regex_spans"]
    q["plugin_spans"] = with_(base_ctes(), located("secrets", SECRET_PATTERN, "'SECRET' AS entity_type")) + """
SELECT doc_id, segment_index, "start", "end", entity_type, text FROM secrets
WHERE regexp_matches(text, '[A-Za-z]') AND regexp_matches(text, '[0-9]')"""
    q["web_spans"] = full(f"SELECT {SPAN_COLS} FROM resolved", sources=("pages", "conversations"))
    # every segment's spans once, in a list, and pairs from that: a join would find the spans twice
    q["overlap_pairs"] = full("""SELECT doc_id, segment_index, a.s AS a_start, a.e AS a_end, a.t AS a_entity_type, a.src AS a_source,
  b.s AS b_start, b.e AS b_end, b.t AS b_entity_type, b.src AS b_source
FROM (SELECT doc_id, segment_index, a, unnest(l) AS b FROM (
  SELECT doc_id, segment_index, l, unnest(l) AS a FROM (
    SELECT doc_id, segment_index, list({'s': "start", 'e': "end", 'p': prio, 't': entity_type, 'src': source}) AS l
    FROM filtered GROUP BY ALL HAVING count(*) > 1)))
WHERE a.s < b.e AND b.s < a.e AND {'s': a.s, 'e': a.e, 'p': a.p, 't': a.t} < {'s': b.s, 'e': b.e, 'p': b.p, 't': b.t}""")
    q["resolve_overlaps"] = full(f"SELECT {SPAN_COLS} FROM resolved")
    q["overlap_islands"] = full("""SELECT doc_id, segment_index, "start", "end", entity_type, CAST(prio AS BIGINT) AS prio,
  CAST(sum(CASE WHEN pe IS NULL OR "start" >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, segment_index
       ORDER BY "start", "start" - "end", -score, prio ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS island
FROM (SELECT *, max("end") OVER (PARTITION BY doc_id, segment_index ORDER BY "start", "start" - "end", -score, prio
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM filtered)""")
    q["replacement_hits"] = with_(base_ctes(), pipeline_ctes(), PAIRS_CTE) + """
SELECT s.doc_id, s.segment_index, p.original FROM segments s JOIN pairs p ON s.doc_id = p.doc_id WHERE instr(s.text, p.original) > 0"""
    q["first_occurrence"] = full("""SELECT doc_id, text AS original, segment_index, "start", entity_type FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY segment_index, "start") AS rn FROM preds) WHERE rn = 1""")
    q["consistency_keys"] = full(f'SELECT doc_id, segment_index, "start", {consistency_key("entity_type", "text")} AS key FROM preds')
    q["surrogates"] = full(f"SELECT entity_type, original, {surrogate('entity_type', 'original')} AS surrogate "
                           f"FROM (SELECT DISTINCT entity_type, text AS original FROM preds)")
    for key, et in [("surrogate_person", "PERSON"), ("surrogate_email", "EMAIL"), ("surrogate_phone", "PHONE"),
                    ("surrogate_org", "ORG"), ("surrogate_address", "ADDRESS"), ("surrogate_ssn", "SSN"),
                    ("surrogate_card", "CREDIT_CARD"), ("surrogate_dob", "DATE_OF_BIRTH"), ("surrogate_ip", "IP_ADDRESS")]:
        q[key] = _surrogate_of(et)
    q["surrogate_fallback"] = with_(base_ctes(), scored_ctes()) + \
        f"\nSELECT label, original, {surrogate('label', 'original')} AS surrogate FROM (SELECT DISTINCT entity_type AS label, text AS original FROM scored_raw)"
    q["replacement_pairs"] = with_(base_ctes(), pipeline_ctes(), PAIRS_CTE) + \
        "\nSELECT doc_id, original, entity_type, first_segment, first_start, surrogate FROM pairs"
    q["cache_size"] = with_(base_ctes(), pipeline_ctes(), PAIRS_CTE) + \
        f"\nSELECT doc_id, count(DISTINCT (entity_type, {normalize('original')})) AS cache_size FROM pairs GROUP BY doc_id"
    q["surrogates_doc_scope"] = with_(base_ctes(), pipeline_ctes(), PAIRS_DOC_CTE) + \
        "\nSELECT doc_id, original, entity_type, first_segment, first_start, surrogate FROM pairs_doc"
    q["replace_first"] = with_(base_ctes(), pipeline_ctes(), PAIRS_CTE) + f"""
SELECT s.doc_id, s.segment_index, p.original, {REPLACE_FIRST.format(t='s.text', o='p.original', r='p.surrogate')} AS replaced
FROM segments s JOIN pairs p ON s.doc_id = p.doc_id WHERE instr(s.text, p.original) > 0"""
    q["redact_literal"] = with_(base_ctes(), pipeline_ctes(), PAIRS_CTE, REDACT_LITERAL_CTE) + \
        "\nSELECT doc_id, segment_index, redacted FROM red_literal"
    q["redact_spans"] = with_(base_ctes(), pipeline_ctes(), REDACT_SPANS_CTE) + \
        "\nSELECT doc_id, segment_index, redacted FROM red_fold"
    q["leak_audit"] = with_(base_ctes(), pipeline_ctes(), PAIRS_CTE, REDACT_LITERAL_CTE) + """
SELECT r.doc_id, r.segment_index, p.original FROM red_literal r JOIN pairs p ON p.doc_id = r.doc_id
WHERE instr(r.redacted, p.original) > 0"""
    # the pipeline once more, in a query of its own in which the segments are the rewritten ones
    again = with_("segments AS (SELECT doc_id, segment_index, redacted AS text FROM rewritten)", pipeline_ctes()) + "\nSELECT doc_id, segment_index, text FROM preds"
    q["leak_redetect"] = with_(base_ctes(), pipeline_ctes(), PAIRS_CTE, REDACT_LITERAL_CTE,
                               "rewritten AS MATERIALIZED (SELECT doc_id, segment_index, redacted FROM red_literal)",
                               "kept_pairs AS MATERIALIZED (SELECT doc_id, original FROM pairs)") + f"""
SELECT DISTINCT a.doc_id, a.segment_index, a.text AS original FROM ({again}) a
WHERE EXISTS (SELECT 1 FROM kept_pairs p WHERE p.doc_id = a.doc_id AND p.original = a.text)"""
    q["entity_counts"] = full("SELECT entity_type, count(*) AS n FROM preds GROUP BY entity_type")
    q["entity_summary"] = full("""SELECT entity_type, count(*) AS n FROM preds GROUP BY entity_type
UNION ALL SELECT 'TOTAL', count(*) FROM preds""")
    q["corpus_stats"] = full("""SELECT (SELECT count(*) FROM corpus) AS n_documents, (SELECT count(*) FROM segments) AS n_segments,
  (SELECT count(*) FROM (SELECT DISTINCT doc_id, text FROM preds)) AS n_unique_values""")
    ev = with_(base_ctes(), pipeline_ctes(), planted_truth_cte(), EVAL_CTES)
    q["eval_types"] = ev + "\nSELECT entity_type FROM types"
    q["eval_tp"] = ev + "\nSELECT entity_type, tp FROM counts"
    q["eval_fp"] = ev + "\nSELECT entity_type, fp FROM counts"
    q["eval_fn"] = ev + "\nSELECT entity_type, fn FROM counts"
    q["eval_metrics"] = ev + "\nSELECT entity_type, tp, fp, fn, precision, recall, f1, accuracy FROM metrics"
    by_place = EVAL_CTES.replace(f"{normalize('text')} AS norm FROM planted_truth", PLACE + " AS norm FROM planted_truth").replace(
        f"{normalize('text')} AS norm FROM preds", PLACE + " AS norm FROM preds WHERE doc_id < 0")
    q["eval_annotated"] = with_(base_ctes(), pipeline_ctes(), planted_truth_cte(), by_place) + \
        "\nSELECT entity_type, tp, fp, fn, precision, recall, f1, accuracy FROM metrics"
    q["eval_report"] = ev + """
SELECT entity_type, precision, recall, f1, accuracy, tp, fp, fn,
       CASE WHEN entity_type = 'AGGREGATE' THEN 1 ELSE 0 END AS is_aggregate
FROM metrics ORDER BY is_aggregate, entity_type"""
    q["json_roundtrip"] = q["predictions"]
    q["stream_redact"] = with_(base_ctes(("documents",)), pipeline_ctes(),
                               REDACT_SPANS_CTE) + "\nSELECT doc_id, segment_index, redacted FROM red_fold"
    ev_text = ("concat('user u', CAST(user_id AS VARCHAR), '@mail.example.com from 10.0.', "
               "CAST(user_id % 256 AS VARCHAR), '.', CAST(event_id % 256 AS VARCHAR))")
    q["stream_entity_counts"] = with_(
        f"segments AS (SELECT event_id AS doc_id, CAST(0 AS BIGINT) AS segment_index, {ev_text} AS text, ts FROM events)",
        regex_ctes()[0]) + """
SELECT strftime(date_trunc('day', e.ts), '%Y-%m-%d %H:%M:%S') AS window_start, r.entity_type, count(*) AS n
FROM regex_spans r JOIN events e ON r.doc_id = e.event_id
GROUP BY 1, 2"""
    return q


ORACLES = build()
