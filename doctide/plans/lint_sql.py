"""DuckDB statements for the lint queries.

Rules made of detectors are generated from the rule's own definition with the SQL
backend; line rules are written out.  Patterns are RE2.
"""

from __future__ import annotations

from doctide.operators.backends import SqlBackend, quote
from doctide.operators.rules import BY_NAME, LABEL, MARKER, NUMBER, STOPS_UNWRAPPED_MATH, UNWRAPPED_MATH
from doctide.plans.corpus import injected_sql

COLUMNS = "doc_id, line, start, old_text, new_text, detail"
LOOKAROUND = ("(?<!", "(?!", "\\2", "\\1")


def _detector(d) -> str:
    b, p = SqlBackend(), quote(d.sql or d.pattern)
    if any(x in (d.sql or d.pattern) for x in LOOKAROUND):
        raise ValueError("no RE2 form")
    groups_ = d.sql_groups or d.groups
    groups = "".join(f", regexp_extract_all(body, {p}, {k}) ga{k}" for k in range(1, groups_ + 1))
    each = "".join(f", coalesce(ga{k}[i], '') g{k}" for k in range(1, groups_ + 1))
    rule_keep = d.sql_keep or d.keep
    keep = rule_keep(b) if rule_keep else "true"
    new = d.new(b) if d.new else "NULL"
    return f"""SELECT doc_id, CAST(1 + length(pre) - length(replace(pre, chr(10), '')) AS INTEGER) AS line, CAST(start AS INTEGER) AS start,
 txt AS old_text, {new} AS new_text, CAST(NULL AS VARCHAR) AS detail FROM (
 SELECT *, length(pre) AS start, substr(body, CAST(greatest(length(pre) - 200, 0) + 1 AS BIGINT), CAST(least(length(pre), 200) AS BIGINT)) AS ctx FROM (
 SELECT doc_id, body, ma[i] AS txt{each}, coalesce(array_to_string(ba[1:i], ''), '') || coalesce(array_to_string(ma[1:i-1], ''), '') AS pre0,
 body[1:CAST(length(coalesce(array_to_string(ba[1:i], ''), '')) + length(coalesce(array_to_string(ma[1:i-1], ''), '')) AS BIGINT)] AS pre
 FROM (SELECT doc_id, body, regexp_extract_all(body, {p}) ma, string_split_regex(body, {p}) ba{groups}
 FROM d WHERE regexp_matches(body, {p})) a, unnest(range(1, len(ma) + 1)) u(i)) x) y WHERE {keep}"""


def _lines(keep: str, old: str = "s", new: str = "NULL", detail: str = "NULL") -> str:
    return f"""SELECT doc_id, CAST(i AS INTEGER) AS line, CAST(NULL AS INTEGER) AS start, CAST({old} AS VARCHAR) AS old_text,
 CAST({new} AS VARCHAR) AS new_text, CAST({detail} AS VARCHAR) AS detail FROM l WHERE {keep}"""


LINES = """l AS (SELECT doc_id, body, i, la[i] AS s FROM (SELECT doc_id, body, string_split(body, chr(10)) la FROM d) q,
 unnest(range(1, len(la) + 1)) u(i))"""
R = r"regexp_replace({}, '\s+$', '')"
L = r"regexp_replace({}, '^\s+', '')"
T = r"regexp_replace(regexp_replace({}, '\s+$', ''), '^\s+', '')"
CELLS = "string_split(s, '|')[2:-2]"
EMPTY = "len(list_filter(" + CELLS + r", lambda c: regexp_replace(c, '\s+', '', 'g') = ''))"
FENCED = """f AS (SELECT *, coalesce(sum(CASE WHEN starts_with(""" + T.format("s") + """, '```') THEN 1 ELSE 0 END)
 OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fences FROM l)"""

OPEN = (r"NOT (regexp_matches(t, '[.!?:;\-\])}]$') OR starts_with(t, '#') OR ends_with(t, '$') OR "
        r"(regexp_matches(t, '\p{Lu}') AND NOT regexp_matches(t, '[\p{Ll}\p{Lt}]') AND length(t) < 100))")
UNWRAPPED = f"""n AS (SELECT *, {R.format('s')} AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE {T.format('s')} <> ''),
 c AS (SELECT *, lead(i) OVER w AS ni, lead(s) OVER w AS ns, coalesce({OPEN} AND regexp_matches({L.format('lead(s) OVER w')}, '^\\p{{Ll}}'), false) AS c
 FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
 g AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, c ORDER BY k) AS grp FROM c),
 o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY k) AS r FROM g WHERE c)
 SELECT doc_id, CAST(1 + length(p) - length(replace(p, chr(10), '')) AS INTEGER) AS line, CAST(NULL AS INTEGER) AS start,
 t || repeat(chr(10), CAST(ni - i AS BIGINT)) || ns AS old_text, t || ' ' || {L.format('ns')} AS new_text, CAST(NULL AS VARCHAR) AS detail
 FROM (SELECT *, substr(body, 1, instr(body, s) - 1) AS p FROM o WHERE r % 2 = 1) z"""
REPEATED = f"""r AS (SELECT doc_id, i, regexp_replace({T.format('s')}, '\\s+', ' ', 'g') AS t, {T.format('s')} AS x FROM l),
 k AS (SELECT doc_id, t, count(*) AS n, list(i ORDER BY i) AS seen FROM r WHERE length(x) BETWEEN 6 AND 59
 AND NOT regexp_matches(x, '^[#|\\-*>]') AND NOT starts_with(x, '<!--') AND NOT ends_with(x, '-->') GROUP BY doc_id, t HAVING count(*) >= 3)
 SELECT doc_id, CAST(seen[1] AS INTEGER) AS line, CAST(NULL AS INTEGER) AS start, CAST(NULL AS VARCHAR) AS old_text, CAST(NULL AS VARCHAR) AS new_text,
 n || ' ' || array_to_string(seen[1:5], ',') || ' ' || substr(t, 1, 50) AS detail FROM k"""
GARBLED = _lines(
    f"""length({T.format('s')}) BETWEEN 4 AND 40 AND NOT regexp_matches({T.format('s')}, '^[#\\-*|$\\\\>\\[]') AND NOT starts_with({T.format('s')}, '<!--')
 AND NOT ends_with({T.format('s')}, '-->') AND NOT regexp_matches({T.format('s')}, '^[\\p{{L}}\\p{{N}}_\\s.,;:!?''"()\\-–—]+$')
 AND NOT regexp_matches({T.format('s')}, '[∈∉⊂⊃∪∩∧∨∀∃→←↔≤≥≠≈∞∫∑∏√]') AND regexp_matches(lower({T.format('s')}), '[æœøåäöüßþðđ]')
 AND 10 * length(regexp_replace({T.format('s')}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 7 * length({T.format('s')})""",
    "NULL", "NULL", T.format("s"))

LINE_RULES = {
    "trailing_whitespace": (LINES, _lines(f"{R.format('s')} <> s", "s", R.format("s"))),
    "leading_whitespace": (f"{LINES}, {FENCED}", _lines(
        f"fences % 2 = 0 AND regexp_matches(s, '^[ \\t]') AND {T.format('s')} <> '' AND NOT starts_with({T.format('s')}, '```')",
        "s", L.format("s")).replace("FROM l WHERE", "FROM f WHERE")),
    "sparse_table_row": (LINES, _lines(
        f"regexp_matches(s, '^\\|.*\\|$') AND len({CELLS}) > 3 AND 2 * {EMPTY} > len({CELLS})", "NULL", "NULL", f"{EMPTY} || '/' || len({CELLS})")),
    "orphaned_list_marker": (LINES, _lines(f"regexp_matches(s, {quote(MARKER)})", "s || chr(10)", "''")),
    "unwrapped_sentences": (LINES, UNWRAPPED),
    "page_number": (LINES, _lines(
        f"CASE WHEN regexp_matches(s, {quote(NUMBER)}) THEN TRY_CAST({T.format('s')} AS INTEGER) BETWEEN 1 AND 999 ELSE false END", "s || chr(10)", "''")),
    "orphaned_label": (LINES, _lines(f"regexp_matches(s, {quote(LABEL)})", "s || chr(10)", "''")),
    "garbled_text": (LINES, GARBLED),
    "repeated_line": (LINES, REPEATED),
    "long_line": (LINES, _lines("length(s) > 500", "NULL", "NULL", "length(s) || ' ' || substr(s, 1, 60)")),
}


def statement(name: str) -> str | None:
    """The oracle of one rule; None where RE2 has no form of its patterns or the rule is sequential."""
    head = f"WITH d AS ({injected_sql()})"
    if name in LINE_RULES:
        tables, query = LINE_RULES[name]
        joint = ", " if query.startswith(("n AS", "r AS")) else " "
        return f"{head}, {tables}{joint}{query}"
    rule = BY_NAME[name]
    if name == "unwrapped_math_expressions":
        rows = " UNION ALL ".join(f"({_detector(d)})" for d in UNWRAPPED_MATH)
        return f"{head} SELECT * FROM ({rows}) r WHERE doc_id NOT IN (SELECT doc_id FROM ({_detector(STOPS_UNWRAPPED_MATH)}) s)"
    if rule.expression is not None:
        return None
    try:
        return head + " " + " UNION ALL ".join(f"({_detector(d)})" for d in rule.detectors)
    except ValueError:
        return None
