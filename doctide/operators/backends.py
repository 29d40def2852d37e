"""Rule expressions are written once, against these two backends: SQL text for DuckDB, and for Spark.

Spark gets text as well: it parses a rule in a millisecond, where building its hundreds
of nodes one call at a time would take longer than running it on a small table.
"""

from __future__ import annotations

from doctide.functions.patterns import CHUNK


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class Sql(str):
    """SQL text, as against a literal."""


class SqlBackend:
    """The same as DuckDB text; patterns are RE2."""

    @property
    def txt(self):
        return Sql("txt")

    def g(self, k):
        return Sql(f"g{k}")

    @property
    def math(self):
        return "((length(ctx)-length(replace(ctx,'$','')))-(length(ctx)-length(replace(ctx,'\\$','')))/2)%2=1"

    def lit(self, x):
        return Sql(quote(x) if isinstance(x, str) else str(x))

    def cat(self, *parts):
        return Sql("(" + "||".join(p if isinstance(p, Sql) else quote(p) for p in parts) + ")")

    def when(self, condition, yes, no):
        yes, no = (x if isinstance(x, Sql) else quote(x) for x in (yes, no))
        return Sql(f"CASE WHEN {condition} THEN {yes} ELSE {no} END")

    def eq(self, x, value):
        return f"({x} = {quote(value)})"

    def has(self, x, java, sql=None):
        return f"regexp_matches({x}, {quote(sql or java)})"

    def sub(self, x, java, new, sql=None, sql_new=None):
        return Sql(f"regexp_replace({x}, {quote(sql or java)}, {quote(sql_new if sql_new is not None else new)}, 'g')")

    def replace(self, x, old, new):
        return Sql(f"replace({x}, {quote(old)}, {quote(new)})")

    def lower(self, x):
        return Sql(f"lower({x})")

    def strip(self, x):
        return Sql(f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')")

    def part(self, x, java, k, sql=None):
        return Sql(f"regexp_extract({x}, {quote(sql or java)}, {k})")

    def head(self, x, n_off):
        return Sql(f"substr({x}, 1, length({x}) - {n_off})")

    def length(self, x):
        return Sql(f"length({x})")

    def both(self, *c):
        return "(" + " AND ".join(c) + ")"

    def no(self, c):
        return f"(NOT {c})"

    def before(self, n):
        return Sql(f"substr(body, CAST(greatest(start - {n}, 0) + 1 AS BIGINT), CAST(least(start, {n}) AS BIGINT))")

    def count(self, x, java, sql=None):
        return Sql(f"len(regexp_extract_all({x}, {quote(sql or java)}))")

    def at_least(self, x, y):
        return f"({x} >= {y})"

    def between(self, x, low, high):
        return f"(CAST({x} AS INTEGER) BETWEEN {low} AND {high})"


def spark_quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


MATCHES = "array<struct<start:int,line:int,txt:string,g:array<string>{ctx}>>"
#: Characters before a match that say whether it stands in math mode.
CONTEXT = 200


def _newlines(x: str) -> str:
    return f"(length({x}) - length(replace({x}, '\\n', '')))"


class SparkBackend(SqlBackend):
    """Spark SQL over a match e in the document body; patterns are Java's."""

    def __init__(self, body: str):
        self.body = body

    @property
    def txt(self):
        return Sql("e.txt")

    def g(self, k):
        return Sql(f"e.g[{k - 1}]")

    @property
    def math(self):
        c = self.before(200)
        return f"((length({c}) - length(replace({c}, '$', ''))) - (length({c}) - length(replace({c}, '\\\\$', ''))) / 2) % 2 = 1"

    def lit(self, x):
        return Sql(spark_quote(x) if isinstance(x, str) else str(x))

    def cat(self, *parts):
        return Sql("concat(" + ", ".join(p if isinstance(p, Sql) else spark_quote(p) for p in parts) + ")")

    def when(self, condition, yes, no):
        yes, no = (x if isinstance(x, Sql) else spark_quote(x) for x in (yes, no))
        return Sql(f"CASE WHEN {condition} THEN {yes} ELSE {no} END")

    def eq(self, x, value):
        return f"({x} = {spark_quote(value)})"

    def has(self, x, java, sql=None):
        return f"({x} RLIKE {spark_quote(java)})"

    def sub(self, x, java, new, sql=None, sql_new=None):
        return Sql(f"regexp_replace({x}, {spark_quote(java)}, {spark_quote(new)})")

    def replace(self, x, old, new):
        return Sql(f"replace({x}, {spark_quote(old)}, {spark_quote(new)})")

    def strip(self, x):
        return self.sub(x, r"(?U)^\s+|\s+$", "")

    def part(self, x, java, k, sql=None):
        return Sql(f"regexp_extract({x}, {spark_quote(java)}, {k})")

    def before(self, n):
        return Sql(f"right(e.ctx, {n})")

    def count(self, x, java, sql=None):
        return Sql(f"regexp_count({x}, {spark_quote(java)})")

    def matches(self, pattern: str, groups: int, context: bool = False) -> str:
        """All matches in order, as functions.patterns.found gives them; with context, ctx: what stands before each.

        The context goes along from match to match: to cut it out of the body would take time in the match's place.
        """
        b, p = self.body, spark_quote(pattern)
        every = ", ".join(f"regexp_extract_all({b}, {p}, {k})" for k in range(1, groups + 1))
        own = ", ".join(f"z.`{k + 1}`" for k in range(1, groups + 1))
        rows = f"arrays_zip(regexp_extract_all({b}, {p}, 0), split({b}, {p}, -1){', ' + every if every else ''})"
        start, line = "a.start + length(z.`1`)", f"a.line + {_newlines('z.`1`')}"
        before = f"right(concat(a.ctx, right(z.`1`, {CONTEXT})), {CONTEXT})"
        after = f", 'ctx', right(concat({before}, right(z.`0`, {CONTEXT})), {CONTEXT})" if context else ""
        end = f"'start', {start} + length(z.`0`), 'line', {line} + {_newlines('z.`0`')}{after}"
        one = (f"named_struct('start', {start}, 'line', {line}, 'txt', z.`0`, 'g', CAST(array({own}) AS array<string>)"
               f"{f', {chr(39)}ctx{chr(39)}, {before}' if context else ''})")
        none = f"CAST(array() AS {MATCHES.replace('{ctx}', ',ctx:string' if context else '')})"
        first, kind, known = ", 'ctx', ''" if context else "", ",ctx:string" if context else "", ", 'ctx', s[k].ctx" if context else ""
        zero = f"named_struct('start', 0, 'line', 1{first})"
        # in chunks, as functions.patterns.fold does
        chunks = f"transform(sequence(0, (size(r) - 1) div {CHUNK}), k -> slice(r, CAST(k * {CHUNK} + 1 AS INT), {CHUNK}))"
        states = (f"aggregate(c, named_struct('now', {zero}, 'every', CAST(array() AS array<struct<start:int,line:int{kind}>>)), (o, i) -> named_struct("
                  f"'now', aggregate(i, o.now, (a, z) -> IF(z.`0` IS NULL, a, named_struct({end}))), 'every', concat(o.every, array(o.now))), o -> o.every)")
        parts = (f"transform(c, (i, k) -> aggregate(i, named_struct('start', s[k].start, 'line', s[k].line{known}, 'out', {none}), (a, z) -> "
                 f"IF(z.`0` IS NULL, a, named_struct({end}, 'out', concat(a.out, array({one})))), a -> a.out))")
        let = lambda name, value, then: f"element_at(transform(array({value}), {name} -> {then}), 1)"
        return f"CASE WHEN {b} RLIKE {p} THEN {let('r', rows, let('c', chunks, let('s', states, f'flatten({parts})')))} ELSE {none} END"
