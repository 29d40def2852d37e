"""The lint rules, as array-valued expressions over a document body.

A rule gives an ordered array of issues.  Rules do not depend on each other, so linting
a corpus is one narrow projection however many rules run.  Names, severities, summaries,
patterns and replacement texts are fixed values: issues must be the same as of any other
implementation of these rules.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from doctide.functions.patterns import fold, found, let, lines, lstrip, newlines, rstrip, strip
from doctide.operators import symbols
from doctide.operators.symbol_table import SYMBOLS

ISSUE = "struct<line:int,start:int,old:string,new:string,detail:string>"
ISSUES = f"array<{ISSUE}>"
FIX, WARN, ERROR = "auto_fix", "warning", "error"


@dataclass
class Detector:
    """A pattern, what a match becomes, and when it counts.  sql: the pattern for RE2, where it differs."""

    pattern: str
    groups: int
    new: Callable | None
    keep: Callable | None = None
    sql: str | None = None
    old: Callable | None = None
    #: Literal that every match contains: texts without it are skipped before the pattern runs.
    needs: str | None = None
    #: Where the RE2 form takes in more than the match: its groups, and which matches are the rule's.
    sql_groups: int | None = None
    sql_keep: Callable | None = None


@dataclass
class Rule:
    name: str
    severity: str
    summary: str
    detectors: list[Detector] = field(default_factory=list)
    #: For rules that are no plain list of detectors.
    expression: Callable[[Column], Column] | None = None
    by_line: bool = False
    registered: bool = True


def issue(line, start, old, new, detail=None) -> Column:
    text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    return F.struct(line.cast("int").alias("line"), start.cast("int").alias("start"), text(old).alias("old"),
                    text(new).alias("new"), text(detail).alias("detail"))


def none() -> Column:
    return F.array().cast(ISSUES)


#: Column that detectors read.
BODY = "_body"


def detect(d: Detector) -> Column:
    """Issues of one detector over BODY."""
    from doctide.operators.backends import SparkBackend, spark_quote

    b = SparkBackend(BODY)
    old, new = d.old(b) if d.old else b.txt, d.new(b) if d.new else "CAST(NULL AS STRING)"
    keep = d.keep(b) if d.keep is not None else None
    matches = b.matches(d.pattern, d.groups, any("e.ctx" in x for x in (old, new, keep or "")))
    if keep:
        matches = f"filter({matches}, e -> {keep})"
    out = (f"transform({matches}, e -> named_struct('line', e.line, 'start', e.start, 'old', {old}, 'new', {new}, "
           "'detail', CAST(NULL AS STRING)))")
    if d.needs:
        out = f"CASE WHEN contains({BODY}, {spark_quote(d.needs)}) THEN {out} ELSE CAST(array() AS {ISSUES}) END"
    return F.expr(out)


def ordered(issues: Column) -> Column:
    """Stable by line."""
    placed = F.transform(issues, lambda x, k: F.struct(x["line"].alias("l"), k.alias("k"), x.alias("x")))
    return F.transform(F.array_sort(placed), lambda p: p["x"])


def evaluate(rule: Rule) -> Column:
    body = F.col(BODY)
    if rule.expression is not None:
        return rule.expression(body)
    parts = [detect(d) for d in rule.detectors]
    out = parts[0] if len(parts) == 1 else F.concat(*parts)
    return ordered(out) if rule.by_line else out


# -- line rules ------------------------------------------------------------------


def _line_rule(keep, old, new):
    def expression(body):
        return F.transform(F.filter(lines(body), lambda x: keep(x["s"])),
                           lambda x: issue(x["i"], F.lit(None), old(x["s"]) if old else None, new(x["s"]) if new else None))

    return expression


def _spaced(body):
    return _line_rule(lambda s: rstrip(s) != s, lambda s: s, rstrip)(body)


def _indented(body):
    """Outside of fences: a line's fences before it are counted in one pass."""
    def step(code, x):
        fence = strip(x["s"]).startswith("```")
        hit = ~code & ~fence & x["s"].rlike("^[ \t]") & (strip(x["s"]) != "")
        return code != fence, F.when(hit, issue(x["i"], F.lit(None), x["s"], lstrip(x["s"])))

    fenced = fold(lines(body), F.lit(False), ISSUE, step)
    plain = _line_rule(lambda s: s.rlike("^[ \t]") & (strip(s) != ""), lambda s: s, lstrip)(body)
    return F.when(~body.rlike("(?md)^[ \t]"), none()).when(F.contains(body, F.lit("```")), fenced).otherwise(plain)


def _cells(s):
    parts = F.split(s, r"\|", -1)
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))


def _empty(s):
    return F.size(F.filter(_cells(s), lambda c: strip(c) == ""))


def _sparse(body):
    def keep(s):
        return s.rlike(r"(?d)^\|.*\|$") & (F.size(_cells(s)) > 3) & (2 * _empty(s) > F.size(_cells(s)))

    return F.transform(F.filter(lines(body), lambda x: keep(x["s"])), lambda x: issue(
        x["i"], F.lit(None), None, None, F.concat_ws("/", _empty(x["s"]).cast("string"), F.size(_cells(x["s"])).cast("string"))))


def _dropped_line(pattern, keep=None):
    return _line_rule(lambda s: (s.rlike(pattern) & keep(s)) if keep else s.rlike(pattern),
                      lambda s: F.concat(s, F.lit("\n")), lambda s: F.lit(""))


def _unwrapped(body):
    """A line that does not end a sentence, whose next line with text starts in lower case; pairs do not overlap."""
    filled = F.filter(lines(body), lambda x: strip(x["s"]) != "")

    def open_ended(s):
        t = rstrip(s)
        capitals = t.rlike(r"\p{Lu}") & ~t.rlike(r"[\p{Ll}\p{Lt}]") & (F.length(t) < 100)
        return ~(t.rlike(r"[.!?:;\-\])}]$") | t.startswith("#") | capitals | t.endswith("$"))

    marked = F.transform(filled, lambda x: F.struct(
        x["i"].alias("i"), x["s"].alias("s"), open_ended(x["s"]).alias("open"),
        lstrip(x["s"]).rlike(r"^\p{Ll}").alias("low")))
    def step(last, x):
        join = last["open"] & x["low"]
        t = rstrip(last["s"])
        at = F.instr(body, last["s"])
        one = issue(newlines(F.substring(body, F.lit(1), at - 1)) + 1, F.lit(None),
                    F.concat(t, F.repeat(F.lit("\n"), x["i"] - last["i"]), x["s"]), F.concat(t, F.lit(" "), lstrip(x["s"])))
        return F.struct(x["i"].alias("i"), x["s"].alias("s"), (x["open"] & ~join).alias("open")), F.when(join, one)

    return fold(marked, F.struct(F.lit(0).alias("i"), F.lit("").alias("s"), F.lit(False).alias("open")), ISSUE, step)


def _garbled(body):
    def keep(s):
        t = strip(s)
        plain = t.rlike(r"(?U)^[\w\s.,;:!?'\"()\-–—]+$")
        letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
        return (
            F.length(t).between(4, 40) & ~t.rlike(r"^[#\-*|$\\>\[]") & ~t.startswith("<!--") & ~t.endswith("-->") & ~plain
            & ~t.rlike("[∈∉⊂⊃∪∩∧∨∀∃→←↔≤≥≠≈∞∫∑∏√]") & F.lower(t).rlike("[æœøåäöüßþðđ]") & (10 * letters < 7 * F.length(t)))

    return F.transform(F.filter(lines(body), lambda x: keep(x["s"])), lambda x: issue(x["i"], F.lit(None), None, None, strip(x["s"])))


def _repeated(body):
    """Lines that stand three times or more: equal ones are neighbours once sorted."""
    def keep(s):
        t = strip(s)
        return (F.length(t).between(6, 59) & ~t.rlike(r"^[#|\-*>]") & ~t.startswith("<!--") & ~t.endswith("-->"))

    known = F.transform(F.filter(lines(body), lambda x: keep(x["s"])), lambda x: F.struct(
        F.regexp_replace(strip(x["s"]), r"(?U)\s+", " ").alias("t"), x["i"].alias("i")))
    group = "struct<at:array<int>,t:string,n:int>"

    def closed(state):
        return F.when(state["n"] >= 3, F.struct(state["at"].alias("at"), state["t"].alias("t"), state["n"].alias("n")).cast(group))

    def step(state, x):
        same = state["t"].eqNullSafe(x["t"])
        first = F.when(F.size(state["at"]) < 5, F.concat(state["at"], F.array(x["i"]))).otherwise(state["at"])
        new = F.struct(x["t"].alias("t"), F.when(same, first).otherwise(F.array(x["i"])).alias("at"),
                       F.when(same, state["n"] + 1).otherwise(1).alias("n"))
        return new, F.when(~same, closed(state))

    start = F.struct(F.lit(None).cast("string").alias("t"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("n"))
    groups = F.array_sort(fold(F.array_sort(known), start, group, step, closed))
    return F.transform(groups, lambda g: issue(
        F.get(g["at"], F.lit(0)), F.lit(None), None, None,
        F.concat_ws(" ", g["n"].cast("string"), F.array_join(g["at"], ","), F.substring(g["t"], 1, 50))))


def _stray():
    def keep(b):
        back = b.before(200)
        count = lambda t: (b.count(back, f"(?i)</{t}>"), b.count(back, f"(?i)<{t}[\\s>]"))
        tests = []
        for t in ("span", "div", "p"):
            closers, openers = count(t)
            tests.append(b.both(b.eq(b.lower(b.txt), f"</{t}>"), b.at_least(closers, openers)))
        return tests

    return keep


def _any(backend, tests):
    return "(" + " OR ".join(tests) + ")"


def _math(*parts_of):
    """Replacement that is wrapped in dollar signs outside of math mode."""
    def new(b):
        inner = b.cat(*parts_of[0](b))
        return b.when(b.math, inner, b.cat("$", inner, "$"))

    return new


def _script(b, tag, inner):
    """^{inner} or _{inner}."""
    return b.when(b.eq(b.lower(tag), "sup"), b.cat("^{", inner, "}"), b.cat("_{", inner, "}"))


def _paired(extra=None, closing=4):
    def keep(b):
        same = b.eq(b.lower(b.g(closing)), "sup"), b.eq(b.lower(b.g(closing - 2)), "sup")
        equal = _any(b, [b.both(*same), b.both(b.no(same[0]), b.no(same[1]))])
        return b.both(equal, extra(b)) if extra else equal

    return keep


def _base_new(b):
    base, tag, inner = b.g(1), b.g(2), b.g(3)
    script = _script(b, tag, inner)
    out = b.cat(base, script)
    for name, latex in (("lim", "\\lim"), ("colim", "\\operatorname{colim}"), ("Hom", "\\operatorname{Hom}"),
                        ("Spec", "\\operatorname{Spec}"), ("Spf", "\\operatorname{Spf}"),
                        ("Spa", "\\operatorname{Spa}"), ("Gal", "\\operatorname{Gal}")):
        out = b.when(b.eq(base, name), b.cat(latex, script), out)
    out = b.when(b.eq(base, "O"), b.cat("\\mathcal{O}_{", inner, "}"), out)
    return b.when(b.math, out, b.cat("$", out, "$"))


def _not_footnote(b):
    """A superscript of digits only is left alone."""
    return b.no(b.both(b.eq(b.lower(b.g(2)), "sup"), b.has(b.g(3), r"^\p{Nd}+$")))


def _infinity(b):
    inside = b.g(1)
    tail = r"\^(\{[^}]+\}|[A-Za-z0-9])$"
    last = b.part(inside, tail, 1)
    bare = b.sub(last, r"^\{|\}$", "")
    merged = b.cat(b.head(inside, _len(b, last, 1)), "^{", bare, "^{\\infty}}$")
    return b.when(b.has(inside, tail), merged, b.cat(inside, "^{\\infty}$"))


def _len(b, x, more):
    """length(x) + more, in either backend."""
    return f"({b.length(x)} + {more})"


def _trailing_sup(b):
    inside, sup = b.g(1), b.g(2)
    tail = r"\^(\{[^}]*\}|[A-Za-z0-9≥≤−+])$"
    last = b.part(inside, tail, 1)
    clean = b.replace(b.replace(b.replace(b.sub(last, r"^\{|\}$", ""), "≥", "\\geq "), "≤", "\\leq "), "−", "-")
    merged = b.cat(b.head(inside, _len(b, last, 1)), "^{", clean, sup, "}$")
    plain = b.when(b.has(inside, tail), merged, b.cat(inside, "^{", sup, "}$"))
    return b.when(b.has(inside, r"\\(times|otimes|prod|coprod)\s*$"), b.cat(inside, "_{", sup, "}$"), plain)


_MARKS = "[∞∗*]"

HTML_MATH = [
    Detector("(?i)<sup>([−\\-])</sup><sup>(\\d+)</sup>", 2, _math(lambda b: ("^{-", b.g(2), "}")), needs="<"),
    Detector("(?i)([>≥<≤=])[ ]*<sup>(\\d+)</sup>", 2, _math(lambda b: (b.g(1), "^{", b.g(2), "}")), needs="<"),
    Detector("(?i)(\\|[^|]+\\|) <(sup|sub)>([^<]+)</(\\2)>", 4, _math(lambda b: (b.g(1), _script(b, b.g(2), b.g(3)))),
             sql="(?i)(\\|[^|]+\\|) <(sup|sub)>([^<]+)</(sup|sub)>", keep=_paired(), needs="<"),
    Detector("(?i)(\\([^)]{1,20}\\)) <(sup|sub)>([^<]+)</(\\2)>", 4, _math(lambda b: (b.g(1), _script(b, b.g(2), b.g(3)))),
             sql="(?i)(\\([^)]{1,20}\\)) <(sup|sub)>([^<]+)</(sup|sub)>",
             keep=_paired(lambda b: b.has(b.g(3), "^[A-Za-z0-9+\\-−∗*∞]+$")), needs="<"),
    Detector("(?i)(?<![A-Za-z])([A-Za-z]) <(sup|sub)>([^<]+)</(\\2)>", 4, _base_new, keep=_paired(_not_footnote), needs="<",
             sql="(?i)([A-Za-z]+) <(sup|sub)>([^<]+)</(sup|sub)>",
             sql_keep=lambda b: b.both(_paired(_not_footnote)(b), b.has(b.g(1), "^.$"))),
    Detector("(?i)([A-Za-z]+)<(sup|sub)>([^<]+)</(\\2)>", 4, _base_new,
             sql="(?i)([A-Za-z]+)<(sup|sub)>([^<]+)</(sup|sub)>", keep=_paired(_not_footnote), needs="<"),
    Detector("(?i)(\\([^)]{1,30}\\))<(sup|sub)>([∗*+-−]+)</(\\2)>", 4,
             _math(lambda b: (b.g(1), _script(b, b.g(2), b.replace(b.g(3), "∗", "*")))),
             sql="(?i)(\\([^)]{1,30}\\))<(sup|sub)>([∗*+-−]+)</(sup|sub)>", keep=_paired(), needs="<"),
    Detector("(?i)(\\$[^$]+)\\$<sup>(∞|\\\\infty)</sup>", 2, _infinity, needs="<"),
    Detector("(?i)(\\\\(?:times|otimes|prod|coprod))\\$\\s*<sup>([A-Za-z′'][^<]*)</sup>", 2,
             lambda b: b.cat(b.g(1), "_{", b.g(2), "}"), needs="<"),
    Detector("(?i)(⊗)\\s*<sup>([A-Za-z]+)</sup>", 2, _math(lambda b: (b.g(1), "_{", b.g(2), "}")), needs="<"),
    Detector("(?i)(?<![A-Za-z])([A-Za-z]) <sup>([∞∗*])</sup>", 2, _math(lambda b: (
        b.g(1), b.when(b.eq(b.g(2), "∞"), "^{\\infty}", "^{*}"))), needs="<",
             sql="(?i)([A-Za-z]+) <sup>([∞∗*])</sup>", sql_keep=lambda b: b.has(b.g(1), "^.$")),
    Detector("(?i)<sup>([A-Za-z]+)</sup>◦◦", 1, _math(lambda b: (b.g(1), "^{\\circ\\circ}")), needs="<"),
    Detector("(?i)<sup>([A-Za-z]+)</sup>◦(?!◦)", 1, _math(lambda b: (b.g(1), "^{\\circ}")), needs="<",
             sql="(?i)<sup>([A-Za-z]+)</sup>(◦+)", sql_groups=2, sql_keep=lambda b: b.eq(b.g(2), "◦")),
    Detector("(?i)<sup>([A-Za-z]+)</sup><sup>b</sup>", 1, _math(lambda b: ("\\widehat{", b.g(1), "}")), needs="<"),
    Detector("(?i)<sup>([A-Za-z]+)</sup>b(?![A-Za-z])", 1, _math(lambda b: ("\\widehat{", b.g(1), "}")), needs="<",
             sql="(?i)<sup>([A-Za-z]+)</sup>(b[A-Za-z]*)", sql_groups=2, sql_keep=lambda b: b.eq(b.lower(b.g(2)), "b")),
    Detector("(?i)<sup>([A-Za-z]+)</sup>[♭\\[]", 1, _math(lambda b: (b.g(1), "^{\\flat}")), needs="<"),
    Detector("(?i)<sup>([⊂⊃→←↔=≈∅∈∉])</sup>", 1, lambda b: b.g(1), needs="<"),
    Detector("(?i)<sup>([A-Za-z])</sup>(Zar|hens|perf|red|et|fppf|fpqc)", 2,
             _math(lambda b: (b.g(1), "_{\\mathrm{", b.g(2), "}}")), needs="<"),
    Detector("(?i)<sup>p</sup><sup>([∞∗])</sup>", 1, _math(lambda b: ("^{p^{\\infty}}",)), needs="<"),
    Detector("(?i)(\\$[^$]+)\\$<sup>([^<]+)</sup>", 2, _trailing_sup, needs="<"),
    Detector("(?i)([a-zA-Z])∈<sup>([A-Za-z])</sup>", 2, _math(lambda b: (b.g(1), " \\in ", b.g(2))), needs="<"),
]

NUMBER_SETS = "CZRQNAPFHG"


def _merged_expression(b):
    expr = b.strip(b.g(2))
    for letter in NUMBER_SETS:
        expr = b.sub(expr, rf"\*\*\s*{letter}\s*\*\*", rf"\\mathbb{{{letter}}}", sql_new=rf"\\mathbb{{{letter}}}")
    for symbol, latex in SYMBOLS.items():
        expr = b.replace(expr, symbol, latex)
    expr = b.sub(expr, r"(\\epsilon|\\varepsilon|[A-Za-z])\s+(\d+)", "$1^{$2}", sql_new=r"\1^{\2}")
    return b.cat("$", b.g(1), " = ", expr, "$")


_BARE = lambda b: b.no(b.math)
UNWRAPPED_MATH = [
    Detector("([A-Za-z])∗", 1, lambda b: b.cat("$", b.g(1), "^*$"), keep=_BARE),
    Detector(r"\|([A-Za-z])\|", 1, lambda b: b.cat("$|", b.g(1), "|$"), keep=_BARE),
    Detector(r"\|([A-Za-z])∗\|", 1, lambda b: b.cat("$|", b.g(1), "^*|$"), keep=_BARE),
]
STOPS_UNWRAPPED_MATH = Detector("([A-Za-z])◦", 1, lambda b: b.lit(""), keep=_BARE)


def _unwrapped_math(body):
    """A superscript ring outside of math stops the rule before it yields anything."""
    return F.when(F.size(detect(STOPS_UNWRAPPED_MATH)) > 0, none()).otherwise(
        F.concat(*[detect(d) for d in UNWRAPPED_MATH]))


# Fixed values.  Repeats are possessive: nothing follows them that could ask for fewer, and Java then loops
# over them, where it would recurse once a repeat.
_WORDS = r"(?iU)\b((?:\w+\s+){1,4}\w+)\s+(?:\1\s+){4,}+"
_TWO = r"(?iU)\b(\w+\s+\w+)\s+(?:\1\s+){4,}+"
_ONE = r"(?iU)\b(\w{2,})\s+(?:\1\s+){9,}+"


def _looped(body):
    def one(e, k):
        phrase = e["g"][0]
        key = F.concat_ws(" ", e["line"].cast("string"), F.lower(phrase))
        times = (F.length(e["txt"]) - F.length(F.replace(F.lower(e["txt"]), F.lower(phrase), F.lit("")))) / F.length(phrase)
        return F.struct(key.alias("key"), k.alias("k"), issue(
            e["line"], e["start"], None, None, F.concat_ws(" ", times.cast("int").cast("string"), phrase)).alias("x"))

    every = F.transform(F.concat(*[found(body, p, 1) for p in (_WORDS, _TWO, _ONE)]), one)
    # the first of each key: equal keys are neighbours once sorted
    first = fold(F.array_sort(every), F.lit(None).cast("string"), f"struct<k:int,x:{ISSUE}>", lambda key, e: (
        e["key"], F.when(~key.eqNullSafe(e["key"]), F.struct(e["k"].alias("k"), e["x"].alias("x")))))
    return F.transform(F.array_sort(first), lambda p: p["x"])


def _fragments(body):
    """Spans between dollar signs on a line; neighbours merge where no word and no punctuation is between."""
    def in_line(x):
        s = x["s"]
        t = strip(s)
        pattern = r"\$\$|\$[^$]+\$|\$"
        # each match with what stands before it since the last span: places in a long line are not looked up again
        rows = F.arrays_zip(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), F.split(s, pattern, -1))

        def span(state, e):
            txt, gap = e["0"], F.concat(state["gap"], e["1"])
            inner = F.substring(txt, F.lit(2), F.length(txt) - 2)
            is_span = (F.length(txt) > 2) & (strip(inner) != "") & ~txt.isin("$|$", "$||$")
            at = state["at"] + F.length(e["1"])
            new = F.struct((at + F.length(txt)).alias("at"), F.when(is_span, F.lit("")).otherwise(F.concat(gap, txt)).alias("gap"))
            return new, F.when(is_span, F.struct(at.alias("start"), gap.alias("gap"), txt.alias("txt"), inner.alias("inner")))

        spans = fold(F.filter(rows, lambda e: e["0"].isNotNull()), F.struct(F.lit(0).alias("at"), F.lit("").alias("gap")),
                     "struct<start:int,gap:string,txt:string,inner:string>", span)

        def step(now, e):
            apart = F.regexp_replace(e["gap"], r"\\[a-zA-Z]+", "").rlike("[a-zA-Z]{2,}") | e["gap"].rlike(r"[,;:.!?()\[\]]")
            joins = (now["n"] > 0) & ~apart
            more = F.struct((now["n"] + 1).alias("n"), now["first"].alias("first"))
            new = F.struct(F.lit(1).alias("n"), (now["first"] + now["n"]).alias("first"))
            return F.when(joins, more).otherwise(new), F.when(~joins & (now["n"] >= 2), now)

        def merged(spans):
            groups = fold(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("first")), "struct<n:int,first:int>", step,
                          lambda now: F.when(now["n"] >= 2, now))

            def joined(g, part):
                return F.array_join(F.transform(F.slice(spans, g["first"] + 1, g["n"]), lambda e, k: F.concat(
                    F.when(k == 0, F.lit("")).otherwise(e["gap"]), e[part])), "")

            return F.transform(groups, lambda g: issue(
                x["i"], F.get(spans, g["first"])["start"], joined(g, "txt"), F.concat(F.lit("$"), joined(g, "inner"), F.lit("$"))))

        out = let(spans, merged)
        busy = (F.length(s) - F.length(F.replace(s, F.lit("$"), F.lit(""))) >= 4) & ~t.startswith("$$") & ~t.endswith("$$")
        return F.when(busy, F.filter(out, lambda o: o["old"] != o["new"])).otherwise(none())

    return F.when(F.contains(body, F.lit("$")), F.flatten(F.transform(lines(body), in_line))).otherwise(none())


#: Fixed values.
LABELS = ("def", "thm", "lem", "prop", "cor", "ex", "rem", "eq", "sec", "chap", "fig", "tab", "defn", "lemma", "theorem",
          "proposition", "corollary", "example", "remark", "equation", "section", "chapter", "figure", "table")
LABEL = "(?i)^[ \t]*(?:" + "|".join(LABELS) + "):[A-Za-z0-9_-]+[ \t]*$"
MARKER = r"^[ \t]*(?:[-*+]|\d+\.)[ \t]*$"
NUMBER = r"^[ \t]*\d{1,4}[ \t]*$"

RULES = [
    Rule("excessive_blank_lines", FIX, "Flag more than 2 consecutive blank lines.", [
        Detector("\\n{4,}", 0, lambda b: b.lit("\n\n\n"))]),
    Rule("trailing_whitespace", FIX, "Flag trailing whitespace on lines.", expression=_spaced),
    Rule("leading_whitespace", FIX, "Flag leading whitespace on lines (outside of code blocks).", expression=_indented),
    Rule("header_whitespace", FIX, "Remove extra blank lines before headers.", [
        Detector(r"(?U)\n(\n{2,})(#{1,6}\s+[^\n]+)", 2, lambda b: b.cat("\n\n", b.g(2)), sql=r"\n(\n{2,})(#{1,6}\s+[^\n]+)", needs="#")]),
    Rule("sparse_table_row", WARN, "Flag table rows that are more than 50% empty cells.", expression=_sparse),
    Rule("orphaned_list_marker", WARN, "Flag list markers that have no content after them.", expression=_dropped_line("(?U)" + MARKER)),
    Rule("unwrapped_sentences", FIX, "Fix sentences that are randomly split across lines mid-sentence.", expression=_unwrapped),
    Rule("excessive_horizontal_rules", FIX, "Remove excessive consecutive horizontal rules (---).", [
        Detector(r"(?U)(?:---\s*\n\s*){3,}+", 0, lambda b: b.lit("---\n\n"), sql=r"(?:---\s*\n\s*){3,}", needs="---")]),
    Rule("page_number", FIX, "Detect and remove standalone page numbers.",
         expression=_dropped_line("(?U)" + NUMBER, lambda s: strip(s).cast("int").between(1, 999))),
    Rule("page_marker", FIX, "Remove HTML comment page markers from transcription.", [
        Detector(r"(?iU)<!-- ?Page \d+ ?-->|<!-- ?Content merged with page \d+ ?-->|<!-- ?End of page \d+ ?-->|<!-- ?Start of page \d+ ?-->",
                 0, lambda b: b.lit(""), needs="<!--",
                 sql=r"(?i)<!-- ?Page \d+ ?-->|<!-- ?Content merged with page \d+ ?-->|<!-- ?End of page \d+ ?-->|<!-- ?Start of page \d+ ?-->")]),
    Rule("orphaned_label", FIX, "Detect orphaned LaTeX labels that weren't properly processed.", expression=_dropped_line(LABEL)),
    Rule("garbled_text", WARN, "Detect likely garbled/corrupted text fragments.", expression=_garbled),
    Rule("hyphenation_artifact", FIX, "Fix word hyphenation split across lines.", [
        Detector(r"(?U)(\b[a-zA-Z]{2,})-\n([a-z]{2,}\b)", 2, lambda b: b.cat(b.g(1), b.g(2), " "), needs="-\n",
                 sql=r"(\b[a-zA-Z]{2,})-\n([a-z]{2,}\b)")]),
    Rule("repeated_line", WARN, "Detect repeated short lines (likely headers/footers).", expression=_repeated),
    Rule("merged_content_comment", FIX, 'Remove "Content merged with page X" comments.', [
        Detector(r"(?iU)<!--\s*Content merged with page \d+\s*-->\n?", 0, lambda b: b.lit(""), needs="<!--",
                 sql=r"(?i)<!--\s*Content merged with page \d+\s*-->\n?")]),
    Rule("html_artifacts", FIX, "Remove HTML artifacts from transcription.", [
        Detector(r'(?iU)<span\s+id="page-\d+(?:-\d+)?"\s*>\s*</span>', 0, lambda b: b.lit(""), needs="<",
                 sql=r'(?i)<span\s+id="page-\d+(?:-\d+)?"\s*>\s*</span>'),
        *[Detector(old, 0, lambda b, new=new: b.lit(new), needs=old) for old, new in (
            ("&amp;lt;", "<"), ("&amp;gt;", ">"), ("&amp;amp;", "&"), ("&amp;nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"))],
        Detector(r"(?i)<(?:sup>&</sup|sub>&</sub)>(lt|gt);", 1, lambda b: b.when(b.eq(b.g(1), "lt"), "<", ">"), needs="<"),
        Detector(r"(?iU)<span\s*>\s*</span>|<div\s*>\s*</div>|<p\s*>\s*</p>", 0, lambda b: b.lit(""), needs="<",
                 sql=r"(?i)<span\s*>\s*</span>|<div\s*>\s*</div>|<p\s*>\s*</p>"),
        Detector(r"(?i)</(?:span|div|p)>", 0, lambda b: b.lit(""), keep=lambda b: _any(b, _stray()(b)), needs="</"),
    ], by_line=True),
    Rule("html_math_notation", FIX, "Convert HTML sup/sub notation to proper LaTeX math.", HTML_MATH, by_line=True),
    Rule("html_subscript_in_math", FIX, "Fix HTML <sub> tags adjacent to LaTeX math blocks.", [
        Detector(r"(?iU)(\$[^$]+)\$\s*<sub>([^<]+)</sub>", 2, lambda b: b.cat(b.g(1), "_{", b.g(2), "}$"), needs="<",
                 sql=r"(?i)(\$[^$]+)\$\s*<sub>([^<]+)</sub>"),
        Detector(r"(?iU)(?<![A-Za-z])<sub>([^<]+)</sub>\s*\$([^$]+\$)", 2, lambda b: b.cat("$_{", b.g(1), "}", b.g(2)), needs="<",
                 sql=r"(?i)[A-Za-z]?<sub>([^<]+)</sub>\s*\$([^$]+\$)", sql_keep=lambda b: b.has(b.txt, "^<"))]),
    Rule("malformed_footnote", FIX, "Fix footnotes incorrectly converted to nested LaTeX superscripts.", [
        Detector(r"(?mdU)(?:^| )\^\{\^\{(\d+)\}\}\$\$", 1, lambda b: b.cat("<sup>", b.g(1), "</sup>"), needs="^{^{",
                 sql=r"(?m)(?:^| )\^\{\^\{(\d+)\}\}\$\$")]),
    Rule("footnote_spacing", FIX, "Ensure space after footnote markers.", [
        Detector(r"(?U)(<sup>\d+</sup>)([A-Za-z0-9])", 2, lambda b: b.cat(b.g(1), " ", b.g(2)), needs="<sup>",
                 sql=r"(<sup>\d+</sup>)([A-Za-z0-9])")]),
    Rule("unicode_math_symbols", FIX, "Detect and fix Unicode math symbols outside of math mode.",
         expression=lambda body: F.coalesce(symbols.expression(body, ISSUES), none())),
    Rule("unwrapped_math_expressions", FIX, "Detect common unwrapped math expression patterns.", expression=_unwrapped_math),
    Rule("repetition_hallucination", ERROR, "Detect OCR hallucination patterns where phrases repeat excessively.", expression=_looped),
    Rule("broken_math_delimiters", FIX, "Detect malformed math delimiters.", [
        Detector(r"\|\$([^$]+)\$\|", 1, lambda b: b.cat("$|", b.g(1), "|$"), needs="$",
                 keep=lambda b: b.no(b.both(b.has(b.g(1), r"^\|"), b.has(b.g(1), r"\|$")))),
        Detector(r"(?U)\$([^$]*[≥≤])\$\s*(\d+)", 2, lambda b: b.cat(
            "$", b.replace(b.replace(b.g(1), "≥", "\\geq "), "≤", "\\leq "), b.g(2), "$"), needs="$", sql=r"\$([^$]*[≥≤])\$\s*(\d+)")]),
    Rule("broken_norm_notation", FIX, "Detect and fix broken norm (double-bar) notation from OCR artifacts.", [
        Detector(r"\|\$\|([^$|]+)\|\$\|", 1, lambda b: b.cat("$\\|", b.g(1), "\\|$"), needs="$"),
        Detector(r"\$\|\$([^$|]+)\$\|\$", 1, lambda b: b.cat("$\\|", b.g(1), "\\|$"), needs="$"),
        Detector(r"\|\|([^|]+)\|\|", 1, lambda b: b.cat("\\|", b.g(1), "\\|"), needs="||",
                 keep=lambda b: b.both(b.math, b.no(b.has(b.txt, r"\\\|"))))]),
    Rule("fragmented_math_expression", FIX, "Detect and merge fragmented inline math expressions.", expression=_fragments),
    Rule("space_in_math_variable", FIX, "Detect spaces incorrectly inserted into math variable names.", [
        Detector(r"(?U)\b([A-Za-z]) ([◦∗∞^_])", 2, lambda b: b.cat(b.g(1), b.g(2)), keep=lambda b: b.no(b.math),
                 sql=r"\b([A-Za-z]) ([◦∗∞^_])")]),
    Rule("display_math_whitespace", FIX, "Remove unnecessary blank lines before/after display math blocks.", [
        Detector(r"\n(\n+)([ \t]*\$\$)", 2, lambda b: b.cat("\n", b.g(2)), needs="$$"),
        Detector(r"(\$\$[ \t]*)\n(\n+)", 2, lambda b: b.cat(b.g(1), "\n"), needs="$$")]),
    Rule("bold_number_sets", FIX, "Convert standalone bold letters to blackboard bold notation.", [
        Detector(rf"(?U)\*\*\s*([A-Z])\s*\*\*", 1, lambda b: b.cat("$\\mathbb{", b.g(1), "}$"), needs="**",
                 keep=lambda b: b.both(b.has(b.g(1), f"[{NUMBER_SETS}]"), b.no(b.math)), sql=r"\*\*\s*([A-Z])\s*\*\*")]),
    Rule("merge_math_expressions", FIX, "Merge fragmented mathematical expressions into unified math mode blocks.", [
        Detector(r"(?U)\b([A-Za-z][A-Za-z0-9_]*)\s*=\s*([A-Za-z0-9_\[\]()/+\-*◦∗∞×÷±⊗⊕α-ωΑ-Ωϵεℓ\s]+)", 2, _merged_expression, needs="=",
                 keep=lambda b: b.no(b.math), sql=r"\b([A-Za-z][A-Za-z0-9_]*)\s*=\s*([A-Za-z0-9_\[\]()/+\-*◦∗∞×÷±⊗⊕α-ωΑ-Ωϵεℓ\s]+)")]),
    Rule("operator_subscript_correction", FIX, "Fix operators that incorrectly use superscripts instead of subscripts.", [
        Detector(r"(?i)(\\(?:times|otimes|prod|coprod))\^(\{[^}]+\}|[A-Za-z][A-Za-z0-9]*)", 2,
                 lambda b: b.cat(b.g(1), "_", b.g(2)), needs="^")]),
    Rule("long_line", WARN, "Flag extremely long lines.", registered=False,
         expression=lambda body: F.transform(F.filter(lines(body), lambda x: F.length(x["s"]) > 500), lambda x: issue(
             x["i"], F.lit(None), None, None, F.concat_ws(" ", F.length(x["s"]).cast("string"), F.substring(x["s"], 1, 60))))),
]
BY_NAME = {r.name: r for r in RULES}
#: Informational: rules whose fixes are safe by default.
REGISTRY = [r.name for r in RULES if r.registered]


def register(rule: Rule) -> None:
    """Add a rule, or put it in the place of the one of its name; it then runs with the others."""
    if rule.name in BY_NAME:
        RULES[[r.name for r in RULES].index(rule.name)] = rule
    else:
        RULES.append(rule)
    BY_NAME[rule.name] = rule
    if rule.registered and rule.name not in REGISTRY:
        REGISTRY.append(rule.name)


def python_rule(name: str, severity: str, find: Callable[[str], list[tuple]], summary: str = "No description") -> Rule:
    """A rule from a function: text -> [(line, start, old, new, detail)].  It runs as an Arrow UDF.

    Where the function raises, what it has found in that text so far stays, and the error is logged.
    """
    def guarded(text):
        out = []
        try:
            for x in find(text) if text else ():
                out.append(tuple(x))
        except Exception:
            logging.getLogger(__name__).exception("rule %s failed", name)
        return out

    def expression(body):
        return F.coalesce(F.udf(guarded, ISSUES, useArrow=True)(body), none())

    return Rule(name, severity, summary, expression=expression)
