"""Linting a corpus: issues, reports and repairs, each one pass without a shuffle."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctide.functions.patterns import newlines, rstrip
from doctide.operators.rules import BY_NAME, FIX, REGISTRY, evaluate

#: Rules whose fixes are applied where none are named.
DEFAULT_AUTO_FIX = (
    "excessive_blank_lines", "trailing_whitespace", "leading_whitespace", "header_whitespace", "display_math_whitespace",
    "page_number", "page_marker", "orphaned_label", "hyphenation_artifact", "html_artifacts", "html_math_notation",
    "html_subscript_in_math", "footnote_spacing", "merged_content_comment", "unwrapped_math_expressions", "broken_math_delimiters",
    "broken_norm_notation", "fragmented_math_expression", "space_in_math_variable", "unicode_math_symbols", "bold_number_sets",
    "merge_math_expressions", "operator_subscript_correction", "unwrapped_sentences", "excessive_horizontal_rules",
)

log = logging.getLogger(__name__)
FRONTMATTER = r"(?ds)^---\s*\n.*?\n---\s*\n"
FOUND = ("struct<line:int,rule_ord:int,ord:int,rule:string,severity:string,start:int,"
         "old:string,new:string,detail:string>")


def frontmatter(text: Column) -> Column:
    return F.regexp_extract(text, FRONTMATTER, 0)


def selected(rules: list[str] | None) -> list[str]:
    """Rules to run: all if none are named; unknown names are passed over."""
    out = []
    for name in rules or REGISTRY:
        if name in BY_NAME:
            out.append(name)
        else:
            log.warning("unknown rule: %s", name)
    return out


def available_rules() -> dict[str, str]:
    return {name: BY_NAME[name].summary for name in REGISTRY}


def with_issues(df: DataFrame, rules: list[str] | None = None, text: str = "text") -> DataFrame:
    """df with _head (frontmatter), _body and _issues, in order of line, rule and yield."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_head", frontmatter(whole))
    out = out.withColumns({"_body": F.substring(whole, F.length("_head") + 1, F.lit((1 << 31) - 1)), "_skip": newlines(F.col("_head"))})
    names = selected(rules)
    parts = [_placed(k, BY_NAME[name]) for k, name in enumerate(names)]
    every = F.concat(*parts) if parts else F.array().cast(f"array<{FOUND}>")
    return out.withColumn("_issues", F.array_sort(every)).drop("_skip")


def _placed(k: int, rule) -> Column:
    """The rule's issues with its place among the rules, and lines counted from the top of the file."""
    return F.transform(evaluate(rule), lambda x, i: F.struct(
        (x["line"] + F.col("_skip")).cast("int").alias("line"), F.lit(k).alias("rule_ord"), i.alias("ord"),
        F.lit(rule.name).alias("rule"), F.lit(rule.severity).alias("severity"), x["start"].alias("start"),
        x["old"].alias("old"), x["new"].alias("new"), x["detail"].alias("detail")).cast(FOUND))


def issues(df: DataFrame, rules: list[str] | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    # the outer form: from the inner one Spark infers a filter below, which would run every rule once more
    return with_issues(df, rules, text).select(id_col, F.explode_outer("_issues").alias("_x")).filter(F.col("_x").isNotNull()).select(
        id_col, "_x.rule", "_x.severity", "_x.line", "_x.start", F.col("_x.old").alias("old_text"),
        F.col("_x.new").alias("new_text"), "_x.detail")


def _fixable(x: Column) -> Column:
    return (x["severity"] == FIX) & x["new"].isNotNull()


def report(df: DataFrame, rules: list[str] | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Counters by severity, and the rules with an applicable fix."""
    count = lambda s: F.size(F.filter("_issues", lambda x: x["severity"] == s)).cast("long")
    return with_issues(df, rules, text).select(
        id_col, F.size("_issues").cast("long").alias("total_issues"), count(FIX).alias("auto_fixable"),
        count("warning").alias("warnings"), count("error").alias("errors"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("_issues", _fixable), lambda x: x["rule"]))), ",").alias("fixed_rules"))


def apply_fixes(df: DataFrame, rules: list[str] | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, fixed_text, fixed_rules, changed.

    Trailing blanks go first, by line.  Then each other fix replaces the first place of its
    old text in the whole document, the longest old texts first.
    """
    out = with_issues(df, rules, text)
    fixes = F.filter("_issues", _fixable)
    by_line = F.exists(fixes, lambda x: x["rule"] == "trailing_whitespace")
    trimmed = F.concat("_head", F.array_join(F.transform(F.split("_body", "\n", -1), rstrip), "\n"))
    start = F.when(by_line, trimmed).otherwise(F.concat("_head", "_body"))
    longest = F.transform(
        F.array_sort(F.transform(
            F.filter(fixes, lambda x: x["rule"] != "trailing_whitespace"),
            lambda x, k: F.struct((-F.length(x["old"])).alias("n"), k.alias("k"), x["old"].alias("old"), x["new"].alias("new")))),
        lambda p: F.struct(p["old"].alias("old"), p["new"].alias("new")))

    def step(t, f):
        at = F.instr(t, f["old"])
        done = F.concat(F.substring(t, F.lit(1), at - 1), f["new"], F.substring(t, at + F.length(f["old"]), F.length(t)))
        return F.when(at > 0, done).otherwise(t)

    return out.select(
        id_col, F.aggregate(longest, start, step).alias("fixed_text"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(fixes, lambda x: x["rule"]))), ",").alias("fixed_rules"),
        F.concat("_head", "_body").alias("_old"),
    ).withColumn("changed", F.col("fixed_text") != F.col("_old")).drop("_old")


def lint_files(spark, path: str, out: str | None = None, rules: list[str] | None = None) -> DataFrame:
    """Report on each file below path.  With out, repaired texts of changed files are written there as a table (path, text)."""
    from doctide.sources.documents import read_documents

    docs = read_documents(spark, path)
    if out:
        fixed = apply_fixes(docs, rules, id_col="path").filter("changed")
        fixed.select("path", F.col("fixed_text").alias("text")).write.mode("overwrite").parquet(out)
    return report(docs, rules, id_col="path")
