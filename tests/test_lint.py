"""Rules against results traced by hand."""

import pytest
from pyspark.sql import functions as F

from doctide.operators import lint
from doctide.operators.rules import BY_NAME, REGISTRY


def found(spark, text, rules):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = lint.issues(df, rules).collect()
    return [(r.line, r.old_text, r.new_text, r.detail) for r in rows]


CASES = [
    ("excessive_blank_lines", "a\n\n\n\n\nb", [(1, "\n" * 5, "\n\n\n", None)]),
    ("trailing_whitespace", "a  \nb", [(1, "a  ", "a", None)]),
    ("header_whitespace", "a\n\n\n# H", [(1, "\n\n\n# H", "\n\n# H", None)]),
    ("sparse_table_row", "| a | | | |", [(1, None, None, "3/4")]),
    ("page_number", "x\n42\ny", [(2, "42\n", "", None)]),
    ("hyphenation_artifact", "theo-\nrem is", [(1, "theo-\nrem", "theorem ", None)]),
    ("broken_math_delimiters", "|$K^*$|", [(1, "|$K^*$|", "$|K^*|$", None)]),
    ("broken_norm_notation", "|$|x|$|", [(1, "|$|x|$|", "$\\|x\\|$", None)]),
    ("broken_math_delimiters", "|$|x|$|", []),
    ("fragmented_math_expression", "$x$ + $y$", [(1, "$x$ + $y$", "$x + y$", None)]),
    ("fragmented_math_expression", "$x$, $y$", []),
    ("bold_number_sets", "**Z**", [(1, "**Z**", "$\\mathbb{Z}$", None)]),
    ("bold_number_sets", "**B** $**Q**$", []),
    ("operator_subscript_correction", "\\times^{S}", [(1, "\\times^{S}", "\\times_{S}", None)]),
    ("html_math_notation", "O<sup>X</sup>", [(1, "O<sup>X</sup>", "$\\mathcal{O}_{X}$", None)]),
    ("html_math_notation", "x<sup>2</sup>", []),
    ("unwrapped_math_expressions", "K◦ and K∗", []),
    ("unwrapped_math_expressions", "K∗", [(1, "K∗", "$K^*$", None)]),
    ("unicode_math_symbols", "x ∈ R", [(1, "x ∈ R", "$x \\in R$", None)]),
    ("unicode_math_symbols", "f: X → Y", [(1, "f: X → Y", "$f \\colon X \\to Y$", None)]),
    ("unicode_math_symbols", "the ∞", [(1, "∞", "$\\infty$", None)]),
    ("unicode_math_symbols", "$x ∈ R$", []),
    ("repetition_hallucination", "over G " * 6, [(1, None, None, "6 over G")]),
    ("leading_whitespace", "```\n  code\n```\n  text", [(4, "  text", "text", None)]),
    ("orphaned_list_marker", "- a\n- \n3.", [(2, "- \n", "", None), (3, "3.\n", "", None)]),
    ("unwrapped_sentences", "one two\n\nthree.\nfour.", [(1, "one two\n\nthree.", "one two three.", None)]),
    ("excessive_horizontal_rules", "a\n---\n\n---\n---\nx", [(2, "---\n\n---\n---\n", "---\n\n", None)]),
    ("page_marker", "<!-- Page 3 -->", [(1, "<!-- Page 3 -->", "", None)]),
    ("merged_content_comment", "<!--Content merged with page 3-->\nx", [(1, "<!--Content merged with page 3-->\n", "", None)]),
    ("orphaned_label", "def:Tilt\nx", [(1, "def:Tilt\n", "", None)]),
    ("repeated_line", "Header line\na\nHeader  line\nHeader line", [(1, None, None, "3 1,3,4 Header line")]),
    ("html_artifacts", "a &lt; b</div>", [(1, "&lt;", "<", None), (1, "</div>", "", None)]),
    ("html_artifacts", "<div>a</div>", []),
    ("html_subscript_in_math", "$K$<sub>v</sub>", [(1, "$K$<sub>v</sub>", "$K_{v}$", None)]),
    ("malformed_footnote", "a ^{^{28}}$$", [(1, " ^{^{28}}$$", "<sup>28</sup>", None)]),
    ("footnote_spacing", "<sup>9</sup>Some", [(1, "<sup>9</sup>S", "<sup>9</sup> S", None)]),
    ("space_in_math_variable", "K ◦", [(1, "K ◦", "K◦", None)]),
    ("display_math_whitespace", "a\n\n$$x$$\n\nb", [(1, "\n\n$$", "\n$$", None), (3, "$$\n\n", "$$\n", None)]),
    ("merge_math_expressions", "S = **C**[x]", [(1, "S = **C**[x]", "$S = \\mathbb{C}[x]$", None)]),
]


@pytest.mark.parametrize("rule,text,expected", CASES, ids=[f"{k}-{c[0]}" for k, c in enumerate(CASES)])
def test_rule(spark, rule, text, expected):
    assert found(spark, text, [rule]) == expected


def test_empty_and_null_texts_have_no_issues(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert lint.issues(df).count() == 0
    assert [r.total_issues for r in lint.report(df).collect()] == [0, 0]


def test_selection_of_rules():
    assert lint.selected([]) == REGISTRY and lint.selected(["no such rule", "page_number"]) == ["page_number"]
    assert len(REGISTRY) == 31 and not BY_NAME["long_line"].registered
    assert list(lint.available_rules()) == REGISTRY


def test_lines_count_from_the_top_of_the_file(spark):
    assert found(spark, "---\ntitle: x\n---\na  \n", ["trailing_whitespace"]) == [(4, "a  ", "a", None)]


def fixed(spark, text, rules=None):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return lint.apply_fixes(df, rules).first()


@pytest.mark.parametrize("text,rules,expected", [
    ("x\n42\ny", ["page_number"], "x\ny"),
    ("x\n42", ["page_number"], "x\n42"),
    ("theo-\nrem is", ["hyphenation_artifact"], "theorem  is"),
    ("a  \nb\t", ["trailing_whitespace"], "a\nb"),
    ("- \nx", ["orphaned_list_marker"], "- \nx"),
    ("$a$ $1.5$ **Z**", ["bold_number_sets"], "$a$ $1.5$ $\\mathbb{Z}$"),
])
def test_fixes(spark, text, rules, expected):
    assert fixed(spark, text, rules).fixed_text == expected


def test_a_fix_takes_the_first_place_in_the_file_even_in_frontmatter(spark):
    row = fixed(spark, "---\ntitle: **Z**\n---\n**Z**\n", ["bold_number_sets"])
    assert row.fixed_text == "---\ntitle: $\\mathbb{Z}$\n---\n**Z**\n" and row.fixed_rules == "bold_number_sets" and row.changed


def test_counts_add_up(spark):
    text = "a  \n| a | | | |\n" + "over G " * 6 + "\n42\n"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = lint.report(df).first()
    assert r.total_issues == r.auto_fixable + r.warnings + r.errors and r.errors == 1 and r.warnings >= 1


def test_linting_needs_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    rules = [r for r in REGISTRY if r != "unicode_math_symbols"]
    plan = lint.issues(df, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert df.select(F.lit(1)).count() == 1


def test_own_rules_and_files(spark, tmp_path):
    from doctide.operators import rules

    rules.register(rules.python_rule("no_foo", rules.FIX, lambda t: [(1, t.index("foo"), "foo", "bar", None)] if "foo" in t else [], "No foo."))
    try:
        assert found(spark, "a foo", ["no_foo"]) == [(1, "foo", "bar", None)] and found(spark, "a", ["no_foo"]) == []
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "a.md").write_text("a foo  \n")
        (tmp_path / "in" / "b.md").write_text("fine\n")
        r = lint.lint_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["no_foo", "trailing_whitespace"])
        assert sum(x.total_issues for x in r.collect()) == 2
        assert [x.text for x in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a bar\n"]
    finally:
        rules.REGISTRY.remove("no_foo")
        rules.RULES.remove(rules.BY_NAME.pop("no_foo"))


@pytest.mark.parametrize("rule, unit, most", [
    ("excessive_horizontal_rules", "---\n", 1), ("repetition_hallucination", "no ", 3), ("repetition_hallucination", "over the hill ", 3),
    ("page_marker", "<!-- Page 3 -->\n", None), ("unwrapped_math_expressions", "K∗ ", None), ("fragmented_math_expression", "$x$ + ", 1),
    ("repeated_line", "A running head\n", 1), ("leading_whitespace", "  a\n```\nx\n```\n", None)])
def test_long_documents_of_one_artifact(spark, rule, unit, most):
    """Neither the depth of a match nor the number of matches stops a document."""
    n = 20_000
    found = lint.issues(spark.createDataFrame([(1, unit * n)], "doc_id long, text string"), [rule])
    count, last = found.count(), found.agg(F.max("line")).first()[0]
    assert 1 <= count <= most if most else count in (n, n // 2) and last in (n, 1, 4 * n - 3 - 4 * (n % 2))


def test_a_rule_that_raises_keeps_what_it_found(spark):
    from doctide.operators import rules

    def find(text):
        yield 1, 0, "a", None, None
        raise ValueError(text)

    rules.register(rules.python_rule("raises", rules.WARN, find))
    try:
        assert found(spark, "a\n\n\n\n\nb", ["raises", "excessive_blank_lines"])[0][:2] == (1, "a")
        assert len(found(spark, "a\n\n\n\n\nb", ["raises", "excessive_blank_lines"])) == 2
    finally:
        del rules.BY_NAME["raises"]
        rules.RULES[:] = [r for r in rules.RULES if r.name != "raises"]
        rules.REGISTRY.remove("raises")


def test_default_fixes_are_rules():
    assert set(lint.DEFAULT_AUTO_FIX) <= set(lint.REGISTRY)
