import pytest
from pyspark.sql import functions as F

from doctide.operators import papers


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("title,authors,expected", [
    ("Introduction to Shimura Varieties", ["Milne"], "milne-shimura-varieties"),
    ("Berkeley Lectures on p-adic Geometry", ["Scholze", "Weinstein"], "scholze-weinstein-berkeley-p-adic"),
    ("Étale Cohomology", ["Milne, J.S."], "milne-etale-cohomology"),
    ("The", [], "unknown-untitled"), ("SiegelModular Forms", ["A B", "C", "D"], "b-et-al-siegel-modular-forms"),
])
def test_slug(spark, title, authors, expected):
    assert value(spark, papers.base_slug(F.lit(title), F.array(*map(F.lit, authors)).cast("array<string>"))) == expected


def test_taken_slugs(spark):
    rows = [(1, "Shimura Varieties", ["Milne"], 2004), (2, "Shimura Varieties", ["Milne"], None), (3, "Other", ["Milne"], None)]
    df = spark.createDataFrame(rows, "paper_id long, title string, authors array<string>, year int")
    have = spark.createDataFrame([("milne-shimura-varieties",), ("milne-shimura-varieties-2",)], "slug string")
    got = {r.paper_id: r.slug for r in papers.generate_slugs(df, have).collect()}
    assert got == {1: "milne-shimura-varieties-2004", 2: "milne-shimura-varieties-3", 3: "milne-other"}


def test_aliases(spark):
    registry = spark.createDataFrame([("a", 0, ["X"]), ("b", 1, ["x", "A"])], "slug string, ord int, aliases array<string>")
    names = spark.createDataFrame([("x",), ("A",), ("B",), ("q",)], "name string")
    assert {r.name: r.slug for r in papers.find_aliases(names, registry).collect()} == {"x": "a", "A": "a", "B": "b", "q": None}
    new = spark.createDataFrame([("b", 1, ["z"])], registry.schema)
    assert {r.slug: r.aliases for r in papers.register(registry, new).collect()} == {"a": ["X"], "b": ["z"]}


@pytest.mark.parametrize("name,expected", [
    ("Rising Sea - Vakil (pub)", "rising-sea-vakil-pub"), ("Test_Paper", "test-paper"),
    ("multiple---hyphens", "multiple-hyphens"), ("  spaces  ", "spaces")])
def test_job_names(spark, name, expected):
    assert value(spark, papers.job_name_cleanup(F.lit(name))) == expected


def test_frontmatter(spark):
    text = "---\ntitle: T\nkeywords:\n- a\nodd: 1\n---\nbody"
    df = spark.createDataFrame([(1, text), (2, "plain"), (3, None), (4, "---\n- a\n---\nx")], "doc_id long, text string")
    got = {r.doc_id: (r.fields, r.body) for r in papers.parse_frontmatter(df).collect()}
    assert got[1][0] == '{"title": "T", "keywords": ["a"], "odd": 1}' and got[1][1] == "body"
    assert got[2] == (None, "plain") and got[3] == (None, "") and got[4] == (None, "---\n- a\n---\nx")
    new = {r.doc_id: r.text for r in papers.update_frontmatter(df, {"year": 2000, "odd": 2}).collect()}
    assert "title: T\n" in new[1] and "year: 2000\n" in new[1] and "odd: 2\n" in new[1] and new[1].endswith("---\n\nbody")
    assert "title: Unknown" in new[2] and papers.split_frontmatter(new[1])[0]["keywords"] == ["a"]
    assert papers._flat_yaml("title: T\nkeywords:\n- a\nodd: 1") == {"title": "T", "keywords": ["a"], "odd": 1}
    assert list(papers.initial_metadata(x=1, title="T")) == ["title", "x"]


def test_keywords(spark):
    kw, new = F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "cdd"))
    assert value(spark, papers.add_keywords(kw, new)) == ["a", "b", "c", "d", "d"]
    assert value(spark, papers.remove_keywords(kw, new)) == ["a", "b"]
