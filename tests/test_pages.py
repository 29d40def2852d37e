from pyspark.sql import functions as F

from doctide.operators import pages


def verdict(spark, text):
    df = spark.createDataFrame([(1, 1, text)], "doc_id long, page_number int, content string")
    return pages.verify(df).first()


def test_verification(spark):
    r = verdict(spark, "g g g g g g")
    assert not r.is_valid and r.error_type == "repetition_hallucination" and "6 times" in r.error_message
    r = verdict(spark, "f in " * 11)
    assert r.error_type == "repetition_hallucination" and "'f in' repeated 11" in r.error_message
    assert verdict(spark, "a <!-- Content merged with page 2 -->").error_type == "page_merge_failure"
    assert verdict(spark, "é" * 101).error_type == "garbled_text"
    assert verdict(spark, "fine text").is_valid and verdict(spark, None).is_valid and verdict(spark, "").is_valid


def test_recovery(spark):
    rows = [(1, 1, "g g g g g g", "12\nclean"), (2, 1, "g g g g g g", None), (3, 1, "<!-- Content merged with page 2 -->", "x")]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, content string, fallback_text string")
    out = {r.doc_id: r for r in pages.recover(df).collect()}
    assert out[1].used_fallback and out[1].content.endswith("-->\n\nclean")
    assert not out[2].used_fallback and out[2].content.startswith("<!-- TRANSCRIPTION ERROR: repetition_hallucination")
    assert out[3].content == rows[2][2]


def split(spark, text, total=9):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [r.content for r in pages.split_pages(df, total).orderBy("page_number").collect()]


def test_split(spark):
    assert split(spark, "a\n---\nb") == ["a", "b"]
    assert split(spark, "---\na") == ["---\na"]
    assert split(spark, "---\n---\na") == ["---", "a"]
    assert split(spark, "a\n---\n---\n---\nb") == ["a", "---", "b"]
    assert split(spark, "a\n---\nb\n---\nc", 2) == ["a", "b"]
    assert split(spark, "") == [""] and split(spark, None) == [""]


def test_assembly_and_round_trip(spark):
    df = spark.createDataFrame([(1, "a\nb\n---\nc\n---\nd")], "doc_id long, text string")
    parts = pages.split_pages(df, 3)
    assert pages.assemble(parts).first().content == "<!-- Page 1 -->\n\na\nb\n\n---\n\n<!-- Page 2 -->\n\nc\n\n---\n\n<!-- Page 3 -->\n\nd"
    again = pages.split_pages(pages.assemble(parts, markers=False).withColumnRenamed("content", "text"), 3)
    assert [r.content for r in again.orderBy("page_number").collect()] == ["a\nb", "c", "d"]
    twice = pages.assemble(parts.union(parts.filter("page_number = 2")), markers=False).first().content
    assert twice.split("\n\n---\n\n") == ["a\nb", "c", "c", "d"]


def test_remap(spark):
    got = spark.createDataFrame([(1, 1, "x")], "doc_id long, page_number int, content string")
    wanted = spark.createDataFrame([(1, 5), (1, 7)], "doc_id long, page_number int")
    assert [(r.page_number, r.content) for r in pages.remap(got, wanted).orderBy("page_number").collect()] == [
        (5, "x"), (7, "<!-- Content merged with page 5 -->")]


def test_small_expressions(spark):
    one = spark.range(1)
    text = one.select(pages.diagram_placeholders(F.lit("a ![x](y.png) b"), F.lit(3)).alias("t"), pages.page_file(F.lit(7)).alias("f"),
                      pages.dpi(F.lit("fast")).alias("d"), pages.dpi(F.lit("other")).alias("o"),
                      pages.page_duration_ms(F.lit(3.0), F.lit(2)).alias("ms")).first()
    assert "[DIAGRAM - Page 3]" in text.t and "reference: ![x](y.png) -->" in text.t
    assert (text.f, text.d, text.o, text.ms) == ("page_007.md", 100, 150, 1500)
    dims = spark.createDataFrame([(1, 612.0, 792.0, 200), (2, 612.0, 792.0, 150)], "page int, width double, height double, dpi int")
    assert [r.page for r in pages.oversized(dims).collect()] == [1]
