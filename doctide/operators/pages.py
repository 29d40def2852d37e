"""Pages: verification, recovery, splitting, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctide.functions.patterns import strip

#: Fixed values.  A letter, blanks, the same three times or more, then one more letter if it ends a word, at a
#: word's edge: all repeats if that leads to one, else all but the last.  Repeats are possessive, over which Java
#: loops where it would recurse.
LETTER_LOOP = r"(?U)\b([a-zA-Z])\s+(?:(?:\1\s+){3,}+(?:\1\b|\b)|(?:\1\s+(?=\1\s)){3,}+\1)"
PHRASE_LOOP = r"(?iU)\b((?:\w+\s+){1,5})\1{9,}+"
MERGED = r"(?iU)<!--\s*Content merged with page \d+\s*-->"
RETRIED = ("repetition_hallucination", "garbled_text")
CHECKS = ("letters", "phrases", "merge", "garbled")


def verification(content: Column, checks: tuple[str, ...] = CHECKS) -> Column:
    """struct<is_valid, error_type, error_message, matched_pattern>: the first check that fails decides."""
    def result(kind, message, match):
        return F.struct(F.lit(False).alias("is_valid"), F.lit(kind).alias("error_type"), message.alias("error_message"),
                        match.cast("string").alias("matched_pattern"))

    text = F.coalesce(content, F.lit(""))
    letters, phrases, merged = (F.regexp_extract(text, p, 0) for p in (LETTER_LOOP, PHRASE_LOOP, MERGED))
    letter, unit = F.regexp_extract(text, LETTER_LOOP, 1), F.regexp_extract(text, PHRASE_LOOP, 1)
    times = lambda x, n: F.concat(F.lit("Detected '"), x, F.lit("' repeated "), n.cast("string"), F.lit(" times"))
    odd = F.length(F.regexp_replace(text, r"[\x20-\x7E\n\t]", ""))
    rules = {
        "letters": (letters != "", result("repetition_hallucination", times(
            letter, F.length(letters) - F.length(F.replace(letters, letter, F.lit("")))), F.substring(letters, 1, 200))),
        "phrases": (phrases != "", result("repetition_hallucination", times(
            strip(unit), F.floor(F.length(phrases) / F.length(unit))), F.substring(phrases, 1, 200))),
        "merge": (merged != "", result("page_merge_failure", F.lit("Marker failed to split pages correctly"), merged)),
        "garbled": ((F.length(text) > 100) & (2 * odd > F.length(text)), result("garbled_text", F.concat(
            F.lit("Non-ASCII ratio: "), F.format_number(100 * odd / F.length(text), 1), F.lit("%")), F.lit(None))),
    }
    fine = F.struct(F.lit(True).alias("is_valid"), F.lit(None).cast("string").alias("error_type"),
                    F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("string").alias("matched_pattern"))
    out = None
    for name in checks:
        out = F.when(*rules[name]) if out is None else out.when(*rules[name])
    return out.otherwise(fine) if out is not None else fine


def verify(pages: DataFrame, content: str = "content", checks: tuple[str, ...] = CHECKS) -> DataFrame:
    return pages.withColumn("_v", verification(F.col(content), checks)).select("*", "_v.*").drop("_v")


def retry(error_type: Column) -> Column:
    return F.coalesce(error_type.isin(*RETRIED), F.lit(False))


def clean_fallback(text: Column) -> Column:
    """Extracted text without the page number on top and the running header."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?U)^\d+\s*\n", ""),
                                  r"(?dU)Pre-publication version.*?Algebraic Geometry\s*\n", ""))


def recover(pages: DataFrame, content: str = "content", fallback: str = "fallback_text") -> DataFrame:
    """Verified pages with content replaced by the cleaned fallback, or marked where there is none."""
    out = verify(pages, content)
    again = retry(F.col("error_type"))
    return out.withColumn("used_fallback", again & F.col(fallback).isNotNull()).withColumn(
        content,
        F.when(again & F.col(fallback).isNotNull(), F.concat(
            F.lit("<!-- Transcribed via PyMuPDF fallback - Marker had "), "error_type", F.lit(" -->\n\n"), clean_fallback(F.col(fallback))))
        .when(again, F.concat(F.lit("<!-- TRANSCRIPTION ERROR: "), "error_type", F.lit(" - fallback failed: no text -->\n\n"), content))
        .otherwise(F.col(content)))


def page_array(text: Column, total: Column) -> Column:
    """Pages of a text: a line of three dashes ends a page that has a line."""
    strings = "array<string>"
    start = F.struct(F.array().cast(strings).alias("now"), F.array().cast(strings).alias("done"))

    def step(acc, line):
        ends = (strip(line) == "---") & (F.size(acc["now"]) > 0)
        return F.when(ends, F.struct(
            F.array().cast(strings).alias("now"), F.concat(acc["done"], F.array(strip(F.array_join(acc["now"], "\n")))).alias("done"))
        ).otherwise(F.struct(F.concat(acc["now"], F.array(line)).alias("now"), acc["done"].alias("done")))

    def finish(acc):
        last = (F.size(acc["now"]) > 0) & (F.size(acc["done"]) < total)
        return F.when(last, F.concat(acc["done"], F.array(strip(F.array_join(acc["now"], "\n"))))).otherwise(acc["done"])

    pages = F.aggregate(F.split(text, "\n", -1), start, step, finish)
    return F.when(F.size(pages) == 0, F.array(strip(text))).otherwise(pages)


def split_pages(df: DataFrame, total, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    total = F.lit(total) if isinstance(total, int) else total
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = F.array(strip(whole))
    pages = F.when(F.contains(whole, F.lit("---")), page_array(whole, total)).otherwise(plain)
    return df.select(id_col, F.posexplode(pages).alias("_k", "content")).select(
        id_col, (F.col("_k") + 1).cast("int").alias("page_number"), "content")


def remap(pages: DataFrame, requested: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Relative pages onto requested page numbers (id, page_number); pages that are missing say where they went."""
    from pyspark.sql import Window

    by = Window.partitionBy(id_col)
    places = requested.withColumn("_rel", F.row_number().over(by.orderBy("page_number"))).withColumn("_first", F.min("page_number").over(by))
    got = pages.select(id_col, F.col("page_number").alias("_rel"), "content")
    merged = F.concat(F.lit("<!-- Content merged with page "), F.col("_first").cast("string"), F.lit(" -->"))
    return places.join(got, [id_col, "_rel"], "left").select(id_col, "page_number", F.coalesce("content", merged).alias("content"))


def diagram_placeholders(content: Column, page: Column) -> Column:
    new = F.concat(F.lit("\n\n[DIAGRAM - Page "), page.cast("string"), F.lit(
        "]\n<!-- TODO: Add TikZ source code for diagram -->\n<!-- Original image reference: $0 -->\n\n"))
    return F.regexp_replace(content, F.lit(r"(?d)!\[.*?\]\([^)]+\)"), new)


def assemble(pages: DataFrame, id_col: str = "doc_id", markers: bool = True, output_format: str = "markdown") -> DataFrame:
    """One text a document: pages in order, repeated ones as often as they come."""
    sign = ("<!-- Page ", " -->") if output_format == "markdown" else ("% Page ", "")

    def one(p):
        head = F.concat(F.lit(sign[0]), p["page_number"].cast("string"), F.lit(sign[1] + "\n\n"))
        return F.concat(head, p["content"]) if markers else p["content"]

    listed = F.array_sort(F.collect_list(F.struct("page_number", "content")))
    return pages.groupBy(id_col).agg(F.array_join(F.transform(listed, one), "\n\n---\n\n").alias("content"))


def page_file(page: Column) -> Column:
    return F.format_string("page_%03d.md", page)


def oversized(dimensions: DataFrame, limit: int = 2000) -> DataFrame:
    """Pages (width, height in points at dpi) with a side above the limit."""
    side = lambda c: F.floor(F.col(c) * F.col("dpi") / 72)
    return dimensions.filter(F.greatest(side("width"), side("height")) > limit)


def page_duration_ms(chunk_seconds: Column, pages: Column) -> Column:
    return F.floor(chunk_seconds / pages * 1000).cast("long")


def chunk_size(explicit: Column, total: Column, auto: int = 1, threshold: int = 0) -> Column:
    """The given size, else the automatic one for documents above the threshold, else 0 (all at once)."""
    return F.coalesce(explicit, F.when((total > threshold), auto).otherwise(0))


def dpi(quality: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("fast", 100, "balanced", 150, "high-quality", 200)]), quality), F.lit(150))
