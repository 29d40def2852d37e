"""Documents, pages and files as tables, and back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = ("pdf_source string, total_pages int, completed_pages array<int>, failed_pages array<int>, output_format string, quality string, "
         "started_at string, last_updated string, version int")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its files give less than half of that.

    A large table has more file splits than cores and passes as it is; a table in one
    row group, which Spark cannot split, would keep all but one core idle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, output_dir, file_name, modified, size; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("output_dir"),
                        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def final_files(files: DataFrame) -> DataFrame:
    """The first finished file of each directory."""
    done = files.filter(F.col("file_name").endswith(".md") & ~F.col("file_name").endswith(".original.md"))
    return done.groupBy("output_dir").agg(F.min("file_name").alias("file_name"), F.min_by("modified", "file_name").alias("modified"))


def paper_count(files: DataFrame) -> DataFrame:
    return files.filter(F.col("file_name").endswith(".md")).agg(F.count_distinct("output_dir").alias("papers"))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """State files; those that are no JSON, or lack what they must hold, are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", STATE).alias("s"))
    return rows.select("path", "s.*").filter(F.col("pdf_source").isNotNull() & F.col("total_pages").isNotNull())


def write_state(states: DataFrame, path: str) -> None:
    """A state file for each job (job_id and the fields of STATE) below path/job_id=..., in the place of those that are there."""
    fields = [c for c in states.columns if c != "job_id"]
    states.select("job_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("job_id").text(path)


def page_source(requests: DataFrame, extract: Callable[[Iterator], Iterator], schema: str = "doc_id long, page_number int, content string") -> DataFrame:
    """Pages from an outside extractor: extract takes and gives pandas frames, a batch at a time."""
    return requests.mapInPandas(extract, schema)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """slug, ord, title, year, aliases of a YAML registry; a missing mapping is an empty registry."""
    from doctide.operators.papers import _load

    text = "\n".join(r[0] for r in spark.read.text(path).collect())
    papers = (_load(text) or {}).get("papers") or {}
    rows = [(s, k, str(e.get("title")) if e.get("title") is not None else None, e.get("year"), [str(a) for a in e.get("aliases") or []])
            for k, (s, e) in enumerate(papers.items())]
    return spark.createDataFrame(rows, "slug string, ord int, title string, year int, aliases array<string>")


def write_registry(registry: DataFrame) -> str:
    """The registry as YAML text, entries in order."""
    from doctide.operators.papers import _dump

    rows = registry.orderBy("ord").collect()
    return "# Paper registry\n" + _dump({"papers": {r["slug"]: {
        k: r[k] for k in ("title", "year", "aliases") if r[k] not in (None, [])} for r in rows}})


def with_frontmatter(head, body):
    """A final file: frontmatter, a newline, content."""
    return F.concat(head, F.lit("\n"), body)
