"""Event logs: JSON lines, read raw or by type; and rows written as such lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that must be there, by type of event.
REQUIRED = {
    "job_started": ("pdf_path", "output_dir", "total_pages", "quality", "mode"),
    "page_completed": ("page_number", "duration_ms"),
    "heartbeat": ("current_page", "total_pages"),
    "error": ("severity", "error_type", "error_message"),
    "job_completed": ("total_pages", "pages_completed", "pages_failed"),
}
ALWAYS = ("timestamp", "job_id")
SCHEMA = (
    "timestamp string, event_type string, job_id string, pdf_path string, output_dir string, total_pages int, quality string, "
    "mode string, metadata string, page_number int, duration_ms int, hallucination_detected boolean, fallback_used string, "
    "verification_error string, current_page int, pages_completed_since_last_heartbeat int, cpu_percent double, memory_mb int, "
    "severity string, error_type string, error_message string, pages_completed int, pages_failed int, "
    "total_duration_seconds double, avg_velocity_pages_per_hour double, error_count int, warning_count int")
#: What a missing key means.  A key that is there with null stays null.
DEFAULTS = {
    "job_started": {"metadata": "{}"},
    "page_completed": {"hallucination_detected": False},
    "heartbeat": {"pages_completed_since_last_heartbeat": 0, "cpu_percent": 0.0, "memory_mb": 0},
    "job_completed": {"total_duration_seconds": 0.0, "avg_velocity_pages_per_hour": 0.0, "error_count": 0, "warning_count": 0},
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, seq (line of the file), value.  Whole files are read, as the order of lines is part of a log."""
    return (spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("seq", "value"))
            .filter(F.trim("value") != ""))


def raw(lines: DataFrame) -> DataFrame:
    """Lines that are JSON."""
    return lines.filter(F.try_parse_json("value").isNotNull())


def decode(lines: DataFrame) -> DataFrame:
    """Typed events: known types that have their required keys, with defaults for optional ones."""
    keys = F.json_object_keys("value")
    rows = raw(lines).withColumn("_keys", keys).withColumn("_e", F.from_json("value", SCHEMA))
    fits = F.lit(False)
    for kind, names in REQUIRED.items():
        wanted = F.array(*[F.lit(n) for n in (*ALWAYS, *names)])
        fits = fits | ((F.col("_e.event_type") == kind) & (F.size(F.array_except(wanted, F.col("_keys"))) == 0))
    rows = rows.filter(F.coalesce(fits, F.lit(False)))
    others = [c for c in lines.columns if c != "value"]
    return rows.select(*others, "_keys", "_e.*").withColumns(
        {c: _default(c) for c in {c for d in DEFAULTS.values() for c in d}}).drop("_keys")


def _default(name: str) -> Column:
    out = F.col(name)
    for kind, values in DEFAULTS.items():
        if name in values:
            out = F.when((F.col("event_type") == kind) & ~F.array_contains("_keys", name), F.lit(values[name])).otherwise(out)
    return out


def by_directory(spark: SparkSession, root: str) -> DataFrame:
    """Logs root/<job>/events.jsonl; job is the directory's name."""
    return read_lines(spark, f"{root}/*/events.jsonl").withColumn("job", F.element_at(F.split("file", "/"), -2))


def central(spark: SparkSession, root: str) -> DataFrame:
    """Logs root/<job>.jsonl; job is the file's stem."""
    return read_lines(spark, f"{root}/*.jsonl").withColumn("job", F.regexp_extract("file", r"([^/]+)\.jsonl$", 1))


def as_rows(events: DataFrame) -> DataFrame:
    """Decoded events in the form the job operators take."""
    return (events.withColumn("ts", F.try_to_timestamp(F.col("timestamp")))
            .withColumn("ts_us", F.unix_micros("ts")))


def append(events: DataFrame, path: str) -> None:
    """Events as JSON lines, beside those that are there; null fields are left out."""
    events.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def completion(job_id: Column, total: Column, done: Column, failed: Column, seconds: Column, errors: Column, warnings: Column, at: Column) -> list[Column]:
    """Columns of a job_completed event, with its velocity."""
    return [at.alias("timestamp"), F.lit("job_completed").alias("event_type"), job_id.alias("job_id"), total.alias("total_pages"),
            done.alias("pages_completed"), failed.alias("pages_failed"), F.round(seconds, 2).alias("total_duration_seconds"),
            F.round(F.when(seconds > 0, done / seconds * 3600).otherwise(0.0), 1).alias("avg_velocity_pages_per_hour"),
            errors.alias("error_count"), warnings.alias("warning_count")]


class JobLog:
    """Events of one job as its driver emits them.  As a context it ends with job_completed, after an error if one was raised."""

    def __init__(self, job_id: str, total_pages: int, now, **started):
        self.job_id, self.total, self.now, self.rows = job_id, total_pages, now, []
        self.done = self.failed = self.errors = self.warnings = self.beat_page = 0
        self.begin = now()
        self._emit("job_started", total_pages=total_pages, **{"pdf_path": "", "output_dir": "", "quality": "balanced", "mode": "streaming", "metadata": {}} | started)

    def _emit(self, kind: str, **fields) -> None:
        self.rows.append({"timestamp": self.now().strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "event_type": kind, "job_id": self.job_id} | fields)

    def page(self, number: int, duration_ms: int, **more) -> None:
        self.done += 1
        self._emit("page_completed", page_number=number, duration_ms=duration_ms, **more)

    def heartbeat(self, current_page: int, cpu_percent: float = 0.0, memory_mb: int = 0) -> None:
        since, self.beat_page = current_page - self.beat_page, current_page
        self._emit("heartbeat", current_page=current_page, total_pages=self.total, pages_completed_since_last_heartbeat=since,
                   cpu_percent=cpu_percent, memory_mb=memory_mb)

    def error(self, kind: str, message: str, severity: str = "error", page_number: int | None = None) -> None:
        self.errors += severity == "error"
        self.warnings += severity != "error"
        self._emit("error", severity=severity, error_type=kind, error_message=message, page_number=page_number)

    def __enter__(self) -> JobLog:
        return self

    def __exit__(self, kind, error, trace) -> bool:
        if error is not None and not isinstance(error, (SystemExit, KeyboardInterrupt)):
            self.error("transcription_failure", str(error))
        seconds = (self.now() - self.begin).total_seconds()
        self._emit("job_completed", total_pages=self.total, pages_completed=self.done, pages_failed=self.failed,
                   total_duration_seconds=round(seconds, 2),
                   avg_velocity_pages_per_hour=round(self.done / seconds * 3600, 1) if seconds > 0 else 0.0,
                   error_count=self.errors, warning_count=self.warnings)
        return False

    def lines(self, spark: SparkSession) -> DataFrame:
        """seq, value: the log as a table of lines."""
        import json

        return spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(self.rows)], "seq long, value string")
