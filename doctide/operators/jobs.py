"""Job telemetry: state, metrics, resume, cleanup.

Events are rows (job_id, seq, ts, event_type, ...) with seq the order in the log.  Folds
over a log become aggregates: "the last of a kind" is max_by over seq, "after the last of
a kind" a second pass against that seq.  Both are partial aggregates; no log is brought
into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctide.operators.papers import job_name_cleanup

WINDOW, MIN_PAGES, STALE_SECONDS = 50, 5, 120

DISCOVER = """
WITH marks AS (
  SELECT job_id,
    max(CASE WHEN event_type = 'heartbeat' THEN seq END) AS hb_seq,
    max(CASE WHEN event_type = 'job_completed' THEN seq END) AS done_seq
  FROM {events} GROUP BY job_id),
state AS (
  SELECT e.job_id,
    max_by(total_pages, CASE WHEN event_type = 'job_started' THEN seq END) AS total_pages,
    max_by(quality, CASE WHEN event_type = 'job_started' THEN seq END) AS quality,
    max_by(ts, CASE WHEN event_type = 'job_started' THEN seq END) AS started_at,
    count(CASE WHEN event_type = 'page_completed' THEN 1 END) AS pages_completed,
    max(CASE WHEN event_type = 'page_completed' AND (m.hb_seq IS NULL OR seq > m.hb_seq) THEN page_number END) AS page_after,
    max_by(current_page, CASE WHEN event_type = 'heartbeat' THEN seq END) AS hb_page,
    max_by(ts, CASE WHEN event_type = 'heartbeat' THEN seq END) AS last_heartbeat,
    max_by(cpu_percent, CASE WHEN event_type = 'heartbeat' THEN seq END) AS cpu_percent,
    max_by(memory_mb, CASE WHEN event_type = 'heartbeat' THEN seq END) AS memory_mb,
    max_by(ts, CASE WHEN event_type = 'job_completed' THEN seq END) AS completed_at,
    coalesce(max_by(error_count, CASE WHEN event_type = 'job_completed' THEN seq END), 0)
      + count(CASE WHEN event_type = 'error' AND severity = 'error' AND (m.done_seq IS NULL OR seq > m.done_seq) THEN 1 END) AS error_count,
    coalesce(max_by(warning_count, CASE WHEN event_type = 'job_completed' THEN seq END), 0)
      + count(CASE WHEN event_type = 'error' AND severity <> 'error' AND (m.done_seq IS NULL OR seq > m.done_seq) THEN 1 END) AS warning_count
  FROM {events} e JOIN marks m ON e.job_id = m.job_id GROUP BY e.job_id)
SELECT job_id, total_pages, quality, started_at, pages_completed,
  greatest(coalesce(hb_page, 0), coalesce(page_after, CASE WHEN hb_page IS NULL THEN 0 ELSE hb_page END)) AS current_page,
  last_heartbeat, coalesce(cpu_percent, 0.0) AS cpu_percent, coalesce(memory_mb, 0) AS memory_mb,
  completed_at, error_count, warning_count, completed_at IS NULL AS is_active
FROM state
"""

VELOCITY = """
WITH last AS (
  SELECT job_id, ts_us FROM (
    SELECT job_id, ts_us, row_number() OVER (PARTITION BY job_id ORDER BY ts_us DESC) AS r
    FROM {events} WHERE event_type = 'page_completed' AND ts_us IS NOT NULL AND page_number IS NOT NULL) w
  WHERE r <= {window}),
span AS (SELECT job_id, count(*) AS n, (max(ts_us) - min(ts_us)) / 1000000.0 AS seconds FROM last GROUP BY job_id)
SELECT job_id, CASE WHEN n < {least} THEN 0 ELSE n END AS window_size,
  CASE WHEN n < {least} OR seconds <= 0 THEN 0.0E0 ELSE CAST(n AS DOUBLE) / (CAST(seconds AS DOUBLE) / 3600.0E0) END AS velocity
FROM span
"""

METRICS = """
WITH base AS (
  SELECT job_id,
    max_by(total_pages, CASE WHEN event_type = 'job_started' THEN seq END) AS total_pages,
    count(CASE WHEN event_type = 'job_started' THEN 1 END) AS starts,
    coalesce(max_by(current_page, CASE WHEN event_type = 'heartbeat' THEN seq END), 0) AS current_page,
    coalesce(max_by(cpu_percent, CASE WHEN event_type = 'heartbeat' THEN seq END), 0.0E0) AS cpu_percent,
    coalesce(max_by(memory_mb, CASE WHEN event_type = 'heartbeat' THEN seq END), 0) AS memory_mb,
    max_by(ts_us, CASE WHEN event_type = 'job_started' THEN seq END) AS started_us,
    count(CASE WHEN event_type = 'page_completed' AND ts_us IS NOT NULL AND page_number IS NOT NULL THEN 1 END) AS pages_completed
  FROM {events} GROUP BY job_id)
SELECT b.job_id, b.current_page, b.total_pages, b.pages_completed,
  CASE WHEN b.total_pages > 0 THEN round(CAST(b.current_page AS DOUBLE) / b.total_pages * 100, 1) ELSE 0.0E0 END AS progress_percent,
  round(v.velocity, 1) AS velocity, v.window_size,
  CASE WHEN v.velocity > 0 AND b.total_pages > b.current_page THEN (b.total_pages - b.current_page) / v.velocity END AS eta_hours,
  b.cpu_percent, b.memory_mb, b.started_us
FROM base b JOIN {velocity} v ON b.job_id = v.job_id WHERE b.starts > 0 AND b.pages_completed > 0
"""


def discover(events: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """Job state.  outputs (job_id, modified): finished files stand in for a missing completion."""
    out = events.sparkSession.sql(DISCOVER, events=events)
    if outputs is None:
        return out
    out = out.join(outputs.select("job_id", F.col("modified").alias("_m")), "job_id", "left")
    return out.withColumn("completed_at", F.coalesce("completed_at", "_m")).withColumn(
        "is_active", F.col("completed_at").isNull()).drop("_m")


def stalled(jobs: DataFrame, as_of: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    late = F.unix_micros(as_of) - F.unix_micros("last_heartbeat") > seconds * 1_000_000
    return jobs.withColumn("is_stalled", F.col("is_active") & F.coalesce(late, F.lit(False)))


def velocity(events: DataFrame, window: int = WINDOW, least: int = MIN_PAGES) -> DataFrame:
    return events.sparkSession.sql(VELOCITY.replace("{window}", str(window)).replace("{least}", str(least)), events=events)


def metrics(events: DataFrame, window: int = WINDOW, least: int = MIN_PAGES, as_of: Column | None = None) -> DataFrame:
    """Progress of started jobs with a page.  as_of adds elapsed_seconds and completion_time."""
    out = events.sparkSession.sql(METRICS, events=events, velocity=velocity(events, window, least))
    if as_of is None:
        return out
    now = F.unix_micros(as_of)
    return out.withColumns({
        "elapsed_seconds": (now - F.col("started_us")) / 1_000_000,
        "completion_time": F.timestamp_micros(now + F.round(F.col("eta_hours") * 3_600_000_000).cast("long"))})


def ranked(jobs: DataFrame) -> DataFrame:
    """Active jobs first, by current page; then finished ones, the latest first."""
    return jobs.orderBy(F.desc("is_active"), F.when(F.col("is_active"), -F.col("current_page")), F.desc("completed_at"), "job_id")


def resume_state(events: DataFrame) -> DataFrame:
    """First start, completed pages (sorted, with repeats), failed pages in order of first failure."""
    failed = (events.filter("event_type = 'error' AND severity = 'error' AND page_number IS NOT NULL AND page_number <> 0")
              .groupBy("job_id", "page_number").agg(F.min("seq").alias("seq"))
              .groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "page_number"))), lambda x: x["page_number"]).alias("failed_pages")))
    base = events.groupBy("job_id").agg(
        F.min_by("total_pages", F.when(F.col("event_type") == "job_started", F.col("seq"))).alias("total_pages"),
        F.count(F.when(F.col("event_type") == "job_started", 1)).alias("_starts"),
        F.array_sort(F.collect_list(F.when(F.col("event_type") == "page_completed", F.col("page_number")))).alias("completed_pages"),
        F.max_by("ts", "seq").alias("last_updated"))
    return (base.filter("_starts > 0").drop("_starts").join(failed, "job_id", "left")
            .withColumn("failed_pages", F.coalesce("failed_pages", F.array().cast("array<int>"))))


def with_state_files(resumed: DataFrame, states: DataFrame) -> DataFrame:
    """resumed, and for jobs whose log gives no state the one that was saved (states: job_id and resumed's other columns)."""
    return resumed.unionByName(states.join(resumed.select("job_id"), "job_id", "left_anti"), allowMissingColumns=True)


def last_completed(events: DataFrame) -> DataFrame:
    """Last completed page, or 0."""
    return events.groupBy("job_id").agg(F.coalesce(F.max(F.when(F.col("event_type") == "page_completed", F.col("page_number"))), F.lit(0)).alias("last_page"))


def last_validated(state: DataFrame, n: int = 10) -> DataFrame:
    return state.withColumn("validated", F.slice("completed_pages", F.greatest(F.size("completed_pages") - n, F.lit(0)) + 1, n))


def pending_array(state_total: Column, completed: Column) -> Column:
    """Pages 1..total that are not complete; failed ones are tried again."""
    every = F.when(state_total > 0, F.sequence(F.lit(1), state_total)).otherwise(F.array().cast("array<int>"))
    return F.array_except(every, completed)


def pending_pages(state: DataFrame) -> DataFrame:
    return state.select("job_id", F.explode(pending_array(F.col("total_pages"), F.col("completed_pages"))).alias("page_number"))


def next_chunk(state: DataFrame, size: int) -> DataFrame:
    pending = pending_array(F.col("total_pages"), F.col("completed_pages"))
    return state.select("job_id", (F.slice(pending, 1, size) if size > 0 else pending).alias("pages"))


def progress_summary(state: DataFrame) -> DataFrame:
    pending = F.size(pending_array(F.col("total_pages"), F.col("completed_pages")))
    return state.select(
        "job_id", "total_pages", F.size("completed_pages").cast("long").alias("completed"), F.size("failed_pages").cast("long").alias("failed"),
        pending.cast("long").alias("pending"),
        F.when(F.col("total_pages") > 0, F.size("completed_pages") / F.col("total_pages") * 100).otherwise(0.0).alias("completion_percentage"))


def recent(events: DataFrame, n: int = 10, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The last n events of each job, newest first."""
    from pyspark.sql import Window

    rows = events.filter(F.col("event_type").isin(*kinds)) if kinds else events
    by = Window.partitionBy("job_id").orderBy(F.desc("seq"))
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)


def pages_since_heartbeat(events: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("job_id").orderBy("seq")
    return events.filter("event_type = 'heartbeat'").withColumn("pages_since", F.col("current_page") - F.lag("current_page", 1, 0).over(by))


def cleanup(logs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Decision for each log: delete where the job is complete and its output directory holds a final file.

    logs: job_id, event_type, output_dir, seq.  outputs: output_dir, file_name.
    """
    done = logs.groupBy("job_id").agg(
        F.bool_or(F.col("event_type") == "job_completed").alias("completed"),
        F.min_by("output_dir", F.when(F.col("event_type") == "job_started", F.col("seq"))).alias("output_dir"))
    final = outputs.filter(F.col("file_name").endswith(".md") & ~F.col("file_name").endswith(".original.md")).select(
        "output_dir", F.lit(True).alias("_final")).distinct()
    return done.join(final, "output_dir", "left").select(
        "job_id", "completed",
        F.when(~F.coalesce("completed", F.lit(False)), "keep: not completed").when(F.col("output_dir").isNull(), "keep: no output directory")
        .when(F.col("_final").isNull(), "keep: no final file").otherwise("delete").alias("decision"))


def find_outputs(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """jobs with path, the first final file below a directory whose normalised name is the job's id; null where there is none."""
    name = job_name_cleanup(F.element_at(F.split("output_dir", "/"), -1))
    final = files.filter(F.col("file_name").endswith(".md") & ~F.col("file_name").endswith(".original.md"))
    first = final.groupBy(name.alias("job_id")).agg(F.min(F.concat_ws("/", "output_dir", "file_name")).alias("path"))
    return jobs.join(first, "job_id", "left")


def link_of_log(logs: DataFrame, links: DataFrame) -> DataFrame:
    """logs (path, output_dir) with link, the one named events.jsonl in output_dir that leads to the log (links: path, target, both resolved)."""
    at = links.select(F.col("path").alias("link"), F.col("target").alias("path"))
    here = F.col("link") == F.concat(F.col("output_dir"), F.lit("/events.jsonl"))
    return logs.join(at, "path", "left").withColumn("link", F.when(here, F.col("link"))).groupBy(*logs.columns).agg(F.max("link").alias("link"))


def cleanup_totals(decisions: DataFrame) -> DataFrame:
    return decisions.agg(F.count(F.lit(1)).alias("found"), F.count(F.when(F.col("decision") == "delete", 1)).alias("deleted"),
                         F.count(F.when(F.col("decision") != "delete", 1)).alias("kept"))


# -- what a display shows ----------------------------------------------------------


def elapsed_text(seconds: Column) -> Column:
    whole = F.floor(seconds)
    h, m = F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60)
    return F.when(seconds.isNull(), "Unknown").when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m"))).otherwise(
        F.concat(m.cast("string"), F.lit("m")))


def eta_text(hours: Column) -> Column:
    return F.when(hours.isNull() | (hours <= 0), "Unknown").when(
        hours < 1, F.concat(F.lit("~"), F.floor(hours * 60).cast("string"), F.lit("m"))).otherwise(F.format_string("~%.1fh", hours))


def ago_text(seconds: Column) -> Column:
    part = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(unit))
    return F.when(seconds.isNull(), "unknown").when(seconds < 3600, part(60, "m ago")).when(seconds < 86400, part(3600, "h ago")).otherwise(part(86400, "d ago"))


def progress_bar(percent: Column, width: int = 30) -> Column:
    filled = F.floor(percent * width / 100).cast("int")
    return F.concat(F.repeat(F.lit("━"), filled), F.repeat(F.lit("─"), width - filled))
