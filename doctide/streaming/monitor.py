"""Jobs as a stream: logs are tailed, state is kept up by batch, stalls by timer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from doctide.sources.event_log import decode


def read_stream(spark: SparkSession, root: str) -> DataFrame:
    """value, file of each new line below root."""
    return spark.readStream.text(root, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"))


def events(lines: DataFrame) -> DataFrame:
    return decode(lines).withColumn("ts", F.try_to_timestamp(F.col("timestamp")))


def windowed_pages(typed: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Pages by job and window of time; rows later than the watermark are dropped."""
    return (typed.filter("event_type = 'page_completed'").withWatermark("ts", late)
            .groupBy(F.window("ts", width), "job_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("duration_ms").alias("duration_ms"))
            .select("window.start", "job_id", "pages", "duration_ms"))


def keep_state(typed: DataFrame, table: str, checkpoint: str, update: Callable[[DataFrame, int], None]):
    """update gets each batch; with the checkpoint and an idempotent update each event counts once."""
    return typed.writeStream.queryName(table).option("checkpointLocation", checkpoint).foreachBatch(update).trigger(availableNow=True).start()


NAMES = ["job_id", "pages_completed", "current_page", "last_heartbeat_us", "errors", "is_active", "is_stalled"]
FOLD = "job_id string, pages_completed long, current_page int, last_heartbeat_us long, errors long, is_active boolean, is_stalled boolean"
STATE = "pages long, page int, heartbeat long, errors long, active boolean"


def _fold(stale_ms: int):
    def run(key, frames, state: GroupState):
        pages, page, beat, errors, active = state.get if state.exists else (0, 0, 0, 0, True)
        if state.hasTimedOut:
            yield pd.DataFrame([(key[0], pages, page, beat, errors, active, active and beat > 0)], columns=NAMES)
            return
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for r in rows.itertuples():
            if r.event_type == "page_completed":
                pages, page = pages + 1, max(page, int(r.page_number))
            elif r.event_type == "heartbeat":
                page, beat = int(r.current_page), int(r.ts.value // 1000)
            elif r.event_type == "error":
                errors += r.severity == "error"
            elif r.event_type == "job_completed":
                active = False
        state.update((pages, page, beat, errors, active))
        if active and beat:
            state.setTimeoutDuration(stale_ms)
        yield pd.DataFrame([(key[0], pages, page, beat, errors, active, False)], columns=NAMES)

    return run


def job_states(typed: DataFrame, stale_seconds: int = 120) -> DataFrame:
    """A row for each job and batch, and one when a job has been silent for longer than stale_seconds.

    typed: job_id, seq, ts, event_type, page_number, current_page, severity.
    """
    return typed.groupBy("job_id").applyInPandasWithState(
        _fold(stale_seconds * 1000), FOLD, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
