import json

import pytest
from pyspark.sql import functions as F

from doctide.operators import jobs
from doctide.sources import documents, event_log


def started(total=10, **more):
    return {"event_type": "job_started", "pdf_path": "a.pdf", "output_dir": "/out/j", "total_pages": total, "quality": "balanced", "mode": "streaming"} | more


def page(n, **more):
    return {"event_type": "page_completed", "page_number": n, "duration_ms": 1500} | more


def beat(n, **more):
    return {"event_type": "heartbeat", "current_page": n, "total_pages": 10} | more


def error(severity="error", n=None, **more):
    return {"event_type": "error", "severity": severity, "error_type": "t", "error_message": "m", "page_number": n} | more


def done(total=10, pages=10, failed=0, **more):
    return {"event_type": "job_completed", "total_pages": total, "pages_completed": pages, "pages_failed": failed} | more


def log(spark, events, job="j"):
    rows = []
    for k, e in enumerate(events):
        e = {"timestamp": f"2026-02-14T19:{k // 60:02d}:{k % 60:02d}.000000Z", "job_id": job} | e
        rows.append((k, json.dumps(e)))
    lines = spark.createDataFrame(rows, "seq long, value string")
    return event_log.as_rows(event_log.decode(lines))


def state(spark, events):
    return jobs.discover(log(spark, events)).first()


def test_success(spark):
    r = state(spark, [started(5), *map(page, range(1, 6)), done(5, 5, error_count=0, warning_count=0)])
    assert (r.is_active, r.pages_completed, r.total_pages, r.error_count, r.current_page) == (False, 5, 5, 0, 5) and r.completed_at


def test_errors(spark):
    r = state(spark, [started(10), *map(page, range(1, 9)), error("error", 9), error("warning", 10), done(10, 8, 2, error_count=1, warning_count=1)])
    assert (r.is_active, r.error_count, r.warning_count) == (False, 1, 1)


def test_open_job_without_heartbeat_is_not_stalled(spark):
    rows = log(spark, [started(20), page(1)])
    r = jobs.stalled(jobs.discover(rows), F.lit("2027-01-01").cast("timestamp")).first()
    assert (r.is_active, r.completed_at, r.pages_completed, r.is_stalled) == (True, None, 1, False)


def test_silence_stalls(spark):
    rows = log(spark, [started(20), beat(3)])
    at = lambda s: jobs.stalled(jobs.discover(rows), F.lit(f"2026-02-14 {s}").cast("timestamp")).first().is_stalled
    assert not at("19:02:01") and at("19:02:02")


def test_heartbeat_overwrites_current_page(spark):
    assert state(spark, [started(), page(7), beat(3)]).current_page == 3
    assert state(spark, [started(), page(7), beat(3), page(5)]).current_page == 5


def test_errors_after_completion_add_up(spark):
    assert state(spark, [started(), error(), done(error_count=4), error(), error("warning")]).error_count == 5


def test_finished_file_completes_a_job(spark):
    files = spark.createDataFrame([("j", "2026-02-15 00:00:00")], "job_id string, modified string").withColumn("modified", F.col("modified").cast("timestamp"))
    assert not jobs.discover(log(spark, [started()]), files).first().is_active


@pytest.mark.parametrize("bad", [
    {"event_type": "quantum_fluctuation"}, {"event_type": "warning"}, {"event_type": "job_started"}, {"event_type": "heartbeat", "current_page": 1}])
def test_rejected_events(spark, bad):
    assert log(spark, [bad]).count() == 0


def test_malformed_lines(spark):
    lines = spark.createDataFrame([(0, "not valid json"), (1, "{incomplete"), (2, ""), (3, "1")], "seq long, value string")
    assert event_log.decode(lines).count() == 0


def test_null_is_not_absent(spark):
    r = log(spark, [beat(1, cpu_percent=None), beat(2)]).orderBy("seq").collect()
    assert r[0].cpu_percent is None and r[1].cpu_percent == 0.0 and r[1].memory_mb == 0


def test_round_trip(spark, tmp_path):
    events = log(spark, [started(), page(1), beat(1), error(), done()]).drop("ts", "ts_us", "seq")
    event_log.append(events, str(tmp_path / "log"))
    again = event_log.decode(event_log.read_lines(spark, str(tmp_path / "log" / "*.txt"))).drop("seq", "file")
    key = lambda df: sorted(map(str, df.select(sorted(events.columns)).collect()))
    assert key(again) == key(events)


def test_metrics(spark):
    rows = log(spark, [started(10), *map(page, range(1, 7)), beat(6)])
    m = jobs.metrics(rows).first()
    assert (m.current_page, m.pages_completed, m.window_size, m.progress_percent) == (6, 6, 6, 60.0)
    assert m.velocity == 4320.0 and m.eta_hours == pytest.approx(4 / 4320)
    odd = jobs.metrics(log(spark, [started(3), *map(page, (1, 2, 4, 5, 8)), beat(2)])).first()
    assert odd.progress_percent == 66.7 and odd.velocity == round(odd.velocity, 1)
    few = jobs.metrics(log(spark, [started(10), page(1)])).first()
    assert (few.velocity, few.window_size, few.eta_hours, few.progress_percent) == (0.0, 0, None, 0.0)


def test_resume(spark):
    s = jobs.last_validated(jobs.resume_state(log(spark, [started(5), page(3), page(1), page(3), error("error", 4), error("error", 2), error("error", 4), error("warning", 5)])), 2)
    r = s.first()
    assert (r.completed_pages, r.failed_pages, r.validated) == ([1, 3, 3], [4, 2], [3, 3])
    assert sorted(x.page_number for x in jobs.pending_pages(s).collect()) == [2, 4, 5]
    assert jobs.next_chunk(s, 2).first().pages == [2, 4] and jobs.next_chunk(s, 0).first().pages == [2, 4, 5]
    p = jobs.progress_summary(s).first()
    assert (p.completed, p.failed, p.pending, p.completion_percentage) == (3, 2, 3, 60.0)


def test_no_pages_pending_of_none(spark):
    assert jobs.pending_pages(jobs.resume_state(log(spark, [started(0)]))).count() == 0


def test_cleanup(spark):
    def events(job, completed, out="/o/"):
        return [("job_started", out + job if out else None, job, 0)] + [("job_completed", None, job, 1)] * completed

    rows = events("a", 1) + events("b", 0) + events("c", 1) + events("d", 1) + events("e", 1, None)
    logs = spark.createDataFrame(rows, "event_type string, output_dir string, job_id string, seq int")
    files = spark.createDataFrame([("/o/a", "a.md"), ("/o/a", "x.md"), ("/o/b", "b.md"), ("/o/d", "d.original.md")], "output_dir string, file_name string")
    got = jobs.cleanup(logs, files)
    assert {r.job_id: r.decision for r in got.collect()} == {
        "a": "delete", "b": "keep: not completed", "c": "keep: no final file", "d": "keep: no final file", "e": "keep: no output directory"}
    assert tuple(jobs.cleanup_totals(got).first()) == (5, 1, 4)
    assert tuple(jobs.cleanup_totals(jobs.cleanup(logs.limit(0), files)).first()) == (0, 0, 0)


def test_texts(spark):
    r = spark.range(1).select(
        jobs.elapsed_text(F.lit(3700)).alias("a"), jobs.elapsed_text(F.lit(59)).alias("b"), jobs.eta_text(F.lit(0.5)).alias("c"), jobs.eta_text(F.lit(2.25)).alias("d"),
        jobs.eta_text(F.lit(None).cast("double")).alias("e"), jobs.ago_text(F.lit(90000)).alias("f"), jobs.progress_bar(F.lit(50)).alias("g")).first()
    assert (r.a, r.b, r.c, r.e, r.f) == ("1h 1m", "0m", "~30m", "Unknown", "1d ago") and r.d in ("~2.2h", "~2.3h") and r.g.count("━") == 15


def test_files(spark, tmp_path):
    for name in ("a/a.md", "a/b.md", "b/b.original.md", "c/events.jsonl"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text('{"job_id": "c"}')
    files = documents.list_files(spark, str(tmp_path))
    assert [r.file_name for r in documents.final_files(files).collect()] == ["a.md"]
    assert documents.paper_count(files).first().papers == 2
    assert [r.job for r in event_log.by_directory(spark, str(tmp_path)).collect()] == ["c"]
    state_file = tmp_path / "state.json"
    state_file.write_text(json.dumps({"pdf_source": "x", "total_pages": 3, "completed_pages": [1], "failed_pages": []}))
    (tmp_path / "bad.json").write_text("{")
    assert [r.completed_pages for r in documents.read_state(spark, str(tmp_path / "*.json")).collect()] == [[1]]
    (tmp_path / "r.yaml").write_text("papers:\n  a-b:\n    title: T\n    aliases:\n    - X\n")
    registry = documents.read_registry(spark, str(tmp_path / "r.yaml"))
    assert registry.first().aliases == ["X"] and "a-b:" in documents.write_registry(registry)


class Clock:
    def __init__(self):
        from datetime import datetime

        self.at = datetime(2026, 2, 14)

    def __call__(self):
        from datetime import timedelta

        self.at += timedelta(seconds=1)
        return self.at


def test_lifecycle(spark):
    with event_log.JobLog("j", 3, Clock()) as job:
        for n in (1, 2, 3):
            job.page(n, 10)
        job.heartbeat(3)
    assert [r["event_type"] for r in job.rows] == ["job_started", *["page_completed"] * 3, "heartbeat", "job_completed"]
    typed = event_log.as_rows(event_log.decode(job.lines(spark)))
    assert typed.count() == 6 and not jobs.discover(typed).first().is_active


def test_lifecycle_with_an_error(spark):
    with pytest.raises(RuntimeError), event_log.JobLog("j", 10, Clock()) as job:
        job.failed = 1
        for n in (1, 2, 3):
            job.page(n, 10)
        raise RuntimeError("no")
    assert [r["event_type"] for r in job.rows][-2:] == ["error", "job_completed"]
    assert job.rows[-2]["error_type"] == "transcription_failure" and (job.rows[-1]["pages_completed"], job.rows[-1]["pages_failed"]) == (3, 1)
    assert event_log.decode(job.lines(spark)).count() == 6


def test_metrics_at_a_time(spark):
    rows = log(spark, [started(10), *map(page, range(1, 7)), beat(6, cpu_percent=12.5, memory_mb=300)])
    m = jobs.metrics(rows, as_of=F.lit("2026-02-14 20:00:00").cast("timestamp")).first()
    assert (m.cpu_percent, m.memory_mb, m.elapsed_seconds) == (12.5, 300, 3600.0)
    assert (m.completion_time.minute, m.completion_time.second) == (0, 3)  # four pages at 4320 an hour
    bare = jobs.metrics(log(spark, [started(10), page(1)]), as_of=F.lit("2026-02-14 20:00:00").cast("timestamp")).first()
    assert (bare.cpu_percent, bare.memory_mb, bare.completion_time) == (0.0, 0, None)


def test_state_files_stand_in(spark, tmp_path):
    resumed = jobs.resume_state(log(spark, [started(5), page(3)]))
    saved = spark.createDataFrame(
        [("j", "x.pdf", 9, [9], []), ("k", "k.pdf", 7, [1, 2], [4])],
        "job_id string, pdf_source string, total_pages int, completed_pages array<int>, failed_pages array<int>")
    documents.write_state(saved, str(tmp_path / "states"))
    documents.write_state(saved.filter("job_id = 'k'").withColumn("total_pages", F.lit(8)), str(tmp_path / "states"))
    states = documents.read_state(spark, str(tmp_path / "states" / "*" / "*.txt")).withColumn("job_id", F.regexp_extract("path", "job_id=([^/]+)", 1))
    got = {r.job_id: (r.total_pages, r.completed_pages, r.failed_pages) for r in jobs.with_state_files(
        resumed, states.select("job_id", "total_pages", "completed_pages", "failed_pages")).collect()}
    assert got == {"j": (5, [3], []), "k": (8, [1, 2], [4])}


def test_outputs_and_links_of_jobs(spark):
    files = spark.createDataFrame([("/o/Rising Sea (pub)", "b.md"), ("/o/Rising Sea (pub)", "a.original.md"), ("/o/other", "c.txt")], "output_dir string, file_name string")
    ids = spark.createDataFrame([("rising-sea-pub",), ("other",)], "job_id string")
    assert {r.job_id: r.path for r in jobs.find_outputs(ids, files).collect()} == {"rising-sea-pub": "/o/Rising Sea (pub)/b.md", "other": None}
    logs = spark.createDataFrame([("/t/a.jsonl", "/o/a"), ("/t/b.jsonl", "/o/b"), ("/t/c.jsonl", None)], "path string, output_dir string")
    links = spark.createDataFrame([("/o/a/events.jsonl", "/t/a.jsonl"), ("/o/x/events.jsonl", "/t/b.jsonl")], "path string, target string")
    assert {r.path: r.link for r in jobs.link_of_log(logs, links).collect()} == {"/t/a.jsonl": "/o/a/events.jsonl", "/t/b.jsonl": None, "/t/c.jsonl": None}
