import json
import time

from pyspark.sql import functions as F

from doctide.streaming import monitor


def write(folder, job, events):
    folder.mkdir(exist_ok=True)
    rows = [json.dumps({"timestamp": f"2026-02-14T19:00:{k:02d}.000000Z", "job_id": job} | e) for k, e in enumerate(events)]
    (folder / f"{job}.jsonl").write_text("\n".join(rows) + "\n")


PAGE = {"event_type": "page_completed", "page_number": 1, "duration_ms": 5}
BEAT = {"event_type": "heartbeat", "current_page": 4, "total_pages": 9}
END = {"event_type": "job_completed", "total_pages": 9, "pages_completed": 2, "pages_failed": 0}


def test_states_follow_the_log(spark, tmp_path):
    write(tmp_path / "in", "a", [PAGE, BEAT, PAGE | {"page_number": 6}])
    write(tmp_path / "in", "b", [PAGE, END])
    typed = monitor.events(monitor.read_stream(spark, str(tmp_path / "in"))).withColumn("seq", F.unix_micros("ts"))
    seen = []
    q = (monitor.job_states(typed).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check"))
         .foreachBatch(lambda df, k: seen.extend(df.collect())).trigger(processingTime="1 second").start())
    end = time.time() + 90
    while len({r.job_id for r in seen}) < 2 and time.time() < end and q.isActive:
        time.sleep(0.5)
    q.stop()
    last = {r.job_id: r for r in seen}
    assert (last["a"].pages_completed, last["a"].current_page, last["a"].is_active) == (2, 6, True)
    assert (last["b"].pages_completed, last["b"].is_active) == (1, False)


def test_each_event_counts_once(spark, tmp_path):
    write(tmp_path / "in", "a", [PAGE])
    seen = []

    def run():
        typed = monitor.events(monitor.read_stream(spark, str(tmp_path / "in")))
        monitor.keep_state(typed, "t", str(tmp_path / "check"), lambda df, k: seen.extend(df.collect())).awaitTermination(120)

    run()
    write(tmp_path / "in", "b", [PAGE, END])
    run()
    run()
    assert sorted(r.job_id for r in seen) == ["a", "b", "b"]
