"""Streams over several files and batches, and over several runs."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.streaming import jobs


@pytest.fixture()
def folder(spark, tmp_path):
    """Three files of events; the last two hold none of some users."""
    rows = [(i, f"2024-01-0{1 + i // 20} 00:00:{i % 20:02d}", (i % 7 if i < 20 else i % 3), "click", 1.0, "{}") for i in range(60)]
    for part in range(3):
        df = spark.createDataFrame(rows[part * 20 : part * 20 + 20], "event_id long, t string, user_id long, event_type string, value double, props string")
        df.select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).toPandas().to_parquet(tmp_path / f"events{part}.parquet", coerce_timestamps="us")
    return str(tmp_path), Counter(r[2] for r in rows)


def stream(spark, path):
    return jobs.event_stream(spark, path, files_per_batch=1)


def test_last_states_over_several_batches(spark, folder):
    path, want = folder
    got = jobs.run_available(jobs.running_counts(stream(spark, path)), "update", keys=["user_id"])
    assert {r["user_id"]: r["n"] for r in got.collect()} == want
    with pytest.raises(ValueError, match="keys"):
        jobs.run_available(jobs.running_counts(stream(spark, path)), "update")


def test_a_named_job_goes_on_where_it_ended(spark, folder, tmp_path):
    path, want = folder
    for _ in range(2):  # the second run finds nothing new
        got = jobs.run_available(jobs.running_counts(stream(spark, path)), "update", name=f"t-{tmp_path.name}", keys=["user_id"])
        assert {r["user_id"]: r["n"] for r in got.collect()} == want
    (tmp_path / "events9.parquet").write_bytes((tmp_path / "events0.parquet").read_bytes())
    got = jobs.run_available(jobs.running_counts(stream(spark, path)), "update", name=f"t-{tmp_path.name}", keys=["user_id"])
    assert {r["user_id"]: r["n"] for r in got.collect()} == want + Counter(i % 7 for i in range(20))


def test_complete_mode_and_deduplication_over_batches(spark, folder):
    path, want = folder
    got = jobs.run_available(jobs.windowed_counts(stream(spark, path), "1 day"), "complete")
    assert sorted(r["n"] for r in got.collect()) == [20, 20, 20]
    assert jobs.run_available(jobs.deduplicated(stream(spark, path))).count() == 60


def test_idle_users_start_anew(spark, folder):
    path, _ = folder
    got = jobs.run_available(jobs.running_counts(stream(spark, path), idle_ms=3_600_000), "update", keys=["user_id"])
    # Users 0 to 2 are back a day later, when the state of the first days may be gone; the others are seen on the first day only.
    assert {r["user_id"]: r["n"] for r in got.collect() if r["user_id"] > 2} == {3: 3, 4: 3, 5: 3, 6: 2}


def test_batches_are_numbered_for_merges(spark, folder, tmp_path):
    path, _ = folder
    seen = []
    jobs.upsert_batches(stream(spark, path), lambda batch, number: seen.append((number, batch.count())), name=f"u-{tmp_path.name}")
    jobs.upsert_batches(stream(spark, path), lambda batch, number: seen.append((number, batch.count())), name=f"u-{tmp_path.name}")
    assert seen == [(0, 20), (1, 20), (2, 20)]
