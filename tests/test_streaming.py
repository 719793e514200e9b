"""Streams end in the same place as their batch twins."""

import datetime as dt
import random

import pytest

from hedgerow.operators import corpus, jobs
from hedgerow.sources import sinks
from hedgerow.streaming import admission, ingest, lifecycle, progress


def ts(seconds):
    return dt.datetime(2025, 1, 1) + dt.timedelta(seconds=seconds)


def as_stream(spark, df, path, order, parts=3):
    """Write ``df`` in ``parts`` files in order and read them back one per micro-batch."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, tmp_path, name, mode="append"):
    # a query with processing-time state would otherwise go on with empty batches for ever
    stream.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    query = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start())
    finished = query.awaitTermination(90)
    query.stop()
    assert finished
    return stream.sparkSession.table(name)


COLUMNS = ["key", "request_id", "admitted", "remaining", "retry_after"]


def in_files(spark, path, schema, *parts):
    """A stream that reads one part per micro-batch."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_admission_stream(spark, tmp_path):
    """Rows out of order within the delay are decided like the sorted log; rows beyond it are refused and take no place."""
    rng, schema = random.Random(9), "key string, request_id int, ts timestamp"
    rows = [(k, i, ts(t)) for k in ("a", "b") for i, t in enumerate(sorted(rng.randrange(0, 300) for _ in range(60)))]
    shuffled = sorted(rows, key=lambda r: r[2].timestamp() + rng.uniform(0, 9))
    late, ends = ("a", 999, ts(5)), [("end", i, ts(1000 + 1000 * i)) for i in range(3)]
    stream = in_files(spark, str(tmp_path / "in"), schema, shuffled[:40], shuffled[40:80], [*shuffled[80:], late],
                      *([e] for e in ends))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    query = (admission.admit_stream(stream, 4, 60).writeStream.format("memory").queryName("admitted").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    assert query.awaitTermination(120)
    got = spark.table("admitted").filter("key <> 'end'")
    assert [tuple(r) for r in got.filter("late").select(COLUMNS).collect()] == [("a", 999, False, 0, None)]
    want = jobs.admit_requests(spark.createDataFrame(rows, schema), 4, 60)
    assert sorted(map(tuple, got.filter("not late").select(COLUMNS).collect()), key=str) == sorted(
        map(tuple, want.select(COLUMNS).collect()), key=str)
    # nothing of a and b is left: the newest row of ``end`` waits, with its timer
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) > 20 and held[-1] <= 6, held


def test_lifecycle_stream(spark, tmp_path):
    rng = random.Random(10)
    rows, n = [], 0
    for i in range(60):
        app, review = f"A{i % 3}", f"r{i}"
        for event in ("queued", "processing", "completed")[:rng.randrange(1, 4)]:
            rows.append((app, review, event, rng.random() < 0.2, ts(n), n))
            n += 1
    df = spark.createDataFrame(rows, "application_ref string, review_id string, event string, force boolean, ts timestamp, event_id int")
    got = run(lifecycle.lifecycle_stream(as_stream(spark, df, str(tmp_path / "in"), "event_id")), tmp_path, "states")
    want = lifecycle.lifecycle_batch(df)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_progress_stream(spark, tmp_path):
    rng = random.Random(11)
    phases = ("fetching_metadata", "ingesting_documents", "generating_review")
    rows = [(f"r{rng.randrange(4)}", rng.choice(phases), rng.choice(("start", "progress", "complete", "error")), rng.randrange(5), 5, ts(i), i)
            for i in range(90)]
    df = spark.createDataFrame(rows, "review_id string, phase string, event string, sub_current int, sub_total int, ts timestamp, event_id int")
    got = run(progress.progress_stream(as_stream(spark, df, str(tmp_path / "in"), "event_id")), tmp_path, "progress", "complete")
    assert sorted(map(str, got.collect())) == sorted(map(str, jobs.review_progress(df).collect()))


def test_window_counts_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", i, ts(i * 7)) for i in range(40)], "key string, request_id int, ts timestamp")
    got = run(jobs.count_requests(as_stream(spark, df, str(tmp_path / "in"), "ts")), tmp_path, "counts", "complete")
    assert sorted(map(str, got.collect())) == sorted(map(str, jobs.count_requests(df).collect()))


def test_ingest_stream_writes_each_content_once(spark, tmp_path):
    rows = [(i, f"text number {i % 5} " * 80, ts(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "document_id int, text string, arrived_at timestamp")
    stream = as_stream(spark, df, str(tmp_path / "in"), "arrived_at")
    table = str(tmp_path / "chunks")
    query = ingest.ingest_stream(stream, table, str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    stored = sinks.read_current(spark, table)
    want = corpus.chunk_text(df.filter("document_id < 5"))
    assert stored.select("content_hash").distinct().count() == 5 and stored.count() == want.count()
    again = ingest.ingest_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), table, str(tmp_path / "cp2")).start()
    again.processAllAvailable()
    again.stop()
    assert sinks.read_current(spark, table).count() == want.count()


@pytest.mark.parametrize("bad", ["missing"])
def test_reading_a_table_that_is_not_there(spark, tmp_path, bad):
    assert sinks.read_current(spark, str(tmp_path / bad), "a int").count() == 0
