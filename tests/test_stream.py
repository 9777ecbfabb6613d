"""Streaming: late rows, batch = stream, and a restarted query resumes."""

import datetime as dt
import os
import uuid

from shroud.session import fresh_path
from shroud.sources.segments import segment_all
from shroud.streaming.stream import entity_count_stream, entity_counts_by_window, last_counts, redact_batch, redact_segments_stream, redact_stream


def test_late_rows_dropped(spark):
    base = fresh_path(spark, "late-test")
    src = os.path.join(base, "in")
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    d = dt.datetime
    put([(1, d(2024, 1, 1, 10), 1, "e", 0.0, "{}"), (2, d(2024, 1, 3, 10), 2, "e", 0.0, "{}")])
    stream = spark.readStream.schema(schema).parquet(src)
    name = "late_" + uuid.uuid4().hex[:8]
    q = (entity_counts_by_window(stream).writeStream.format("memory").queryName(name)
         .option("checkpointLocation", os.path.join(base, "ckpt")).outputMode("update").start())
    try:
        q.processAllAvailable()
        put([(3, d(2024, 1, 1, 11), 3, "e", 0.0, "{}"), (4, d(2024, 1, 3, 11), 4, "e", 0.0, "{}")])
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.table(name).collect()
    day1 = max(r.n for r in rows if r.window_start.startswith("2024-01-01") and r.entity_type == "EMAIL")
    day3 = max(r.n for r in rows if r.window_start.startswith("2024-01-03") and r.entity_type == "EMAIL")
    assert day1 == 1  # the second day-1 row arrived behind the watermark
    assert day3 == 2


def test_stream_equals_batch_and_resumes(spark):
    base = fresh_path(spark, "stream-test")
    docs = [(k, f"Ann Lee wrote a@b{k}.co\nNothing\n\nAnn Lee and Acme Corp") for k in range(6)]
    schema = "doc_id long, text string"
    dictionary = spark.createDataFrame([("Ann Lee", "PERSON"), ("Acme Corp", "ORG")], "entry string, label string")

    def put(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/{name}.parquet")

    put(docs[:3], "documents")
    out, checkpoint = f"{base}/out", f"{base}/checkpoint"
    got = redact_stream(spark, f"{base}/in", dictionary, out, checkpoint).collect()
    again = redact_stream(spark, f"{base}/in", dictionary, out, checkpoint).collect()
    assert sorted(got) == sorted(again)  # nothing new: the query goes on where it was
    batch = spark.createDataFrame([(*d, None) for d in docs[:3]], schema + ", cells array<string>")
    assert sorted(got) == sorted(redact_batch(batch, dictionary).collect())
    text = " ".join(r.redacted for r in got)
    assert len(got) == 9 and "Ann" not in text and "Acme" not in text and "@b" not in text


def test_first_seen_types_outlive_batches_and_restarts(spark):
    """A document spread over batches: an original keeps the type, and so the surrogate, that it was first seen with."""
    base = fresh_path(spark, "segment-stream-test")
    schema = "doc_id long, segment_index int, text string"
    dictionary = spark.createDataFrame([("Ann Lee", "PERSON"), ("Acme", "ORG")], "entry string, label string")
    rows = [[(d, k, t) for d in range(4)] for k, t in enumerate([
        "Ann Lee, born 01/02/1980", "seen 01/02/1980 by a@b.co", "", "Acme and Ann Lee, 01/02/1980", "a@b.co once more"])]

    def put(batch, name):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{base}/in/{name}.parquet")

    def run(dictionary):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{base}/in")
        return sorted(tuple(r) for r in redact_segments_stream(spark, source, dictionary, f"{base}/out", f"{base}/checkpoint").collect())

    for k in range(3):
        put(rows[k], k)
    first = run(dictionary)
    for k in (3, 4):
        put(rows[k], k)
    # after a restart the state comes from the checkpoint: "Ann Lee" was first seen as a person, whatever it counts as now
    got = run(spark.createDataFrame([("Ann Lee", "ORG"), ("Acme", "ORG")], "entry string, label string"))
    assert len(first) == 12 and set(first) <= set(got) and len(got) == 20
    docs = spark.createDataFrame([(d, "\n".join(r[d][2] for r in rows), None) for d in range(4)], "doc_id long, text string, cells array<string>")
    batch = sorted(r.redacted for r in redact_batch(docs, dictionary).collect())
    assert sorted(r for _, _, r in got if r) == batch and segment_all(docs).count() == 16
    assert not any("Ann" in r or "@b" in r for _, _, r in got)


def test_closed_windows_are_written_once(spark):
    base = fresh_path(spark, "window-test")
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    days = [1, 1, 2, 3, 5, 5, 6]
    for k, day in enumerate(days):
        rows = [(10 * k + n, dt.datetime(2024, 1, day, 6 + n), n, "e", 0.0, "{}") for n in range(3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/events.parquet/part{k}")
    flat = f"{base}/flat/events.parquet"
    for k in range(len(days)):
        spark.read.parquet(f"{base}/in/events.parquet/part{k}").coalesce(1).write.mode("append").parquet(flat)
        got = entity_count_stream(spark, f"{base}/flat", f"{base}/out", f"{base}/checkpoint", files=1)
    want = sorted((f"2024-01-{d:02d} 00:00:00", t, 3 * days.count(d)) for d in set(days) for t in ("EMAIL", "IP_ADDRESS"))
    assert sorted(tuple(r) for r in got.collect()) == want
    open_ = [p for p in os.listdir(f"{base}/out/open".removeprefix("file:")) if p.startswith("batch=")]
    assert len(open_) <= 2  # what earlier batches held open is gone
    latest = max(int(p.split("=")[1]) for p in open_)
    assert {r.window_start[:10] for r in spark.read.parquet(f"{base}/out/open/batch={latest}").collect()} == {"2024-01-05", "2024-01-06"}  # (the fifth ends less than the delay before the latest window)
    closed = spark.read.parquet(f"{base}/out/closed")
    assert closed.groupBy("window_start", "entity_type").count().where("count > 1").count() == 0
    assert last_counts(spark, f"{base}/nowhere").count() == 0


def test_cells_in_the_stream(spark):
    base = fresh_path(spark, "cell-stream-test")
    docs = [(1, "nothing", ["a@b.co", "", "Ann Lee"]), (2, "Ann Lee", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, cells array<string>")
    df.coalesce(1).write.parquet(f"{base}/in/documents.parquet")
    dictionary = spark.createDataFrame([("Ann Lee", "PERSON")], "entry string, label string")
    got = sorted(redact_stream(spark, f"{base}/in", dictionary).collect())
    assert got == sorted(redact_batch(df, dictionary).collect())
    assert [(r.doc_id, r.segment_index) for r in got] == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert not any("@b" in r.redacted or "Ann" in r.redacted for r in got)
