"""H1 / H2: Structured Streaming versions of the job.

* ``redact_stream`` - documents arrive as a file stream.  Each micro-batch goes through the batch job itself (all three
  layers, body and cells, first-seen surrogates); documents are whole rows, so the batches' output together equals
  that of one batch over the same rows.
* ``redact_segments_stream`` - segments arrive, so a document may be spread over batches.  Which type an original was first
  seen with is keyed state (one map per document), so an original keeps its surrogate from batch to batch and over restarts.
* ``entity_count_stream`` - hits per entity type per tumbling event-time window.  The watermark bounds how late a row
  may arrive and lets go of closed windows.  A batch hands on the windows that are still open and writes those that closed
  once and for all, so neither writing nor reading goes back to earlier batches.

A batch writes a folder of its own name, so a repeated batch overwrites itself.  Give ``checkpoint`` and ``out`` to let a
restarted query resume after its last committed batch; without them a run is a fresh one in the shared folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from shroud.functions.surrogate import salt_sql, surrogate_sql
from shroud.operators.detect import detect_regex, explode_spans
from shroud.operators.hybrid import hybrid_spans, predictions
from shroud.operators.redact import rebuild_sql, redact_spans
from shroud.session import dealt, delete_path, fresh_path, paths_under, stored
from shroud.sources import segments as S


def _one(sf_dir: str, name: str) -> str:
    """A pattern for one table, be it a file or a folder (a stream takes a single file only as a pattern)."""
    return f"{sf_dir.rstrip('/')}/{name}.parque[t]"


def by_batch(writer: DataStreamWriter, change: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Run a stream to its end, each micro-batch through ``change`` into a folder of its own under ``out``."""

    def write(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def redact_batch(docs: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    """(doc_id, segment_index, redacted) of documents (doc_id, text, cells), by all layers.  The predictions are read
    twice (pairs and spans), so they are stored."""
    segments = S.segment_all(dealt(docs)).select("doc_id", "segment_index", "text")
    found = stored(predictions(hybrid_spans(segments, dictionary)), "predictions")
    return redact_spans(segments, found).select("doc_id", F.col("segment_index").cast("long").alias("segment_index"), "redacted")


def redact_stream(spark: SparkSession, sf_dir: str, dictionary: DataFrame | None = None,
                  out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """H1: run the documents stream to completion (availableNow) into parquet; return the output.  Cells are read where the
    documents have them."""
    out = out or fresh_path(spark, "stream-redact")
    dictionary = None if dictionary is None else stored(dictionary, "dictionary")  # every batch reads it
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").schema
    docs = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(_one(sf_dir, "documents"))
    )
    docs = docs.select("doc_id", "text", (F.col("cells") if "cells" in docs.columns else F.lit(None)).cast("array<string>").alias("cells"))
    by_batch(docs.writeStream, lambda batch: redact_batch(batch, dictionary), out, checkpoint or fresh_path(spark, "stream-checkpoint"))
    return spark.read.parquet(out).drop("batch")


SPANS_JSON = "array<struct<start:int,end:int,entity_type:string,text:string>>"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """Keyed by document: the type that each original was first seen with, in order of segments and places, over all batches.
    The map's entries are read one by one, so a task never holds a document's whole map."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.types = handle.getMapState("types", "original string", "entity_type string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("segment_index", kind="stable")  # of one document in one batch
        known: dict[str, str] = {}
        out = []
        for spans in batch["spans"]:
            found = json.loads(spans)
            for span in sorted(found, key=lambda s: s["start"]):
                original = span["text"]
                if original not in known:
                    if not self.types.containsKey((original,)):
                        self.types.updateValue((original,), (span["entity_type"],))
                    known[original] = self.types.getValue((original,))[0]
                span["entity_type"] = known[original]
            out.append(json.dumps(found))
        yield batch.assign(spans=out)

    def close(self) -> None:
        pass


def found_in_batch(segments: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    """(doc_id, segment_index, text, spans) of segments: predictions of all layers as JSON, in order; "[]" where there are none."""
    segments = segments.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("segment_index").cast("int").alias("segment_index"), "text")
    found = predictions(hybrid_spans(segments, dictionary)).groupBy("doc_id", "segment_index").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("start", "end", "entity_type", "text")))).alias("spans"))  # of one segment
    return segments.join(found, ["doc_id", "segment_index"], "left").withColumn("spans", F.coalesce("spans", F.lit("[]")))


def redact_segments_stream(spark: SparkSession, segments: DataFrame, dictionary: DataFrame | None = None, out: str | None = None,
                           checkpoint: str | None = None, scope: str = "corpus") -> DataFrame:
    """H1 over a stream of segments (doc_id, segment_index, text), run to completion: (doc_id, segment_index, redacted).

    Two queries, one after the other, each with its own checkpoint: detection by the batch job, micro-batch by micro-batch,
    and first-seen types by keyed state, from which surrogates and texts follow row by row.  As long as segments of a document
    arrive in order, the result is that of one batch, however they are dealt to batches.
    """
    out, checkpoint = out or fresh_path(spark, "stream-segments"), checkpoint or fresh_path(spark, "stream-checkpoint")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    by_batch(segments.writeStream, lambda batch: found_in_batch(batch, dictionary), f"{out}/found", f"{checkpoint}/found")
    kinds = "doc_id long, segment_index int, text string, spans string"
    found = spark.readStream.schema(kinds + ", batch int").parquet(f"{out}/found").drop("batch")
    typed = found.groupBy("doc_id").transformWithStateInPandas(FirstSeen(), kinds, "append", "none")
    surrogates = f"transform(spans, sp -> named_struct('start', sp.start, 'end', sp.`end`, 'surrogate', {surrogate_sql('sp.entity_type', 'sp.text', salt_sql(scope))}))"
    shown = f"CASE WHEN size(spans) = 0 THEN text ELSE {rebuild_sql('text', 'replaced')} END"
    redacted = typed.withColumn("spans", F.from_json("spans", SPANS_JSON)).withColumn("replaced", F.expr(surrogates)).select("doc_id", "segment_index", F.expr(shown).alias("redacted"))
    by_batch(redacted.writeStream, lambda batch: batch, f"{out}/redacted", f"{checkpoint}/redacted")
    return spark.read.parquet(f"{out}/redacted").drop("batch")


def event_texts(df: DataFrame) -> DataFrame:
    """Planted event text: one EMAIL and one IP per event."""
    return df.select(
        F.col("event_id").alias("doc_id"), F.lit(0).alias("segment_index"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("user u"), F.col("user_id").cast("string"), F.lit("@mail.example.com from 10.0."),
                 (F.col("user_id") % 256).cast("string"), F.lit("."), (F.col("event_id") % 256).cast("string"))
        .alias("text"),
    )


def entity_counts_by_window(events: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Hits per entity type per tumbling event-time window (streaming F1)."""
    spans = detect_regex(event_texts(events))
    hits = explode_spans(spans, keys=("doc_id", "segment_index", "ts"))
    return (
        hits.withWatermark("ts", watermark)
        .groupBy(F.window("ts", window).alias("w"), "entity_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "entity_type", "n")
    )


COUNTS = "window_start string, entity_type string, n long"


def settle_counts(changed: DataFrame, number: int, out: str, window: str, watermark: str) -> None:
    """Batch ``number`` of windowed counts: ``open/`` gets the last count of every window that may still change, ``closed/`` the
    others, for good.  A window is closed once it ends before the latest window's start less the delay: the stream's own
    watermark is at least that, so no later batch can change it.  Only the open windows of the batch before are read."""
    spark = changed.sparkSession
    before = f"{out}/open/batch={number - 1}"
    held = spark.read.schema(COUNTS).parquet(before) if paths_under(spark, before) else spark.createDataFrame([], COUNTS)
    counts = stored(held.join(changed, ["window_start", "entity_type"], "left_anti").unionByName(changed), "open-windows")
    start = F.to_timestamp("window_start")
    latest = counts.select(F.max(start)).scalar()
    over = start + F.expr(f"INTERVAL {window}") <= latest - F.expr(f"INTERVAL {watermark}")
    counts.where(over).write.mode("overwrite").parquet(f"{out}/closed/batch={number}")
    counts.where(~over).write.mode("overwrite").parquet(f"{out}/open/batch={number}")  # last: it says that the batch is whole
    delete_path(spark, f"{out}/open/batch={number - 2}")


def last_counts(spark: SparkSession, out: str) -> DataFrame:
    """The last count of every window and type: what closed up to the last whole batch, and what was open after it."""
    whole = [int(p.rsplit("=", 1)[1]) for p in paths_under(spark, f"{out}/open") if paths_under(spark, f"{p}/_SUCCESS")]
    if not whole:
        return spark.createDataFrame([], COUNTS)
    closed = spark.read.schema(COUNTS + ", batch int").parquet(f"{out}/closed").where(F.col("batch") <= max(whole)).drop("batch")
    return closed.unionByName(spark.read.schema(COUNTS).parquet(f"{out}/open/batch={max(whole)}"))


def entity_count_stream(spark: SparkSession, sf_dir: str, out: str | None = None, checkpoint: str | None = None,
                        window: str = "1 day", watermark: str = "1 hour", files: int | None = None) -> DataFrame:
    """H2: windowed counts over the events stream, run to completion; at most ``files`` files a batch."""
    out = out or fresh_path(spark, "stream-counts")
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    reader = spark.readStream.schema(schema)
    events = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(_one(sf_dir, "events"))
    writer = entity_counts_by_window(events, window, watermark).writeStream.outputMode("update")
    (writer.foreachBatch(lambda batch, number: settle_counts(batch, number, out, window, watermark))
     .option("checkpointLocation", checkpoint or fresh_path(spark, "stream-checkpoint")).trigger(availableNow=True).start().awaitTermination())
    return last_counts(spark, out)
