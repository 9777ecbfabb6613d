"""Overlap handling on the relational span table: passes over spans sorted by place, nothing gathered.

One shuffle brings the spans of a segment together, Spark sorts them (and spills if it must), and a task reads them in
order, holding a single span or the few that are still open:

* ``resolve_segment_spans`` - D2: the left-to-right fold; the last kept span is all it carries.
* ``overlap_pairs`` - D1 as a plane sweep: spans that reach beyond the present start are open, a new span meets just these.
* ``overlap_islands`` - running island numbers (a span starting at or after every earlier end opens a new island).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shroud.functions.text import values_of

KEYS = ("doc_id", "segment_index")
KINDS = {"start": "int", "end": "int", "entity_type": "string", "text": "string", "score": "double", "source": "string", "prio": "int"}
PAIRED = ("start", "end", "entity_type", "source")


def _in_order(spans: DataFrame, keys: tuple[str, ...], *order) -> DataFrame:
    return spans.repartition(*keys).sortWithinPartitions(*keys, *order)


def resolution_order() -> list:
    """By start, then the longest, then the highest score, then the tie order."""
    return [F.col("start"), F.col("end").desc(), F.col("score").desc(), F.col("prio")]


def resolve_segment_spans(spans: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """D2 per segment: a span that overlaps the last kept one replaces it if it is longer, or as long with a higher score;
    a disjoint one makes the last kept one final."""
    whole = spans.select(*keys, *[F.col(c).cast(k).alias(c) for c, k in KINDS.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, last, waiting = None, None, None  # the last kept span, and its row if it came in an earlier batch
        for batch in batches:
            if not batch.num_rows:
                continue
            where = zip(*(values_of(batch.column(c)) for c in keys))
            figures = zip(*(values_of(batch.column(c)) for c in ("start", "end", "score")))
            final, at = [], -1  # row of the last kept span in this batch, -1: in ``waiting``
            for k, (key, span) in enumerate(zip(where, figures)):
                if key == place and span[0] < last[1] and last[0] < span[1]:
                    longer = (span[1] - span[0]) - (last[1] - last[0])
                    if longer > 0 or longer == 0 and span[2] > last[2]:
                        last, at, waiting = span, k, None
                    continue
                if at >= 0:
                    final.append(at)
                elif waiting is not None:
                    yield waiting
                place, last, at, waiting = key, span, k, None
            if final:
                yield batch.take(pa.array(final, pa.int64()))
            if at >= 0:
                waiting = batch.take(pa.array([at], pa.int64()))  # a copy: the batch can go
        if waiting is not None:
            yield waiting

    return _in_order(whole, keys, *resolution_order()).mapInArrow(run, whole.schema)


def overlap_islands(spans: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Island id per span: running max(end) over the resolution order, excluding the row itself."""
    w = Window.partitionBy(*keys).orderBy(*resolution_order())
    prev_end = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = spans.withColumn("_new", F.when(prev_end.isNull() | (F.col("start") >= prev_end), 1).otherwise(0))
    return flagged.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def resolve_by_islands(spans: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """D2 island by island: the same result, since a span that opens an island cannot touch the last kept one."""
    return resolve_segment_spans(overlap_islands(spans, keys), (*keys, "island")).drop("island")


def overlap_pairs(spans: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Pairs of spans in one segment with a.start < b.end and b.start < a.end, a before b by (start, end, prio, type,
    source).  Work is spans plus pairs; a task holds the spans that are open at one place."""
    whole = spans.select(*keys, *[F.col(c).cast(KINDS[c]).alias(c) for c in (*PAIRED, "prio")])
    sides = [f"{side}_{c}" for side in "ab" for c in PAIRED]
    schema = ", ".join([*(f"`{k}` {kind}" for k, kind in whole.select(*keys).dtypes), *(f"{s} {KINDS[s[2:]]}" for s in sides)])
    types = {"int": pa.int32(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, open_ = None, []
        for batch in batches:
            row, found = [], []
            where = zip(*(values_of(batch.column(c)) for c in keys))
            for k, (key, span) in enumerate(zip(where, zip(*(values_of(batch.column(c)) for c in PAIRED)))):
                open_ = [a for a in open_ if a[1] > span[0]] if key == place else []
                place = key
                for a in open_:
                    if a[0] < span[1]:  # always so, but for empty spans
                        row.append(k)
                        found.append(a + span)
                open_.append(span)
            columns = list(zip(*found)) or [()] * len(sides)
            own = batch.select(list(keys)).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*own.columns, *(pa.array(c, types[KINDS[s[2:]]]) for c, s in zip(columns, sides))], [*keys, *sides])

    return _in_order(whole, keys, "start", "end", "prio", "entity_type", "source").mapInArrow(run, schema)


