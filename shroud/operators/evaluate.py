"""Precision / recall / F1 / accuracy of predictions against ground truth.

Matching is text-level on (entity_type, lower(strip(text))); segment and
offsets are ignored, as in the reference.  ``match="offset"`` compares places
instead: (entity_type, doc_id, segment_index, start, end).  Every prediction
counts, unless a table of ``annotated`` documents is given.  TP counts distinct matched
prediction keys, FP counts prediction rows whose key is not in the truth, FN
counts truth rows whose key was not predicted.  Every type seen in either
input gets a row (zeros kept), plus an AGGREGATE row with the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.functions.text import normalize

KEYS = {"text": ["entity_type", "norm"], "offset": ["entity_type", "doc_id", "segment_index", "start", "end"]}


def _keyed(df: DataFrame, match: str) -> DataFrame:
    if match == "text":
        return df.select("entity_type", normalize("text").alias("norm"))
    return df.select(KEYS[match])


def eval_types(gt: DataFrame, preds: DataFrame) -> DataFrame:
    """the type universe."""
    return gt.select("entity_type").union(preds.select("entity_type")).distinct()


def eval_counts(gt: DataFrame, preds: DataFrame, match: str = "text", annotated: DataFrame | None = None) -> DataFrame:
    """(entity_type, tp, fp, fn) over the type universe, zeros kept.

    ``annotated``: a table of doc_id; where given, only predictions of these documents are scored (a ground truth that
    covers part of a corpus says nothing about the rest).  Default: every prediction is.

    One pass: truth and predictions are counted side by side per key (partial sums before the only shuffle by key, so a key
    that holds a third of all rows is one row a task), then per type.  A key with a null part matches nothing.
    """
    if annotated is not None:
        preds = preds.join(annotated.select("doc_id"), "doc_id", "left_semi")
    key = KEYS[match]
    sides = _keyed(gt, match).withColumns({"g": F.lit(1), "p": F.lit(0)}).unionByName(_keyed(preds, match).withColumns({"g": F.lit(0), "p": F.lit(1)}))
    per_key = sides.groupBy(*key).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    matched = (F.col("g") > 0) & (F.col("p") > 0)
    for c in key:
        matched = matched & F.col(c).isNotNull()
    figures = {"tp": F.when(matched, 1), "fp": F.when(~matched, F.col("p")), "fn": F.when(~matched, F.col("g"))}
    return per_key.groupBy("entity_type").agg(*[F.sum(v.otherwise(0)).cast("long").alias(c) for c, v in figures.items()])


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def with_metrics(counts: DataFrame) -> DataFrame:
    """ratios with 0.0 for zero denominators, same operation order as the reference."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = _ratio(tp, tp + fp)
    r = _ratio(tp, tp + fn)
    return (
        counts.withColumn("precision", p)
        .withColumn("recall", r)
        .withColumn("f1", F.when((F.col("precision") + F.col("recall")) == 0, F.lit(0.0))
                    .otherwise(F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
        .withColumn("accuracy", _ratio(tp, tp + fp + fn))
    )


def eval_metrics(gt: DataFrame, preds: DataFrame, match: str = "text", annotated: DataFrame | None = None) -> DataFrame:
    """F9 + F10: per-type rows and the AGGREGATE row (null sums if there is no row at all).  A type's row counts for itself and for
    all, so that what finds the predictions stands once in the plan."""
    counts = eval_counts(gt, preds, match, annotated)
    figures = ["tp", "fp", "fn"]
    whole = F.struct(F.lit(True).alias("all"), F.lit("AGGREGATE").alias("entity_type"))
    own = F.struct(F.lit(False).alias("all"), "entity_type")
    rows = counts.select(F.explode(F.array(own, whole)).alias("k"), *figures).unionByName(
        counts.sparkSession.range(1).select(whole.alias("k"), *[F.lit(None).cast("long").alias(c) for c in figures]))
    return with_metrics(rows.groupBy("k").agg(*[F.sum(c).alias(c) for c in figures]).select("k.entity_type", *figures))


def eval_report(metrics: DataFrame) -> DataFrame:
    """Report rows, types ascending and AGGREGATE last (``row_order``).
    Ratios stay raw doubles; rounding is for display only."""
    order = F.when(F.col("entity_type") == "AGGREGATE", F.lit(1)).otherwise(F.lit(0))
    return metrics.select(
        "entity_type", "precision", "recall", "f1", "accuracy", "tp", "fp", "fn",
        order.alias("is_aggregate"),
    ).orderBy("is_aggregate", "entity_type")


def format_report(report: DataFrame) -> str:
    """The report as aligned plain text, one line per row; headings and widths follow from the frame's own columns."""
    shown = [c for c in report.columns if c != "is_aggregate"]
    body = [[f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]) for c in shown] for r in report.collect()]  # one row per type
    widths = [max(map(len, column)) for column in zip(shown, *body)]
    return "\n".join("  ".join(cell.ljust(w) for cell, w in zip(row, widths)).rstrip() for row in [shown, *body])
