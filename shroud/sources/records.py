"""Prediction and annotation records as JSON, reports as files.

Records are JSON objects with ``segment_index`` (default 0), ``start``,
``end`` and ``entity_type`` (required), ``text`` (default ""), and for
predictions ``score`` and ``source``.  Reading uses an explicit schema, so no
inference pass runs over the data, and FAILFAST on malformed input; a record
missing a required key raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# integers are read as text and cast, so "4" and 4 both load (a non-number raises)
RECORD_SCHEMA = ("doc_id string, segment_index string, start string, end string, entity_type string, text string, "
                 "score double, source string")


def write_records(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write records as JSON lines (non-ASCII kept as is)."""
    w = df.write.mode("overwrite").option("ignoreNullFields", "false")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def read_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A5: read records with defaults applied and integer / string casts, in one pass: a record that lacks a required
    key, or whose number is none, fails the job that reads it."""
    raw = (spark.read.schema(RECORD_SCHEMA).option("mode", "FAILFAST")
           .option("multiLine", multi_line).json(path))
    needed = lambda k: F.coalesce(F.col(k), F.raise_error(F.lit(f"a record lacks {k} in {path}")).cast("string"))
    return raw.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("segment_index"), F.lit(0)).cast("long").alias("segment_index"),
        needed("start").cast("long").alias("start"),
        needed("end").cast("long").alias("end"),
        needed("entity_type").alias("entity_type"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        "score", "source",
    )


def write_report(spark: SparkSession, report: DataFrame, path: str) -> None:
    """The metric rows as JSON, and as text (a handful of rows)."""
    from shroud.operators.evaluate import format_report

    report.coalesce(1).write.mode("overwrite").json(path + "/rows")
    spark.createDataFrame([(format_report(report),)], "report string").coalesce(1).write.mode("overwrite").text(path + "/text")
