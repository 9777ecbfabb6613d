"""Table access: parquet scans of the input tables (column pruning left to Catalyst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; a missing path raises Spark's AnalysisException."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
