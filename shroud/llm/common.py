"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.session import stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def row_key(*cols: Column) -> list[Column]:
    """128 bits that name a row by its values (two independent 64-bit hashes), so that null or repeated ids
    need no special case: rows with equal values share a key, and get equal results."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit("k2"), *reversed(cols), F.lit(0x9E37)).alias("k2")]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names for helpers that no column of ``df`` has (Spark compares them without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def own_exchange(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with its long ``keys`` passed through an expression, for the side of a join that was aggregated by them.  Spark
    would read such a side where the aggregate left it, and AQE splits hot partitions of the other side only where
    both have an exchange of their own."""
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast("long")) for k in keys})
