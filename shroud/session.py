"""SparkSession construction and the shared folder for intermediate tables.

Library code sets no master, no memory and no number of shuffle partitions: those belong to the cluster, and to whoever
starts the job (``bench.py`` and the tests set their own).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
# Number of partitions that text is dealt to before the detectors run; unset: twice the session's parallelism, unless the
# reader makes as many splits.
INPUT_PARTITIONS = "spark.shroud.inputPartitions"


def build_session(app_name: str = "shroud", config: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **(config or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under the cluster's shared ``spark.checkpoint.dir``.  Where that is unset, a session in
    one process (as in tests) gets a temporary one; on a cluster there is no folder that all executors see, so this
    fails instead of guessing one."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{sc.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: its work runs once however many branches of a
    plan read it, the lineage is cut, and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_exchange(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with its long ``keys`` passed through an expression, for the side of a join that was aggregated by them.  Spark
    would read such a side where the aggregate left it, and AQE splits hot partitions of the other side only where
    both have an exchange of their own."""
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast("long")) for k in keys})


def _path(spark: SparkSession, path: str):
    """(file system, path) of any store that Spark reads."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def paths_under(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder (a file itself); nothing if there is no such path."""
    store, there = _path(spark, path)
    return [str(s.getPath()) for s in store.listStatus(there)] if store.exists(there) else []


def delete_path(spark: SparkSession, path: str) -> None:
    store, there = _path(spark, path)
    store.delete(there, True)


def clear_shared(spark: SparkSession) -> None:
    """Delete what this application stored.  Results that still read it must be written first."""
    delete_path(spark, shared_folder(spark))


def dealt(df: DataFrame, splits: int = 0) -> DataFrame:
    """``df`` dealt to as many partitions as ``spark.shroud.inputPartitions`` says.  Where that is unset: to twice the session's
    parallelism, since a file of few row groups, whatever its splits, keeps few tasks busy; where the input has as many
    ``splits`` anyway, the rows stay where they are."""
    spark = df.sparkSession
    n = spark.conf.get(INPUT_PARTITIONS, None)
    if n:
        return df.repartition(int(n))
    n = 2 * spark.sparkContext.defaultParallelism
    return df if splits >= n else df.repartition(n)


def splits_of(scan: DataFrame) -> int:
    """Into how many splits the reader cuts a plain scan.  Plans it, runs nothing."""
    return scan.rdd.getNumPartitions()
