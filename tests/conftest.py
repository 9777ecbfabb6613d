import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .appName("shroud-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shroud-tests-"))
    yield s


def seg_df(spark, texts):
    """Segments (doc_id, segment_index, text) from a list of texts, one document each."""
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, segment_index int, text string")
