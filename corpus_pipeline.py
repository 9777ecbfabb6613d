"""From raw documents to packed sequences: five stages, each one operator of ``shroud.llm``.

Every stage takes what its predecessor kept, as a table with the columns of ``documents``, and its decisions take
effect: rows go, or texts lose parts.  A text that loses all it showed goes with its row.  The last stage returns the
pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.llm.common import free_names, stored, table
from shroud.llm.line_dedup import dedup_lines
from shroud.llm.packing import pack_documents
from shroud.llm.quality import keep_good
from shroud.llm.simhash import keep_one
from shroud.llm.suffix_dedup import cut_repeats

WHITE = " \t\n\x0b\x0c\r"


def _edited(df: DataFrame, lost: str, columns: list[str]) -> DataFrame:
    """Rows whose text lost parts get their new length; those with nothing left to see go."""
    changed = F.col(lost) > 0
    shows: Column = F.length(F.translate(F.coalesce("text", F.lit("")), WHITE, "")) > 0
    df = df.where(~changed | shows)
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.when(changed, F.length("text").cast(dict(df.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return df.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: rejected documents go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: blocks of lines that an earlier document holds go."""
    total, lost = free_names(docs, "__lines", "__deleted")
    return _edited(dedup_lines(docs, counts=(total, lost)), lost, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group stays."""
    return keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: byte strings that occur more than once go."""
    (lost,) = free_names(docs, "__removed")
    return _edited(cut_repeats(docs, count=lost), lost, docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: pieces of the packed sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("packing", packed),
]

# The forest, the fingerprints and the tokenizer have no counterpart in SQL: tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
