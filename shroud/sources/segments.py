"""Segmentation: documents -> one row per non-blank paragraph / table cell.

All of it is row-local (``split`` + ``transform`` + ``filter`` + ``posexplode``):
no shuffle, and a document never leaves the task that read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.functions.text import non_blank, non_blank_sql

SEG_FIELDS = ("paragraph_index", "table_index", "row_index", "cell_index", "is_table_cell", "text")


def _body(text: str = "text") -> str:
    items = (f"transform(split({text}, '\\n', -1), (bl, bi) -> named_struct('paragraph_index', bi, "
             "'table_index', cast(null as int), 'row_index', cast(null as int), 'cell_index', cast(null as int), "
             "'is_table_cell', false, 'text', bl))")
    return f"filter({items}, bx -> {non_blank_sql('bx.text')})"


def _cells(cells: str = "cells", table_index: int = 0, row_index: int = 0) -> str:
    items = (f"transform(coalesce({cells}, cast(array() as array<string>)), (cc, ci) -> named_struct("
             f"'paragraph_index', cast(null as int), 'table_index', {table_index}, 'row_index', {row_index}, "
             "'cell_index', ci, 'is_table_cell', true, 'text', cc))")
    return f"filter({items}, cx -> {non_blank_sql('cx.text')})"


def _explode(df: DataFrame, arr, extra: tuple[str, ...] = ()) -> DataFrame:
    # posexplode_outer + null filter: a plain explode makes the optimizer infer
    # a size(arr) > 0 filter below the projection, evaluating ``arr`` twice.
    return df.select("doc_id", *extra, F.posexplode_outer(F.expr(arr)).alias("segment_index", "seg")).where(
        F.col("seg").isNotNull()).select(
        "doc_id", *extra, "segment_index", *[F.col(f"seg.{f}").alias(f) for f in SEG_FIELDS]
    )


def segment_body(docs: DataFrame) -> DataFrame:
    """A2: one segment per non-blank line; paragraph_index counts blank lines too,
    segment_index is dense over the kept ones."""
    return _explode(docs, _body())


def segment_cells(docs: DataFrame) -> DataFrame:
    """A3: one segment per non-blank table cell (table 0, row 0, cell = position)."""
    return _explode(docs, _cells())


def segment_all(docs: DataFrame) -> DataFrame:
    """A4: body first, then cells; segment_index dense over both."""
    return _explode(docs, f"concat({_body()}, {_cells()})")


def segment_texts(docs: DataFrame) -> DataFrame:
    """A4 for readers of texts only: doc_id, segment_index and text of ``segment_all``."""
    texts = f"filter(concat(split(text, '\\n', -1), coalesce(cells, cast(array() as array<string>))), bx -> {non_blank_sql('bx')})"
    return docs.select("doc_id", F.posexplode_outer(F.expr(texts)).alias("segment_index", "text")).where(F.col("text").isNotNull())


def table_cells(df: DataFrame, key: str, columns: list[str], table_index: int) -> DataFrame:
    """A3 on a relational table: unpivot string columns into one segment per cell.

    ``doc_id`` = the row key, row_index = the row key, cell_index = column ordinal.
    """
    cols = F.array(*[
        F.struct(F.lit(j).alias("cell_index"), F.col(c).cast("string").alias("text"))
        for j, c in enumerate(columns)
    ])
    return (
        df.select(F.col(key).cast("long").alias("doc_id"), F.explode(cols).alias("c"))
        .where(non_blank("c.text"))
        .select(
            "doc_id",
            F.col("c.cell_index").alias("segment_index"),
            F.lit(None).cast("int").alias("paragraph_index"),
            F.lit(table_index).alias("table_index"),
            F.col("doc_id").alias("row_index"),
            F.col("c.cell_index").alias("cell_index"),
            F.lit(True).alias("is_table_cell"),
            F.col("c.text").alias("text"),
        )
    )
