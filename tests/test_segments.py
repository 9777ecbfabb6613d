"""Segmentation: dense segment index over non-blank lines, blank lines keep their paragraph index,
cells follow the body, relational tables unpivot into cell segments."""

from shroud.sources.segments import segment_all, table_cells


def test_body_then_cells(spark):
    docs = spark.createDataFrame(
        [(1, "first\n\n  \nsecond\t\nthird", ["cell a", " ", "cell c"]), (2, "", None)],
        "doc_id long, text string, cells array<string>")
    rows = [(r.doc_id, r.segment_index, r.paragraph_index, r.cell_index, r.is_table_cell, r.text)
            for r in segment_all(docs).orderBy("doc_id", "segment_index").collect()]
    assert rows == [
        (1, 0, 0, None, False, "first"),
        (1, 1, 3, None, False, "second\t"),
        (1, 2, 4, None, False, "third"),
        (1, 3, None, 0, True, "cell a"),
        (1, 4, None, 2, True, "cell c"),
    ]


def test_table_cells(spark):
    t = spark.createDataFrame([(7, "Ann", " ", 3.5)], "k long, name string, blank string, bal double")
    rows = sorted((r.doc_id, r.cell_index, r.text) for r in table_cells(t, "k", ["name", "blank", "bal"], 2).collect())
    assert rows == [(7, 0, "Ann"), (7, 2, "3.5")]
