"""JSON records with defaults, a missing required key fails, report files."""

import json
import os

import pytest

from shroud.session import fresh_path
from shroud.sources.records import read_records, write_report
from shroud.sources.tables import read_table


def local(uri):
    return uri.removeprefix("file://").removeprefix("file:")


def test_defaults_and_required(spark):
    base = local(fresh_path(spark, "records-test"))
    os.makedirs(base, exist_ok=True)
    good = os.path.join(base, "good.json")
    with open(good, "w", encoding="utf-8") as fh:
        json.dump([{"start": 1, "end": 3, "entity_type": "PERSON", "text": "Zoë"},
                   {"segment_index": 2, "start": "4", "end": 9, "entity_type": "EMAIL"}], fh, ensure_ascii=False)
    rows = sorted(read_records(spark, good, multi_line=True).collect(), key=lambda r: r.start)
    assert (rows[0].segment_index, rows[0].text) == (0, "Zoë")
    assert (rows[1].segment_index, rows[1].start, rows[1].text) == (2, 4, "")
    bad = os.path.join(base, "bad.json")
    with open(bad, "w", encoding="utf-8") as fh:
        json.dump([{"start": 1, "entity_type": "PERSON"}], fh)
    with pytest.raises(Exception, match="a record lacks end"):
        read_records(spark, bad, multi_line=True).collect()


def test_report_written(spark):
    from shroud.operators.evaluate import eval_metrics, eval_report

    gt = spark.createDataFrame([("PERSON", "a b")], "entity_type string, text string")
    pr = spark.createDataFrame([("PERSON", "A B"), ("ORG", "x")], "entity_type string, text string")
    path = fresh_path(spark, "report-test")
    write_report(spark, eval_report(eval_metrics(gt, pr)), path)
    text = [r.value.split() for r in spark.read.text(path + "/text").collect()]
    assert ["PERSON", "1.0000", "1.0000", "1.0000", "1.0000", "1", "0", "0"] in text and text[-1][0] == "AGGREGATE"
    assert spark.read.json(path + "/rows").count() == 3


def test_missing_input_fails(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_table(spark, "/no/such/folder", "documents")
