"""Metrics: worked examples with fixed numbers."""

from shroud.operators.evaluate import eval_metrics, eval_report, format_report

SCHEMA = "doc_id long, segment_index int, start int, end int, entity_type string, text string"
TRUTH = [(1, 0, 0, 7, "PERSON", "Ann Lee"), (1, 1, 0, 2, "PERSON", "Bo"), (1, 2, 3, 9, "EMAIL", "a@b.co"), (2, 0, 0, 11, "SSN", "123-45-6789")]
FOUND = [(1, 0, 0, 8, "PERSON", " ann lee"), (1, 3, 0, 7, "PERSON", "Ann Lee"), (1, 4, 0, 4, "ORG", "Acme"), (1, 5, 0, 4, "ORG", "Acme"),
         (1, 2, 3, 9, "EMAIL", "A@B.CO"), (9, 0, 0, 3, "ORG", "Far")]


def metrics(spark, **how):
    rows = eval_metrics(spark.createDataFrame(TRUTH, SCHEMA), spark.createDataFrame(FOUND, SCHEMA), **how).collect()
    return {r.entity_type: (r.tp, r.fp, r.fn, round(r.precision, 4), round(r.recall, 4), round(r.f1, 4), round(r.accuracy, 4)) for r in rows}


def test_by_text(spark):
    assert metrics(spark) == {
        "PERSON": (1, 0, 1, 1.0, 0.5, 0.6667, 0.5),  # two rows of one value are one hit
        "EMAIL": (1, 0, 0, 1.0, 1.0, 1.0, 1.0),
        "ORG": (0, 3, 0, 0.0, 0.0, 0.0, 0.0),  # every wrong row counts
        "SSN": (0, 0, 1, 0.0, 0.0, 0.0, 0.0),
        "AGGREGATE": (2, 3, 2, 0.4, 0.5, 0.4444, 0.2857),
    }


def test_by_place_and_annotated_documents(spark):
    got = metrics(spark, match="offset", annotated=spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert got["EMAIL"][:3] == (1, 0, 0) and got["PERSON"][:3] == (0, 2, 2) and got["ORG"][:3] == (0, 2, 0) and got["AGGREGATE"][:3] == (1, 4, 3)


def test_report_text(spark):
    report = eval_report(eval_metrics(spark.createDataFrame(TRUTH, SCHEMA), spark.createDataFrame(FOUND, SCHEMA)))
    lines = format_report(report).split("\n")
    assert lines[0].split() == [c for c in report.columns if c != "is_aggregate"]
    assert [x.split()[0] for x in lines[1:]] == ["EMAIL", "ORG", "PERSON", "SSN", "AGGREGATE"]
    assert lines[-1].split()[1:5] == ["0.4000", "0.5000", "0.4444", "0.2857"]


def test_counts_equal_plain_sets(spark):
    import random
    from collections import Counter

    rnd = random.Random(6)
    row = lambda: (rnd.randrange(3), 0, 0, 4, rnd.choice("ABC"), rnd.choice(["x", " X", "y", "z", "zz", "hot"]))
    truth, found = [row() for _ in range(60)], [row() for _ in range(200)] + [(0, 0, 0, 3, "A", "hot")] * 2000
    key = lambda r: (r[4], r[5].strip().lower())
    t, p = Counter(map(key, truth)), Counter(map(key, found))
    got = {r.entity_type: (r.tp, r.fp, r.fn) for r in eval_metrics(spark.createDataFrame(truth, SCHEMA), spark.createDataFrame(found, SCHEMA)).collect()}
    for kind in "ABC":
        assert got[kind] == (sum(k in t for k in p if k[0] == kind), sum(n for k, n in p.items() if k[0] == kind and k not in t),
                             sum(n for k, n in t.items() if k[0] == kind and k not in p))


def test_one_shuffle_by_key(spark):
    from shroud.operators.evaluate import eval_counts

    plan = eval_counts(spark.createDataFrame(TRUTH, SCHEMA), spark.createDataFrame(FOUND, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") <= 2
    assert plan.index("Exchange") < plan.index("partial_sum", plan.index("Exchange"))  # combined before the shuffle
