"""What the detectors find in a batch is held as columns: same spans as text by text, and no Python call per text to resolve them."""

import random

import numpy as np

from shroud.functions import spans as SP
from shroud.functions.text import luhn_passes, luhn_passing
from shroud.operators import detect as D
from shroud.operators import hybrid as H

TEXTS = ["the Company and Ann Lee, a@b.co, 123-45-6789", None, "", "born 1980 DOB: 1/2/1990 4111111111111111 4111111111111112", "é Ann Lee of QX, 10.1.2.3",
         "Ann\nAnn Lee Ann", "call +1 212 555 0199 today", "Card 35٣٠١١١٣٣٣٠٠٠٠٠٦.", "a@b.co " * 40, "ssn 123456789 in 2001-02-03, 4111 1111 1111 1111"]
ENTRIES = [("Ann", "PERSON", 10), ("Ann Lee", "PERSON", 10), ("Lee", "ORG", 11), ("Lee", "PERSON", 10), ("Company", "ORG", 11), ("the Company", "ORG", 11), ("QX", "PERSON", 10)]


def folded(spans):
    """The fold, span by span."""
    kept = []
    for s in sorted(spans, key=lambda s: (s[0], s[0] - s[1], -s[4], s[6])):
        if kept and s[0] < kept[-1][1] and kept[-1][0] < s[1]:
            longer = (s[1] - s[0]) - (kept[-1][1] - kept[-1][0])
            if longer > 0 or longer == 0 and s[4] > kept[-1][4]:
                kept[-1] = s
        else:
            kept.append(s)
    return kept


def test_fold_of_many_segments_is_that_of_each():
    rnd = random.Random(5)
    for reach in (3, 30, 400):
        rows, spans = [], []
        for row in range(60):
            for _ in range(rnd.choice([0, 1, 2, 3, 40])):
                start = rnd.randrange(reach)
                rows.append(row)
                spans.append((start, start + rnd.randrange(12), "T", "", rnd.choice([0.4, 0.85, 1.0]), "s", len(spans)))
        both = list(zip(rows, spans))
        rnd.shuffle(both)
        rows, starts, ends, scores, prios = (np.array(c) for c in zip(*[(r, s[0], s[1], s[4], s[6]) for r, s in both]))
        got = [both[k] for k in SP.kept_by_fold(rows, starts, ends, scores, prios)]
        assert got == [(r, s) for r in range(60) for s in folded([s for q, s in both if q == r])]
    nothing = np.zeros(0, np.int64)
    assert not len(SP.kept_by_fold(nothing, nothing, nothing, nothing, nothing))


def test_batch_is_resolved_as_columns():
    """Before, filters and fold were called once per text, over a tuple for each span."""
    gazetteer = D.Gazetteer(ENTRIES)
    texts = [t for t in TEXTS for _ in range(3)]
    whole, single = D.Texts(D.pa.array(texts)), []
    H.layers_finder(H.ALL_LAYERS, lambda: gazetteer.find, H.resolve)()(whole)
    for text in texts:
        batch = D.Texts(D.pa.array([text], D.pa.string()))
        H.layers_finder(H.ALL_LAYERS, lambda: gazetteer.find)()(batch)
        single.append(folded([s for s, keep in zip(batch.spans[0], H.keeps(batch).tolist()) if keep]))
    assert whole.spans == single and isinstance(whole.found.starts, np.ndarray)
    types = [[s[2] for s in found] for found in whole.spans[::3]]
    assert types == [["PERSON", "EMAIL", "SSN"], [], [], ["DATE_OF_BIRTH", "CREDIT_CARD"], ["PERSON", "IP_ADDRESS"], ["PERSON", "PERSON", "PERSON"], ["PHONE"],
                     ["CREDIT_CARD"], ["EMAIL"] * 40, ["SSN", "DATE_OF_BIRTH", "CREDIT_CARD"]], types
    assert [c.type for c in whole.columns()] == [c.type for c in D.Texts(D.pa.array([""])).columns()]


def test_luhn_of_many_texts():
    rnd = random.Random(3)
    texts = ["", "4111111111111111", "4111111111111112", "4111 1111 1111 1111", "35٣٠١١١٣٣٣٠٠٠٠٠٦", "0" * 12, "0" * 13, "²" * 13]
    texts += ["".join(rnd.choice("0123456789") for _ in range(rnd.randrange(20))) for _ in range(400)]
    assert luhn_passing(texts).tolist() == [luhn_passes(t) for t in texts] and any(luhn_passing(texts)) and not len(luhn_passing([]))


def test_literal_queries_detect_once(spark):
    """Before, pairs were made twice: for all documents, and once more for the blocks of long ones."""
    from shroud.plans.queries import QUERIES

    for name in ("leak_audit", "replacement_hits", "replace_first", "redact_literal"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1, name


def test_evaluation_detects_once(spark):
    """Before, the plan of the metrics held the detectors twice: for the types and for the AGGREGATE row."""
    from shroud.operators.evaluate import eval_metrics
    from shroud.plans.queries import QUERIES

    for name in ("eval_metrics", "eval_annotated", "eval_report"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1, name
    kind = "doc_id long, segment_index int, start int, end int, entity_type string, text string"
    none = spark.createDataFrame([], kind)
    assert [tuple(r)[:4] for r in eval_metrics(none, none).collect()] == [("AGGREGATE", None, None, None)]
    odd = spark.createDataFrame([(0, 0, 0, 3, "AGGREGATE", "Ann"), (0, 0, 4, 6, None, "Bo")], kind)
    got = sorted((tuple(r)[:4] for r in eval_metrics(odd, odd).collect()), key=str)
    assert got == sorted([("AGGREGATE", 1, 0, 0), (None, 0, 1, 1), ("AGGREGATE", 1, 1, 1)], key=str)


def test_values_of_a_column_are_those_of_to_pylist():
    from shroud.functions.text import values_of

    columns = [D.pa.array(["a", None, "é", ""]), D.pa.array(["x"], D.pa.large_string()), D.pa.array([1, 2**60 + 1]), D.pa.array([2**60 + 1, None]), D.pa.array([True, None]),
               D.pa.array([], D.pa.int32()), D.pa.array([0.5, None]), D.pa.array(["p", "q", None, "r"]).slice(1, 2)]
    for column in columns:
        got = values_of(column)
        assert got == column.to_pylist() and [type(v) for v in got] == [type(v) for v in column.to_pylist()]


def test_a_value_that_recurs_is_judged_once():
    """Before, every span's text was stripped and lowered by itself."""
    judged = []

    class Text(str):
        def strip(self):
            judged.append(str(self))
            return str(self).strip()

    texts = D.Texts(D.pa.array(["x"] * 6))
    words = [Text(w) for w in ["the Company", "Ann", " QX ", "the Company", "1980", " QX "]]
    kinds = [texts.kind(*k) for k in (("ORG", "gazetteer", 11), ("PERSON", "gazetteer", 10), ("DATE_OF_BIRTH", "scored", 25), ("EMAIL", "regex", 0))]
    texts.add(range(6), [0] * 6, [1] * 6, words, [kinds[0], kinds[1], kinds[1], kinds[0], kinds[2], kinds[3]], 1.0)
    assert H.keeps(texts).tolist() == [False, True, False, False, False, True] and len(judged) == 4
