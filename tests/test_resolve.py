"""Overlap resolution: worked cases and properties; islands are exact."""

import random

from pyspark.sql import functions as F

from shroud.functions.spans import SPANS_TYPE, resolve_overlaps_sql
from shroud.operators.resolve import overlap_pairs, resolve_by_islands, resolve_segment_spans


def random_segments(n, rnd):
    segs = []
    for _ in range(n):
        spans = set()
        for p in range(rnd.randint(0, 12)):
            s = rnd.randint(0, 40)
            spans.add((s, s + rnd.randint(1, 12), rnd.choice([0.85, 1.0, 0.5]), p))
        segs.append(sorted(spans))
    return segs


def span_rows(segs):
    return [(i, 0, s, e, "T", "x", sc, "src", p) for i, seg in enumerate(segs) for s, e, sc, p in seg]


SCHEMA = "doc_id long, segment_index int, start int, end int, entity_type string, text string, score double, source string, prio int"


def test_chain_and_ties(spark):
    rows = [(0, 0, 0, 5, "A", "a", 1.0, "regex", 0), (0, 0, 4, 10, "B", "b", 1.0, "regex", 1),
            (0, 0, 9, 20, "C", "c", 1.0, "regex", 2),
            (1, 0, 0, 6, "EMAIL", "a@b.co", 1.0, "scored", 20), (1, 0, 0, 6, "EMAIL", "a@b.co", 1.0, "regex", 0)]
    got = resolve_segment_spans(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.end) for r in got] == [(0, 9, 20), (1, 0, 6)]
    assert got[1].source == "regex"


# spans of one segment as (start, end, score) in order of priority, and those that stay
CASES = [
    ([], []),
    ([(0, 5, 1.0)], [(0, 5)]),
    ([(0, 5, 1.0), (5, 9, 1.0)], [(0, 5), (5, 9)]),  # touching is not overlapping
    ([(0, 5, 1.0), (3, 6, 1.0)], [(0, 5)]),  # the longer one
    ([(0, 3, 1.0), (2, 9, 0.5)], [(2, 9)]),  # length before score
    ([(0, 4, 0.5), (2, 6, 1.0)], [(2, 6)]),  # as long: the higher score
    ([(0, 4, 1.0), (2, 6, 1.0)], [(0, 4)]),  # as long, as high: the first
    ([(2, 4, 1.0), (0, 9, 1.0)], [(0, 9)]),  # order of arrival does not matter
    ([(0, 5, 1.0), (4, 10, 1.0), (9, 20, 1.0)], [(9, 20)]),  # a chain keeps its last
    ([(0, 10, 1.0), (4, 8, 1.0), (9, 12, 1.0), (11, 30, 1.0)], [(0, 10), (11, 30)]),
]


def case_rows(spans_of):
    return [(k, 0, s, e, "T", "x", sc, "src", p) for k, spans in enumerate(spans_of) for p, (s, e, sc) in enumerate(spans)]


def kept(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    return {k: sorted(v) for k, v in got.items()}


def test_worked_cases(spark):
    df = spark.createDataFrame(case_rows([c for c, _ in CASES]), SCHEMA)
    want = {k: w for k, (_, w) in enumerate(CASES) if w}
    assert kept(resolve_segment_spans(df)) == want == kept(resolve_by_islands(df))


def test_properties(spark):
    rnd = random.Random(11)
    rows = span_rows(random_segments(400, rnd))
    df = spark.createDataFrame(rows, SCHEMA)
    whole = kept(resolve_segment_spans(df))
    assert whole == kept(resolve_by_islands(df))  # islands are independent of one another
    rnd.shuffle(rows)
    assert whole == kept(resolve_segment_spans(spark.createDataFrame(rows, SCHEMA)))  # any order of arrival
    given = {}
    for r in rows:
        given.setdefault(r[0], set()).add((r[2], r[3]))
    assert set(whole) == set(given)
    for k, spans in whole.items():
        assert set(spans) <= given[k] and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_long_segments_cross_blocks(spark):
    spans = [(10 * k, 10 * k + 6, 1.0) for k in range(1000)] + [(10 * k + 5, 10 * k + 12, 1.0) for k in range(0, 1000, 100)]
    df = spark.createDataFrame(case_rows([spans]), SCHEMA)
    got = kept(resolve_segment_spans(df))[0]
    assert len(got) == 990 and all(a[1] <= b[0] for a, b in zip(got, got[1:]))
    assert got == kept(resolve_by_islands(df))[0]


def test_overlap_pairs_matches_brute_force(spark):
    rnd = random.Random(5)
    segs = random_segments(200, rnd)
    df = spark.createDataFrame(span_rows(segs), SCHEMA)
    got = {(r.doc_id, r.a_start, r.a_end, r.b_start, r.b_end) for r in overlap_pairs(df).collect()}
    want = set()
    for i, seg in enumerate(segs):
        for a in seg:
            for b in seg:
                if (a[0], a[1], a[3]) < (b[0], b[1], b[3]) and a[0] < b[1] and b[0] < a[1]:
                    want.add((i, a[0], a[1], b[0], b[1]))
    assert got == want


def test_empty_array(spark):
    df = spark.createDataFrame([(1,)], "x int").select(F.expr(resolve_overlaps_sql(f"cast(array() as {SPANS_TYPE})")).alias("r"))
    assert df.first().r == []


def test_a_segment_of_many_spans_streams_through(spark):
    """Batches smaller than a segment: the last kept span goes from batch to batch."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rnd = random.Random(3)
        rows = span_rows(random_segments(60, rnd)) + [(99, 0, 3 * k, 3 * k + rnd.choice([2, 3, 5, 9]), "T", "x", 1.0, "src", 0) for k in range(5000)]
        df = spark.createDataFrame(rows, SCHEMA)
        by_row = df.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "entity_type", "text", "score", "source", "prio")).alias("s"))
        want = {r.doc_id: [(s.start, s.end) for s in r.s] for r in by_row.select("doc_id", F.expr(resolve_overlaps_sql("s")).alias("s")).collect()}
        assert kept(resolve_segment_spans(df)) == {k: sorted(v) for k, v in want.items()}
        got = {(r.doc_id, r.a_start, r.a_end, r.b_start, r.b_end) for r in overlap_pairs(df.where("doc_id = 99")).collect()}
        spans = sorted({(s, e) for d, _, s, e, *_ in rows if d == 99})
        assert got == {(99, *a, *b) for i, a in enumerate(spans) for b in spans[i + 1:i + 5] if b[0] < a[1]}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_no_segment_is_gathered(spark):
    df = spark.createDataFrame(span_rows(random_segments(5, random.Random(1))), SCHEMA)
    for out in (resolve_segment_spans(df), overlap_pairs(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and plan.count("Exchange") == 1
