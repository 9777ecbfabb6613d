"""Span arrays: the per-segment representation of detections, and overlap resolution.

A span is ``struct<start:int, end:int, entity_type:string, text:string,
score:double, source:string, prio:int>``; ``prio`` is the global tie order
(regex patterns 0..5, gazetteer labels 10.., scored recognisers 20..), which
reproduces the layer-then-pattern order a stable sort would keep.

Builders return Spark SQL expression text (see ``shroud.functions.text``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from shroud.functions.text import blocked_sql

SPAN_FIELDS = "start:int,end:int,entity_type:string,text:string,score:double,source:string,prio:int"
SPAN_TYPE = f"struct<{SPAN_FIELDS}>"
SPANS_TYPE = f"array<{SPAN_TYPE}>"
EMPTY_SPANS = f"cast(array() as {SPANS_TYPE})"


def empty_spans() -> Column:
    return F.expr(EMPTY_SPANS)


def span_sql(start: str, end: str, etype: str, text: str, score: str, source: str, prio: str) -> str:
    return (f"named_struct('start', cast({start} as int), 'end', cast({end} as int), 'entity_type', {etype}, "
            f"'text', {text}, 'score', cast({score} as double), 'source', {source}, 'prio', cast({prio} as int))")


def to_spans_sql(located: str, etype_sql: str, score_sql: str, source: str, prio: int, v: str = "ts") -> str:
    """``array<struct<start,end,text>>`` -> span structs; ``score_sql`` may refer to
    ``{v}.start`` / ``{v}.end`` / ``{v}.text`` of the located match."""
    return (f"transform({located}, {v} -> "
            f"{span_sql(f'{v}.start', f'{v}.`end`', etype_sql, f'{v}.text', score_sql, repr(source), str(prio))})")


def sort_spans_sql(spans: str, v: str = "ss") -> str:
    """Order by (start, -length, -score, prio) without a comparator lambda:
    the key is the leading fields of a wrapper struct."""
    keyed = (f"transform({spans}, {v} -> named_struct('k_start', {v}.start, 'k_neglen', {v}.start - {v}.`end`, "
             f"'k_negscore', -{v}.score, 'k_prio', {v}.prio, 's', {v}))")
    return f"transform(array_sort({keyed}), {v}k -> {v}k.s)"


def resolve_overlaps_sql(spans: str, v: str = "ro") -> str:
    """Left-to-right fold over the sorted spans, comparing only with the last kept one.

    An overlapping candidate replaces the last kept span when it is longer, or as long with a higher score; a disjoint
    candidate makes the last kept span final.  Chains included: A<B<C keeps C even though A and C are disjoint.  The
    fold carries the last kept span (as an array of at most one) and collects final ones block by block.
    """
    acc, c, last = f"{v}a", f"{v}c", f"{v}a.last"
    one = f"element_at({last}, 1)"
    overlaps = f"({c}.start < {one}.`end` AND {one}.start < {c}.`end`)"
    clen, llen = f"({c}.`end` - {c}.start)", f"({one}.`end` - {one}.start)"
    better = f"({clen} > {llen} OR ({clen} = {llen} AND {c}.score > {one}.score))"
    kept = f"CASE WHEN size({last}) > 0 AND {overlaps} AND NOT {better} THEN {last} ELSE array({c}) END"
    final = f"CASE WHEN size({last}) > 0 AND NOT {overlaps} THEN concat({acc}.done, {last}) ELSE {acc}.done END"
    step = f"({acc}, {c}) -> named_struct('last', {kept}, 'done', {final})"
    inner = f"aggregate({v}k, named_struct('last', {v}o.last, 'done', {EMPTY_SPANS}), {step})"
    block = (f"({v}o, {v}k) -> aggregate(array({inner}), named_struct('last', {v}o.last, 'done', {v}o.done), "
             f"({v}p, {v}q) -> named_struct('last', {v}q.last, 'done', concat({v}p.done, array({v}q.done))))")
    zero = f"named_struct('last', {EMPTY_SPANS}, 'done', cast(array() as array<{SPANS_TYPE}>))"
    blocks = blocked_sql(sort_spans_sql(spans, v + "s"), v)
    return f"aggregate({blocks}, {zero}, {block}, {v}e -> concat(flatten({v}e.done), {v}e.last))"


def resolve_overlaps(spans: str) -> Column:
    return F.expr(resolve_overlaps_sql(spans))


Span = tuple[int, int, str, str, float, str, int]  # the fields of a span struct, as the finders in tasks have them


def kept_by_fold(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, scores: np.ndarray, prios: np.ndarray) -> np.ndarray:
    """``resolve_overlaps_sql`` for the spans of many segments (``rows``) in a task: places of the kept ones, segment after segment.

    A span that begins where all before it in its segment have ended begins a group; the fold of a group knows nothing of the
    others, so the groups' second spans are taken all at once, then the third ones, and so on.
    """
    if not len(rows):
        return np.zeros(0, np.int64)
    order = np.lexsort((prios, -scores, starts - ends, starts, rows))
    rows, starts, ends, scores = (c[order] for c in (rows, starts, ends, scores))
    apart = rows * (int(ends.max()) + 1)  # no segment reaches into the next
    first = np.flatnonzero(np.append(True, (starts + apart)[1:] >= np.maximum.accumulate(ends + apart)[:-1]))
    sizes = np.diff(first, append=len(rows))
    largest = np.argsort(-sizes, kind="stable")
    first, sizes = first[largest], sizes[largest]
    last, final = first.copy(), np.zeros(len(rows), bool)
    for k in range(1, int(sizes[0])):
        n = int(np.searchsorted(-sizes, -k))  # groups of more than k spans
        kept, new = last[:n], first[:n] + k
        overlaps = (starts[new] < ends[kept]) & (starts[kept] < ends[new])
        longer = (ends[new] - starts[new]) - (ends[kept] - starts[kept])
        better = (longer > 0) | (longer == 0) & (scores[new] > scores[kept])
        final[kept[~overlaps]] = True
        last[:n] = np.where(overlaps & ~better, kept, new)
    final[last] = True
    return order[final]
