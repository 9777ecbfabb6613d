"""Operator 7: deletion of line blocks that an earlier document holds already, by pairwise alignment.

Documents are ordered by (id, row key), null ids first.  Pairs are made by the least runs of consecutive lines that
are large enough to delete, from each line on and up to each line: every line of a common block lies in such a run
inside the block.  A run that stands in several documents pairs each of them with the earliest of these, which holds
the run whole; a run in m documents makes m - 1 pairs and no run is too common to count; how rare a pair's rarest run
is orders a document's partners, rarest first.  Each pair is aligned by patience diff on line hashes: lines that are unique in both documents are anchors, the longest increasing run of them is kept, and the gaps
between are aligned in the same way.  Runs of aligned lines with at least ``MIN_CHARS`` characters or ``MIN_LINES``
lines that are not blank are deleted from the later document.  What the alignment leaves (gaps without anchors, blocks
that stand twice or in another order) is compared run by run, so a line goes exactly if it lies in such a run that
an earlier document holds anywhere.  Documents whose lines are all equal (copies) are one
class from the start: only its first member is aligned, the others lose every block of that size.

Nulls count as empty texts.  Rows are named by 128 bits of their values: equal rows (same id, same text) count as one
document and get the same result.  Only hashes of runs and lines, and lengths of lines, are shuffled for pairs; texts move once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import ROWS_AT_ONCE
from .common import free_names, own_exchange, row_key, stored

MIN_CHARS, MIN_LINES = 100, 3
BLANK = 0  # hash of lines without a visible character
BLANK_IN_RUN = np.uint64(0xD6E8FEB86659FD93)  # stands for it in the hash of a run
BASE = 0x9E3779B97F4A7C15  # of the polynomial hash of a run, odd


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two lists of line hashes, increasing in both."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, at, to = todo.pop()
        while lo < hi and at < to and a[lo] == b[at]:
            out.append((lo, at))
            lo, at = lo + 1, at + 1
        while lo < hi and at < to and a[hi - 1] == b[to - 1]:
            hi, to = hi - 1, to - 1
            out.append((hi, to))
        if lo >= hi or at >= to:
            continue
        left, right = Counter(a[lo:hi]), Counter(b[at:to])
        where = {x: k for k, x in enumerate(b[at:to], at) if right[x] == 1 and left[x] == 1 and x != BLANK}
        anchors = _longest_increasing([(k, where[x]) for k, x in enumerate(a[lo:hi], lo) if x in where])
        if not anchors:
            continue  # common_runs() finds what such a gap holds
        edges = [(lo - 1, at - 1), *anchors, (hi, to)]
        out.extend(anchors)
        todo.extend((i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]))
    return sorted(out)


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Patience sorting: piles with back references."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            ends.append(k)
        else:
            tops[pile], ends[pile] = y, k
    out = []
    k = ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common_blocks(earlier: list[int], later: list[int], sizes: list[int]) -> list[int]:
    """Lines of ``later`` in common blocks that are large enough to delete: aligned ones, then any that are left."""
    gone: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for pair in [*patience(earlier, later), (-9, -9)]:
        if pair != (last[0] + 1, last[1] + 1):
            if large_enough([later[k] for k in block], [sizes[k] for k in block]):
                gone.extend(block)
            block = []
        block.append(pair[1])
        last = pair
    left = set(range(len(later))).difference(gone)
    if not set(earlier).isdisjoint(later[k] for k in left):
        gone = sorted({*gone, *common_runs(earlier, later, sizes)})
    return gone


def common_runs(earlier: list[int], later: list[int], sizes: list[int]) -> list[int]:
    """Lines of ``later`` in runs that are large enough to delete and stand in ``earlier``, at whatever place and as
    often as they may.  Linear: such a run is made of least runs."""
    size = dict(zip(later, sizes))
    a, b = np.array(earlier, np.int64), np.array(later, np.int64)
    _, start, stop = least_runs(a, np.array([size.get(h, 0) for h in earlier], np.int64), np.array([len(a)]))
    held = run_hashes(a, start, stop)
    _, start, stop = least_runs(b, np.array(sizes, np.int64), np.array([len(b)]))
    found = np.isin(run_hashes(b, start, stop), held)
    depth = np.bincount(start[found], minlength=len(b) + 1) - np.bincount(stop[found], minlength=len(b) + 1)
    return np.flatnonzero(np.cumsum(depth)[:-1] > 0).tolist()


def large_enough(hashes: list[int], sizes: list[int]) -> bool:
    seen = [n for h, n in zip(hashes, sizes) if h != BLANK]
    return bool(seen) and (len(seen) >= MIN_LINES or sum(seen) >= MIN_CHARS)


def least_runs(hashes: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, stop) of the least runs of lines that are large enough, from each line on and up to each
    line, blank ones too.  The documents' lines stand one after the other and end at ``ends``."""
    n = len(hashes)
    document = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    begins = np.r_[0, ends][document]
    seen = hashes != BLANK
    lines = np.r_[0, np.cumsum(seen, dtype=np.int64)]
    chars = np.r_[0, np.cumsum(np.where(seen, sizes, 0), dtype=np.int64)]
    at = np.arange(n)
    stop = np.minimum(np.searchsorted(lines, lines[:-1] + MIN_LINES), np.searchsorted(chars, chars[:-1] + MIN_CHARS))
    on = stop <= ends[document]
    start = np.maximum(np.searchsorted(lines, lines[1:] - MIN_LINES, "right"), np.searchsorted(chars, chars[1:] - MIN_CHARS, "right")) - 1
    upto = start >= begins
    start, stop, document = np.r_[at[on], start[upto]], np.r_[stop[on], at[upto] + 1], np.r_[document[on], document[upto]]
    once = np.unique(start * (n + 1) + stop, return_index=True)[1]
    return document[once], start[once], stop[once]


def run_hashes(hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64 bits of each run's line hashes in their order, the same wherever the run stands."""
    power = lambda base: np.cumprod(np.r_[np.uint64(1), np.full(len(hashes), base, np.uint64)])
    line = np.where(hashes == BLANK, BLANK_IN_RUN, hashes.view(np.uint64))
    total = np.r_[np.uint64(0), np.cumsum(line * power(BASE)[:-1])]
    return ((total[stop] - total[start]) * power(pow(BASE, -1, 1 << 64))[start]).view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lines`` and ``sizes`` become ``runs``: the distinct hashes of the least runs of each document."""
    for batch in batches:
        names = [x for x in batch.schema.names if x not in ("lines", "sizes")]
        lines, sizes = batch.column("lines"), batch.column("sizes")
        hashes = lines.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(lines.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        document, start, stop = least_runs(hashes, sizes.flatten().to_numpy(zero_copy_only=False), ends)
        h = run_hashes(hashes, start, stop)
        order = np.lexsort((h, document))
        document, h = document[order], h[order]
        first = np.r_[True, (document[1:] != document[:-1]) | (h[1:] != h[:-1])][:len(h)]
        offsets = np.searchsorted(document[first], np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[first]))],
                                         [*names, "runs"])


def line_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(ord, s1, s2, lines, sizes): place in the order of documents, hash of all lines, hash and length of each."""
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    lines = F.split(F.coalesce(text_col, F.lit("")), "\n")
    white = " \t\x0b\x0c\r"
    hashed = F.transform("raw", lambda x: F.when(F.length(F.translate(x, white, "")) == 0, F.lit(BLANK).cast("long")).otherwise(F.xxhash64(x)))
    return df.select(F.struct(F.col(id_col).alias("id"), k1, k2).alias("ord"), lines.alias("raw")).select(
        "ord", F.xxhash64("raw").alias("s1"), F.xxhash64(F.lit("s2"), "raw").alias("s2"),
        hashed.alias("lines"), F.transform("raw", lambda x: F.length(x)).alias("sizes"))


def deleted_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, gone): numbers of the lines to delete, for every document that loses any."""
    table = stored(line_table(df, id_col, text_col).dropDuplicates(["ord"]))
    firsts = table.groupBy("s1", "s2").agg(F.min("ord").alias("first"), F.count("*").alias("copies"))
    classed = stored(table.join(own_exchange(firsts, "s1", "s2"), ["s1", "s2"]))
    own = classed.where("ord = first").select("ord", "lines", "sizes")
    kind = own.schema["ord"].dataType.simpleString()
    posted = own.mapInArrow(_runs, f"ord {kind}, runs array<long>").select("ord", F.explode("runs").alias("h"))
    shared = posted.groupBy("h").agg(F.count("*").alias("documents"), F.min("ord").alias("partner")).where("documents > 1")
    pairs = posted.join(own_exchange(shared, "h"), "h").where("partner < ord").groupBy("ord", "partner").agg(F.min("documents").alias("rarest"))
    sides = pairs.join(own.select(F.col("ord").alias("partner"), F.col("lines").alias("earlier")), "partner").join(own, "ord")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [common_blocks(a, b, n) for a, b, n in zip(*(batch.column(k).to_pylist() for k in ("earlier", "lines", "sizes")))]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), batch.column("rarest"), pa.array(gone, pa.list_(pa.int32()))],
                                             ["k1", "k2", "rarest", "gone"])

    aligned = sides.select("ord.k1", "ord.k2", "rarest", "earlier", "lines", "sizes").mapInArrow(
        align, "k1 long, k2 long, rarest long, gone array<int>").where(F.size("gone") > 0)
    aligned = aligned.groupBy("k1", "k2").agg(  # bounded by the lines of one document
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rarest", "gone"))), lambda x: x["gone"]))).alias("gone"))
    seen = F.filter(F.zip_with("lines", "sizes", lambda h, n: F.when(h != BLANK, n)), lambda n: n.isNotNull())
    big = (F.size(seen) >= MIN_LINES) | (F.aggregate(seen, F.lit(0), lambda a, n: a + n) >= MIN_CHARS)
    copies = classed.where("ord > first").where(big).select(
        "ord.k1", "ord.k2", F.sequence(F.lit(0), F.size("lines") - 1).alias("gone"))
    return aligned.unionByName(copies)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("__lines", "__deleted")) -> DataFrame:
    """All columns of ``df``, the text without its deleted lines, and as ``counts`` (names that ``df`` must not have) how many lines
    it had and lost.  Texts that lose nothing stay as they are, nulls too; an empty table gives an empty one."""
    h1, h2, lost_lines = free_names(df, "__k1", "__k2", "__gone")
    gone = deleted_lines(df, id_col, text_col).select(F.col("k1").alias(h1), F.col("k2").alias(h2), F.col("gone").alias(lost_lines))
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    joined = df.withColumns({h1: k1, h2: k2}).join(gone, [h1, h2], "left").drop(h1, h2)
    own = df.columns
    names, place = [*own, *counts], own.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                texts, lines, deleted = [], [], []
                for text, lost in zip(rows.column(text_col).to_pylist(), rows.column(lost_lines).to_pylist()):
                    lines.append((text or "").count("\n") + 1)
                    deleted.append(len(lost or ()))
                    if lost:
                        drop = set(lost)
                        text = "\n".join([x for k, x in enumerate(text.split("\n")) if k not in drop])
                    texts.append(text)
                columns = [rows.column(k) for k in own]
                columns[place] = pa.array(texts, columns[place].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(deleted, pa.int64())], names)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in df.columns) + "".join(f", `{c}` long" for c in counts)
    return joined.mapInArrow(run, schema)


def line_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_deleted, kept_sha256) of every row."""
    return dedup_lines(df.select(id_col, text_col), id_col, text_col).select(
        id_col, F.col("__lines").alias("n_lines"), F.col("__deleted").alias("n_deleted"),
        F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("kept_sha256"))
