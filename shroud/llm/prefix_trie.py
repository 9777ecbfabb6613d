"""Operator 12: the trie of conversation prefixes, from range minima over sorted common prefix lengths.

A conversation becomes one binary key: 16 digest bytes a turn, in order.  Sorted by key (then id), conversations that
share a prefix are neighbours, shorter ones first.  Spark sorts them (range partitions, split by id within equal keys,
so a group of copies does not stay in one) and deals them by position to blocks of ``BLOCK``, each with one
neighbour row on either side.  In a block:

* the common prefix length of every two neighbours, in turns;
* a sparse table of their range minima;
* every candidate prefix (row, depth) searches its left and its right extent by itself, by halving steps through that
  table: a stretch can be skipped if its minimum is no less than the depth.  No stack, no order among candidates;
* everything a node reports is a sum over its interval: leaves are rows longer than what they share with the next one, and
  a row saves the bytes of the turns that it shares with the row before it, less those above the node.

A node whose interval ends inside the block is whole.  The others (prefixes of a block's first or last row: at most two
a depth) leave as parts, which one aggregation by prefix digest adds up; ids of conversations that end there leave in
small chunks that are hashed in order, one at a time.  A whole node with a parted parent gets the parent's id by a join
on the digest, salted because the root may be the parent of most nodes.

Texts are digested where they are read and never shuffled.  A conversation travels as 36 bytes a turn; it is the one
unit that is held whole.  Nothing is collected but the row counts of the range partitions.

Defined results: rows without conversation id take no part.  Null turns come first, equal turns in order of their digest.
Null role or text is empty.  Repeated rows are turns of their own.  An empty table has no nodes.  Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

DIGEST = 16  # bytes a turn
BLOCK = 1024  # conversations
CHUNK = 512  # ids in a chunk of a parted node's ends
SALTS = 32
GROUP, MOST_BORROWED = 5, 9  # conversations that share a source, and how many of its turns (fewer than this) they take

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PART = "prefix binary, parent binary, block long, chunk long, ends binary"


def sequences(df: DataFrame) -> DataFrame:
    """(base, conv_id, digests array<string>, sizes array<long>): the turns of every conversation in order.  Partitioned by
    ``base``, the conversation that the group of five takes turns from."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    conv = F.col("conv_id").cast("long")
    turns = df.where(F.col("conv_id").isNotNull()).select(
        (conv - conv % GROUP).alias("base"), conv.alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("turn"))
    whole = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return whole.select("base", "conv_id", F.col("turns.digest").alias("digests"), F.col("turns.size").alias("sizes"))


def rebuilt(df: DataFrame) -> DataFrame:
    """(conv_id, key, sizes): the first h turns of the group's base conversation, then the own turns after the first h."""
    first = "element_at(collect_list(IF(conv_id = base, {0}, NULL)) OVER (PARTITION BY base), 1)"
    h = (F.crc32(F.col("conv_id").cast("string")) % MOST_BORROWED).cast("int")
    given = sequences(df).selectExpr("*", f"try_{first.format('digests')} AS base_digests", f"try_{first.format('sizes')} AS base_sizes")

    def spliced(own: str, taken: str, kind: str) -> Column:
        nothing = F.array().cast(f"array<{kind}>")
        rest = F.when(F.size(own) > h, F.slice(own, h + 1, F.greatest(F.size(own), F.lit(1)))).otherwise(nothing)
        return F.concat(F.coalesce(F.slice(taken, F.lit(1), h), nothing), rest)

    return given.select("conv_id", F.unhex(F.array_join(spliced("digests", "base_digests", "string"), "")).alias("key"),
                        spliced("sizes", "base_sizes", "long").alias("sizes"))


def in_blocks(sequences: DataFrame, size: int = BLOCK) -> DataFrame:
    """Rows sorted by key and numbered, each in its block of ``size``, and block edges once more in the block next door."""
    sorted_ = stored(sequences.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
                     .withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    counts = sorted_.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row a partition
    ends = np.cumsum([r["count"] for r in counts]).tolist()
    offsets = sequences.sparkSession.createDataFrame(
        [(r["part"], e - r["count"]) for r, e in zip(counts, ends)], "part long, before long")
    at = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)
    numbered = sorted_.withColumn("part", part).join(F.broadcast(offsets), "part").select(at.alias("at"), "conv_id", "key", "sizes")
    block = F.floor(F.col("at") / size)
    return numbered.select(F.explode(F.array_distinct(F.array(
        block, F.floor((F.col("at") + 1) / size), F.floor(F.greatest(F.col("at") - 1, F.lit(0)) / size)))).alias("block"), "at", "conv_id", "key", "sizes")


class RangeMinimum:
    """Sparse table: ``rows[k][i]`` is the minimum of the 2^k values from i."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of values[first..last] for each pair."""
        level = np.frexp((last - first + 1).astype(float))[1] - 1
        out = np.empty(len(first), self.rows[0].dtype)
        for k in np.unique(level):
            here = level == k
            row = self.rows[k]
            out[here] = np.minimum(row[first[here]], row[last[here] - (1 << int(k)) + 1])
        return out

    def reach_right(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last place such that all values after ``start`` up to it are at least ``depth``."""
        at, n = start.copy(), len(self.rows[0])
        for k in range(len(self.rows) - 1, -1, -1):
            fits = np.flatnonzero(at + (1 << k) < n)
            go = fits[self.rows[k][at[fits] + 1] >= depth[fits]]
            at[go] += 1 << k
        return at

    def reach_left(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first place such that all values after it up to ``start`` are at least ``depth``."""
        at = start.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            fits = np.flatnonzero(at - (1 << k) >= 0)
            go = fits[self.rows[k][at[fits] - (1 << k) + 1] >= depth[fits]]
            at[go] -= 1 << k
        return at


def common_turns(a: bytes, b: bytes) -> int:
    """Number of leading digests that two keys share."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)) if a[:n] != b[:n] else ()
    return (int(differ[0]) if len(differ) else n) // DIGEST


def prefix_digests(key: bytes) -> list[bytes]:
    """What names each prefix of a key, from none of its turns to all."""
    state = hashlib.sha256()
    names = [state.digest()]
    for at in range(0, len(key), DIGEST):
        state.update(key[at:at + DIGEST])
        names.append(state.digest())
    return names


def block_nodes(block: int, size: int, at: np.ndarray, ids: np.ndarray, keys: list[bytes], sizes: list[list[int]]) -> tuple[list, list]:
    """(whole nodes, parts of nodes) of one block, from its rows in order with their neighbours outside."""
    inside = np.flatnonzero(at // size == block)
    if not len(inside):
        return [], []
    lo, hi = int(inside[0]), int(inside[-1])
    shared = [common_turns(keys[i - 1], keys[i]) if i else -1 for i in range(len(keys))] + [-1]  # -1: nothing before or after
    left_edge, right_edge = shared[lo], shared[hi + 1]
    lcp = np.array(shared[lo:hi + 1], np.int64)
    following = np.array(shared[lo + 1:hi + 2], np.int64)
    ids, keys, sizes = ids[lo:hi + 1], keys[lo:hi + 1], sizes[lo:hi + 1]
    n = len(ids)
    length = np.array([len(k) // DIGEST for k in keys], np.int64)
    bytes_to = [np.concatenate([[0], np.cumsum(s)]).astype(np.int64) for s in sizes]
    before = np.concatenate([[0], np.cumsum([c[max(0, p)] for c, p in zip(bytes_to, lcp)])])  # bytes shared with the row before, summed
    leaves = np.concatenate([[0], np.cumsum(following < length)])

    # candidates: prefixes that no earlier row of the block has
    fresh = lcp + 1
    fresh[0] = 0
    number = np.maximum(0, length - fresh + 1)
    row = np.repeat(np.arange(n), number)
    depth = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number) + fresh[row]

    table, least_id = RangeMinimum(lcp), RangeMinimum(ids)
    left, right = table.reach_left(row, depth), table.reach_right(row, depth)
    parted = ((left == 0) & (depth <= left_edge)) | ((right == n - 1) & (depth <= right_edge))
    up_left, up_right = table.reach_left(row, depth - 1), table.reach_right(row, depth - 1)
    up_parted = ((up_left == 0) & (depth - 1 <= left_edge)) | ((up_right == n - 1) & (depth - 1 <= right_edge))

    # children: every candidate of the next depth that is new in the corpus, by the node (left end, depth) it hangs on
    new = (row > 0) | (depth > left_edge)
    wide = int(depth.max(initial=0)) + 2
    hangs, times = np.unique((up_left * wide + depth - 1)[new & (depth > 0)], return_counts=True)
    place = np.searchsorted(hangs, left * wide + depth)
    children = np.zeros(len(row), np.int64)
    found = np.flatnonzero(place < len(hangs))
    found = found[hangs[place[found]] == (left * wide + depth)[found]]
    children[found] = times[place[found]]

    above = np.array([bytes_to[r][max(0, d - 1)] for r, d in zip(row.tolist(), depth.tolist())], np.int64)
    opens = lcp[left] < depth  # the node's first row is in this block: it saves nothing
    saved = before[right + 1] - before[left] - np.where(opens, before[left + 1] - before[left], 0) - (right - left + 1 - opens) * above
    some_id = least_id.least(left, right)
    up_id = np.where(depth > 0, least_id.least(up_left, up_right), 0)
    n_leaves = leaves[right + 1] - leaves[left]
    first_names, last_names = prefix_digests(keys[0]), prefix_digests(keys[-1])
    ended = np.flatnonzero(length[row] == depth)  # only these can have members that end here: the shortest come first
    n_ended = np.zeros(len(row), np.int64)
    run_end = np.append(np.flatnonzero((lcp[1:] != length[1:]) | (length[1:] != length[:-1])), n - 1)
    n_ended[ended] = run_end[np.searchsorted(run_end, row[ended])] - row[ended] + 1

    whole, parts = [], []
    nothing = hashlib.sha256(b"").hexdigest()
    for k in range(len(row)):
        i, d, l, r, e = int(row[k]), int(depth[k]), int(left[k]), int(right[k]), int(n_ended[k])
        figures = (int(some_id[k]), d, r - l + 1, int(children[k]), int(n_leaves[k]), int(saved[k]))
        up = (first_names if up_left[k] == 0 and d - 1 <= left_edge else last_names)[d - 1] if d and up_parted[k] else None
        if parted[k]:
            name = (first_names if l == 0 and d <= left_edge else last_names)[d]
            chunks = [",".join(map(str, ids[j:min(j + CHUNK, i + e)].tolist())).encode() for j in range(i, i + e, CHUNK)] or [b""]
            for c, ends in enumerate(chunks):
                parts.append((*(figures if c == 0 else (figures[0], d, 0, 0, 0, 0)), name, up, block, c, ends))
        else:
            ends = hashlib.sha256(",".join(map(str, ids[i:i + e].tolist())).encode()).hexdigest() if e else nothing
            parent = int(up_id[k]) if d and up is None else None
            whole.append((*figures, parent, ends, up))
    return whole, parts


FIGURES = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"
FOUND = f"{FIGURES}, parent_conv_id long, ends_sha256 string, {PART}"
NAMES = [c.split()[0] for c in FOUND.split(", ")]
KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _nodes(size: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        whole, parts = block_nodes(key[0].as_py(), size, rows.column("at").to_numpy(), rows.column("conv_id").to_numpy(),
                                   rows.column("key").to_pylist(), rows.column("sizes").to_pylist())
        both = [(*w[:8], None, w[8], None, None, None) for w in whole] + [(*p[:6], None, None, *p[6:]) for p in parts]
        columns = list(zip(*both)) or [()] * len(NAMES)
        return pa.table([pa.array(c, KINDS[f.split()[1]]) for c, f in zip(columns, FOUND.split(", "))], names=NAMES)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per prefix over its chunks, which come in order; one chunk is held at a time."""
    last, state = None, None
    done: list[tuple[bytes, str]] = []
    for batch in batches:
        for name, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != last:
                if last is not None:
                    done.append((last, state.hexdigest()))
                last, state = name, hashlib.sha256(ends)
            else:
                state.update(b"," + ends)
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], ["name", "sha"])
        done = []
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["name", "sha"])


def trie(sequences: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per node of the trie of ``sequences`` (conv_id, key, sizes), ``size`` conversations a block."""
    found = stored(in_blocks(sequences, size).groupBy("block").applyInArrow(_nodes(size), FOUND))
    whole, parts = found.where(F.col("ends_sha256").isNotNull()), found.where(F.col("ends_sha256").isNull())
    merged = parts.groupBy("prefix").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    chunks = parts.where(F.length("ends") > 0).select("prefix", "ends", "block", "chunk")
    hashes = chunks.repartition("prefix").sortWithinPartitions("prefix", "block", "chunk").select("prefix", "ends").mapInArrow(
        _hashed, "name binary, sha string")
    ended = F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest()))
    merged = stored(merged.join(hashes, F.col("prefix") == F.col("name"), "left").withColumn("ends_sha256", ended).drop("name", "sha"))

    columns = [c.split()[0] for c in NODE.split(", ")]
    figures = [c for c in columns if c != "parent_conv_id"]
    salted = merged.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
                           F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int")
    orphans = whole.where(F.col("parent").isNotNull()).select(*figures, "parent").unionByName(merged.select(*figures, "parent"))
    adopted = orphans.withColumn("salt", salt).join(salted, ["parent", "salt"], "left")
    return whole.where(F.col("parent").isNull()).select(*columns).unionByName(adopted.select(*columns))


def prefix_trie(df: DataFrame, size: int = BLOCK) -> DataFrame:
    """Nodes of the trie over the rebuilt conversations (see ``rebuilt``) of (conv_id, turn, role, text)."""
    return trie(rebuilt(df), size)
