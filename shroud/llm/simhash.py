"""Operator 5: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 r`` bits share a variant that differs from each of them in at most ``r``
bits.  So every fingerprint emits all its variants within ``r`` bits (2,081 for r = 2), variants are shuffled, and
fingerprints that meet at a variant are verified and linked.

The shuffle is by a linear bucket of the variant: bit i has a label, and the bucket of a variant is the XOR of the
labels of its bits.  The label of bit i is the unit vector i mod b, so a bucket is b parities and a ball of two bits
reaches 1 + b + b (b - 1) / 2 of the 2^b buckets (56 of 1,024; 211 of 1,048,576).  All variants of one fingerprint that fall
in one bucket are the fingerprint and the flips whose labels XOR to a known value; so one packed entry (bucket, fingerprint)
stands for all of them, and the receiver writes them out.  b grows with the number of distinct fingerprints, one plan at all
sizes: a bucket receives at most about ``BUCKET_ROWS`` of them, and works through its variants in rounds over further label
bits.  Any two fingerprints at one variant are within ``2 r`` bits of each other, so linking all of them to the
least one (and reducing each bucket's links to a spanning forest) keeps the components without emitting all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, islice
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import ROWS_AT_ONCE
from .common import free_names, own_exchange, row_key, stored
from .components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BUCKET_ROWS = 1 << 22  # fingerprints that a bucket receives, at most about
LEAST_BITS = 10  # label bits at the least: 1,024 buckets
ROUND_VARIANTS = 1 << 22  # variants that a bucket holds at once
PACKED = 1 << 16  # fingerprints in one shuffled row
PAIRS = 1 << 24  # pairs of bucket and fingerprint that a sender sorts at once
BLOCK = 1 << 15  # shingles whose bits are counted at once


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint; 0 for a text without words."""
    words = text.encode().lower().split()  # of bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stops = np.cumsum(size) - 1
    starts = stops - size + 1
    data = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = stops[min(shingle, len(words)) - 1:]
    hashes = [xxhash.xxh64_intdigest(data[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends.tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        block = np.array(hashes[at:at + BLOCK], "<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, k1, k2, fp): ``k1, k2`` name the row by its values; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                got = np.array([fingerprint(t or "", shingle) for t in rows.column(3).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(got.view(np.int64))], [id_col, "k1", "k2", "fp"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, *row_key(F.col(id_col), F.col(text_col)), text_col).mapInArrow(
        run, f"`{id_col}` {kind}, k1 long, k2 long, fp long")


class Ball:
    """Flip masks of at most ``radius`` bits, grouped by the XOR of the labels of their bits: ``bits`` parities, above
    them ``more`` drawn bits that split a bucket into rounds."""

    def __init__(self, radius: int, bits: int, more: int = 0) -> None:
        spread = (np.arange(64, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        spread = (spread ^ (spread >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        drawn = (spread >> np.uint64(40)).astype(np.int64) & ((1 << more) - 1)
        self.label = (np.int64(1) << (np.arange(64, dtype=np.int64) % bits)) | (drawn << bits)
        masks, sums = [], []
        for k in range(radius + 1):
            for flips in combinations(range(64), k):
                masks.append(sum(1 << f for f in flips))
                sums.append(int(np.bitwise_xor.reduce(self.label[list(flips)])) if flips else 0)
        order = np.argsort(sums, kind="stable")
        self.masks = np.array(masks, np.uint64)[order]
        self.steps, self.first, self.count = np.unique(np.array(sums)[order], return_index=True, return_counts=True)

    def bucket(self, fp: np.ndarray) -> np.ndarray:
        out = np.zeros(len(fp), np.int64)
        for k in range(64):
            out ^= ((fp >> np.uint64(k)) & np.uint64(1)).astype(np.int64) * self.label[k]
        return out

    def flips(self, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, count): the run of ``masks`` whose labels XOR to each ``step``; empty if none does."""
        at = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
        return self.first[at], np.where(self.steps[at] == step, self.count[at], 0)


@lru_cache(16)
def ball(radius: int, bits: int, more: int = 0) -> Ball:
    return Ball(radius, bits, more)


def reached(radius: int, bits: int) -> int:
    """Buckets that the variants of one fingerprint lie in."""
    return len(ball(radius, bits).steps)


def label_bits(n: int, radius: int) -> int:
    """Label bits for ``n`` distinct fingerprints: the fewest with which a bucket receives ``BUCKET_ROWS`` or less on average."""
    bits = LEAST_BITS
    while bits < 30 and n * reached(radius, bits) > BUCKET_ROWS << bits:
        bits += 1
    return bits


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every node to the least node of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    parent = np.arange(len(nodes))
    while True:
        pa_, pb = parent[a], parent[b]
        if np.array_equal(pa_, pb):
            break
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[parent[child]], nodes[child]


def meet(fp: np.ndarray, radius: int, bits: int, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the fingerprints that meet at a variant of this bucket."""
    variants = len(fp) * sum(comb(64, k) for k in range(radius + 1)) / reached(radius, bits)
    more = 0
    while variants / (1 << more) > ROUND_VARIANTS and more < 12:
        more += 1
    flips = ball(radius, bits, more)
    own = flips.bucket(fp)
    us, vs = [], []
    for sub in range(1 << more):
        first, count = flips.flips(own ^ (bucket | (sub << bits)))
        upto = np.cumsum(count)
        owner = np.repeat(np.arange(len(fp)), count)
        variant = fp[owner] ^ flips.masks[np.arange(len(owner)) + np.repeat(first - (upto - count), count)]
        # sort by the high bits of a mix, with the place in the low bits; then look exactly where high bits agree
        low = np.uint64((1 << max(1, len(owner)).bit_length()) - 1)
        mixed = variant * np.uint64(0x9E3779B97F4A7C15)
        mixed = np.sort((mixed & ~low) | np.arange(len(owner), dtype=np.uint64))
        high = mixed & ~low
        twin = high[1:] == high[:-1]
        near = np.zeros(len(mixed), bool)
        near[1:] |= twin
        near[:-1] |= twin
        place = (mixed[near] & low).astype(np.int64)
        order = np.lexsort((fp[owner[place]], variant[place]))
        place = place[order]
        at, who = variant[place], fp[owner[place]]
        begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        least = np.repeat(who[begins], np.diff(np.append(begins, len(at))))
        link = (who != least) & (np.bitwise_count(who ^ least) <= 2 * radius)
        if link.any():
            u, v = forest(least[link], who[link])
            us.append(u)
            vs.append(v)
    if not us:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate(us), np.concatenate(vs))


def scattered(fp: np.ndarray, own: np.ndarray, steps: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, fingerprints) for every fingerprint in each of the buckets ``own ^ step``; no more than ``PAIRS`` pairs at once."""
    size = max(1, PAIRS // len(steps))
    steps = steps.astype(np.int32)
    for at in range(0, len(fp), size):
        some = fp[at:at + size]
        to = (own[at:at + size].astype(np.int32)[:, None] ^ steps).reshape(-1)
        order = np.argsort(to, kind="stable")
        to = to[order]
        order //= len(steps)  # from places of pairs to places of fingerprints
        bounds = np.append(np.flatnonzero(np.r_[True, to[1:] != to[:-1]]), len(to)).tolist()
        for begin, end in zip(bounds, bounds[1:]):
            yield int(to[begin]), some[order[begin:end]].tobytes()


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v): links that join all distinct fingerprints ``fp`` within ``max_bits`` bits of one another, directly or
    through others."""
    radius = -(-max_bits // 2)
    if 2 * radius != max_bits:
        raise ValueError("max_bits must be even: half of it is the radius of a ball")
    distinct = stored(prints.select("fp").where("fp is not null").distinct())
    bits = label_bits(distinct.count(), radius)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = ball(radius, bits)
        for fp in _gathered(batches):
            rows = scattered(fp, flips.bucket(fp), flips.steps)
            while some := list(islice(rows, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.binary())],
                                                 ["bucket", "packed"])

    def receive(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(np.frombuffer(b"".join(rows["packed"]), np.uint64))
        u, v = meet(fp, radius, bits, int(key[0]))
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    sent = distinct.mapInArrow(send, "bucket long, packed binary")
    return sent.groupBy("bucket").applyInPandas(receive, "u long, v long").distinct()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy().view(np.uint64))
        n += len(held[-1])
        if n >= PACKED:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def groups(prints: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id") -> DataFrame:
    """``prints`` and ``root``: the least fingerprint (as signed long) that the row's own is linked to, itself included."""
    reach = components(links(prints, max_bits)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    return prints.join(reach, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint, component_id) of every row; the component is named by the least id in it (null if it has
    none).  Null and empty texts have fingerprint zero."""
    prints = stored(fingerprints(df, id_col, text_col, shingle))
    rooted = groups(prints, max_bits, id_col)
    least = rooted.groupBy("root").agg(F.min(id_col).alias("component_id"))
    return rooted.join(own_exchange(least, "root"), "root").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group: that of least id, then of least row key; all columns.  An empty table gives an empty one."""
    h1, h2 = free_names(df, "__k1", "__k2")
    prints = stored(fingerprints(df, id_col, text_col, shingle))
    winners = groups(prints, max_bits, id_col).groupBy("root").agg(F.min(F.struct(id_col, "k1", "k2")).alias("w")).select(
        F.col("w.k1").alias(h1), F.col("w.k2").alias(h2))
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    keyed = df.withColumns({h1: k1, h2: k2})
    return keyed.join(winners, [h1, h2], "left_semi").dropDuplicates([h1, h2]).select(*df.columns)
