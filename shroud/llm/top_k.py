"""Operator 4: exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are integers (floor of 1024 times a component).  Rows are packed into blocks; every block is indexed by
itself: for each dimension the components are quantised towards zero to ``LEVELS`` levels, and the vectors of one
level of one dimension are a posting segment.  For a query, segments come in descending order of their quantised
impact on the score.  After each round the score so far, and bounds on what the open segments and the lost low bits can
still add or take (by the largest open impacts, and by the length of each vector's untold rest times the query's), prove
which vectors may be among the k best; work stops only when those are a tenth of the block (or no segment is left), and they
are rescored exactly.  The k best of every block meet in one ranking per query.

Each block of vectors meets each block of queries once (queries are a stated set, about a hundredth of the rows).
Vectors that are null or hold a null or non-finite component take no part, nor do rows without id; an empty vector scores
zero with all.  Ids may
be repeated: a query's own row is left out, another row of the same id is not.  Vectors of different lengths are
compared as if the shorter one went on with zeros.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 1024
LEVELS = 128
ROUNDS = 16
BLOCK = 8192  # vectors in a block
QUERIES = 512  # queries in a block
MOST_TASKS = 8192


class Index:
    """Posting segments of one block: for each dimension and quantised level the vectors that have it.  Beside each posting
    stands by how much it lowers the squared length of what the index has not told of its vector yet."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        n, dims = vectors.shape
        top = int(np.abs(vectors).max(initial=0))
        self.shift = max(0, top.bit_length() - (LEVELS - 1).bit_length())
        level = np.sign(vectors) * (np.abs(vectors) >> self.shift)
        told = (vectors.astype(float) ** 2 - (vectors - (level << self.shift)).astype(float) ** 2)
        order = np.argsort(level, axis=0, kind="stable")
        dim, value, first, post, gain = [], [], [], [], []
        at = 0
        for d in range(dims):
            ranked = level[order[:, d], d]
            edge = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
            dim.append(np.full(len(edge), d))
            value.append(ranked[edge])
            first.append(at + edge)
            post.append(order[:, d])
            gain.append(told[order[:, d], d])
            at += n
        self.dim, self.value, self.first = np.concatenate(dim), np.concatenate(value), np.concatenate(first)
        self.post, self.gain = np.concatenate(post), np.concatenate(gain)
        self.count = np.diff(np.append(self.first, at))
        self.begin = np.flatnonzero(np.r_[True, self.dim[1:] != self.dim[:-1]])  # first segment of each dimension
        self.length2 = (vectors.astype(float) ** 2).sum(axis=1)
        self.last: tuple[int, int] = (0, 0)  # rounds and rescored vectors of the last query

    def top(self, query: np.ndarray, k: int, leave: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best vectors (more where scores tie), without place ``leave``."""
        n = len(self.vectors)
        lost = np.abs(query) * ((1 << self.shift) - 1)  # what the low bits of one component can add or take
        impact = query[self.dim] * self.value << self.shift
        order = np.argsort(-np.abs(impact), kind="stable")
        order = order[impact[order] != 0]
        rounds = np.cumsum(self.count[order]) * ROUNDS // max(1, int(self.count[order].sum()) + 1)
        score, untold = np.zeros(n), self.length2.copy()
        open_, low = np.ones(len(impact), bool), lost[self.dim]
        size = float(np.sqrt((query.astype(float) ** 2).sum()))
        few = max(4 * k, n // 10)
        maybe = np.arange(n)
        for r in range(ROUNDS):
            part = order[rounds == r]
            if not len(part):
                continue
            part = np.sort(part)  # segments of one dimension that lie side by side are read as one stretch
            cut = np.flatnonzero(np.diff(part) != 1) + 1
            heads, tails = part[np.append(0, cut)].tolist(), part[np.append(cut - 1, len(part) - 1)].tolist()
            reach = [slice(self.first[a], self.first[b] + self.count[b]) for a, b in zip(heads, tails)]
            post = np.concatenate([self.post[x] for x in reach])
            score += np.bincount(post, np.repeat(impact[part], self.count[part]), n)
            untold -= np.bincount(post, np.concatenate([self.gain[x] for x in reach]), n)
            open_[part] = False
            up = np.maximum.reduceat(np.where(open_ & (impact > 0), impact + low, low), self.begin)
            down = np.maximum.reduceat(np.where(open_ & (impact < 0), low - impact, low), self.begin)
            # two bounds on what is still open: the largest impacts by dimension, and the lengths of the query and of each
            # vector's untold rest (rounded up: lengths are doubles)
            rest = size * np.sqrt(np.maximum(untold, 0)) * (1 + 1e-9) + 1
            floor = score - np.minimum(rest, down.sum())
            if leave >= 0:
                floor[leave] = -np.inf
            least = np.partition(floor, n - min(k, n))[n - min(k, n)]
            maybe = np.flatnonzero(score + np.minimum(rest, up.sum()) >= least)  # proof: all others are below k vectors
            self.last = (r + 1, len(maybe))
            if len(maybe) <= few:
                break
        maybe = maybe[maybe != leave]
        exact = self.vectors[maybe] @ query
        if len(maybe) > k:
            keep = exact >= np.partition(exact, len(maybe) - k)[len(maybe) - k]
            maybe, exact = maybe[keep], exact[keep]
        return maybe, exact


def blocks(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(block, dims, ids, vectors): rows that take part, packed; a block's number and a place name a row."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(at, BLOCK)
                vectors = rows.column(1).to_pylist()
                dims = max(1, *map(len, vectors))
                packed = np.zeros((len(vectors), dims), "<i8")
                for k, v in enumerate(vectors):
                    packed[k, :len(v)] = v
                ids = rows.column(0).to_numpy().astype("<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([dims], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([packed.tobytes()], pa.binary())],
                    ["block", "dims", "ids", "vectors"])
                number += 1

    return whole.mapInArrow(run, "block long, dims long, ids binary, vectors binary")


def query_blocks(packed: DataFrame, every: int) -> DataFrame:
    """Rows whose id is divisible by ``every``, from the packed blocks, with the block and place they came from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, dims, ids, vectors in zip(*(batch.column(k).to_pylist() for k in range(4))):
                ids, vectors = np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<i8").reshape(-1, dims)
                chosen = np.flatnonzero(ids % every == 0)
                for at in range(0, len(chosen), QUERIES):
                    some = chosen[at:at + QUERIES]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int64()), pa.array([dims], pa.int64()), pa.array([some.astype("<i8").tobytes()], pa.binary()),
                         pa.array([ids[some].tobytes()], pa.binary()), pa.array([vectors[some].tobytes()], pa.binary())],
                        ["q_block", "q_dims", "q_places", "q_ids", "q_vectors"])

    return packed.mapInArrow(run, "q_block long, q_dims long, q_places binary, q_ids binary, q_vectors binary")


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, index = None, None
        for batch in batches:
            for r in batch.to_pylist():
                vectors = np.frombuffer(r["vectors"], "<i8").reshape(-1, r["dims"])
                queries = np.frombuffer(r["q_vectors"], "<i8").reshape(-1, r["q_dims"])
                wide = max(r["dims"], r["q_dims"])
                if number != (r["block"], wide):
                    number, index = (r["block"], wide), Index(np.pad(vectors, ((0, 0), (0, wide - r["dims"]))))
                queries = np.pad(queries, ((0, 0), (0, wide - r["q_dims"])))
                ids, q_ids, places = (np.frombuffer(r[c], "<i8") for c in ("ids", "q_ids", "q_places"))
                row, hit, score = [], [], []
                for q in range(len(queries)):
                    at, exact = index.top(queries[q], k, int(places[q]) if r["block"] == r["q_block"] else -1)
                    order = np.lexsort((ids[at], -exact))[:k]
                    row.append(np.full(len(order), q))
                    hit.append(ids[at[order]])
                    score.append(exact[order])
                row = np.concatenate(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), r["q_block"])), pa.array(places[row]), pa.array(q_ids[row]), pa.array(np.concatenate(hit)),
                     pa.array(np.concatenate(score))], ["q_block", "place", "query_id", "vec_id", "score"])

    return run


def top_k(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every query, ties to the smaller id."""
    packed = stored(blocks(df, id_col, vector_col))
    slots = max(1, packed.count())
    asked = query_blocks(packed, every).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    slotted = packed.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int"))
    tasks = min(slots, MOST_TASKS)  # named, so that little bytes with much work are not put together
    met = slotted.repartition(tasks, "slot").join(asked.repartition(tasks, "slot"), "slot").sortWithinPartitions("block")
    found = met.mapInArrow(_search(k), "q_block long, place long, query_id long, vec_id long, score long")
    best = Window.partitionBy("q_block", "place").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
