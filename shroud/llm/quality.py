"""Operator 8: quality rules, and an isolation forest on their statistics.

Every text gets five counts in one pass (row-local).  Two plain rules fail a document outright.  For the others an
isolation forest, fitted on at most ``FIT_ROWS`` labelled rows, gives the mean path length over random splits: the
shorter, the more anomalous.  The threshold is calibrated on all labelled rows that pass the plain rules: of the path
lengths (in ``BINS`` bins) the one with the largest share of bad rows rejected less ``GOOD_WEIGHT`` times the share of
good rows rejected.  There is no limit on good rows lost: more go wherever that rejects 20 times the share of bad ones.

Null or empty texts have no words and fail the base rule.  Ids may be null or repeated; each row is judged by itself.
Several labels of one id count as the worst of them; labels without id or quality are passed over.  Without labelled
rows there is no forest, and only the base rules reject.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import ROWS_AT_ONCE
from .common import stored

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

FIT_ROWS = 4096  # bound of the sample that the forest is fitted on
TREES, TREE_ROWS, SEED = 100, 32, 42  # small samples: in large ones rows that are bad in the same way hide each other
BINS, GOOD_WEIGHT = 2000, 20  # losing one good row in a hundred weighs as much as missing one bad row in five
USUAL_LINES, USUAL_REPEATS = 0.02, 0.25  # repeated lines a word, repeated words a word

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def count_text(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()  # of bytes: splits at ASCII white space, which is the given set
    chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    at = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pair = at[:-1] * len(number) + at[1:]
    if len(number) >= 1 << 20:  # keeps the product of three within 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(number) + at[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(window), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:len(words) - 2 + k] |= again
    return int(covered.sum())


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the five counts, base_failed) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                counts = np.array([count_text(t or "") for t in rows.column(1).to_pylist()], np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c) for c in counts.T)], [id_col, *STATS])

    kind = dict(df.dtypes)[id_col]
    counted = df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in STATS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def features(counts: np.ndarray) -> np.ndarray:
    """Rates that do not depend on a document's length: word length, symbols a word, and what exceeds a usual share
    of repeated lines and words (small shares are no sign of anything and would only blur the splits)."""
    words = np.maximum(counts[:, 0], 1).astype(float)
    return np.stack([counts[:, 1] / words, counts[:, 2] / words, np.maximum(0, counts[:, 3] / words - USUAL_LINES),
                     np.maximum(0, counts[:, 4] / words - USUAL_REPEATS)], axis=1)


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees in arrays: feature (-1: leaf), threshold, left child (the right one follows), path length at a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    path: np.ndarray
    roots: np.ndarray

    @staticmethod
    def fit(rows: np.ndarray, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        depth = int(np.ceil(np.log2(max(2, min(TREE_ROWS, len(rows))))))
        nodes: list[tuple[int, float, int, float]] = []
        roots = []
        for _ in range(TREES):
            sample = rows[rng.permutation(len(rows))[:TREE_ROWS]]
            roots.append(len(nodes))
            nodes.append((-1, 0.0, 0, 0.0))
            queue = [(len(nodes) - 1, sample, 0)]
            for node, part, level in queue:
                low, high = part.min(axis=0), part.max(axis=0)
                open_ = np.flatnonzero(high > low)
                if level >= depth or not len(open_):
                    nodes[node] = (-1, 0.0, 0, level + float(expected_path(len(part))))
                    continue
                f = int(rng.choice(open_))
                at = float(rng.uniform(low[f], high[f]))
                nodes[node] = (f, at, len(nodes), 0.0)
                below = part[:, f] < at
                for side in (part[below], part[~below]):
                    nodes.append((-1, 0.0, 0, level + 1.0))
                    if len(side):
                        queue.append((len(nodes) - 1, side, level + 1))
        f, t, c, p = zip(*nodes)
        return Forest(np.array(f), np.array(t), np.array(c), np.array(p), np.array(roots))

    def paths(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            todo = every
            while len(todo):
                f = self.feature[node[todo]]
                todo, f = todo[f >= 0], f[f >= 0]
                at = node[todo]
                node[todo] = self.child[at] + (rows[todo, f] >= self.threshold[at])
            total += self.path[node]
        return total / len(self.roots)


@dataclass
class Model:
    forest: Forest | None = None
    least_path: float = 0.0

    def verdicts(self, counts: np.ndarray, base_failed: np.ndarray) -> np.ndarray:
        kept = ~base_failed
        if self.forest is not None and kept.any():
            kept[kept] = self.forest.paths(features(counts[kept])) >= self.least_path
        return kept


def _with_paths(stats: DataFrame, forest: Forest) -> DataFrame:
    names = [*stats.columns, "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATS], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.paths(features(counts)))], names)

    schema = ", ".join(f"`{n}` {t}" for n, t in stats.dtypes)
    return stats.mapInArrow(run, schema + ", path double")


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Model:
    """Forest from a bounded sample of the labelled rows, threshold from all of them."""
    worst = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    passed = stats.where(~F.col("base_failed")).select(F.col(id_col).alias("doc_id"), *STATS)
    labelled = passed.join(worst, "doc_id")
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id", *STATS).limit(FIT_ROWS).collect()
    if not sample:
        return Model()
    forest = Forest.fit(features(np.array([[r[c] for c in STATS] for r in sample], np.int64)))
    top = float(forest.path.max())
    binned = _with_paths(labelled.select(*STATS, "quality"), forest).select("quality", F.floor(F.col("path") / top * BINS).alias("bin"))
    good, bad = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for r in binned.groupBy("quality", "bin").count().collect():  # at most two rows a bin
        (good if r["quality"] else bad)[int(r["bin"]) + 1] += r["count"]
    return Model(forest, float(best_bin(good, bad)) * top / BINS)


def best_bin(good: np.ndarray, bad: np.ndarray) -> int:
    """Bin up to which rows are rejected, by the weighted rule; from the good and bad rows in each bin."""
    lost, caught = np.cumsum(good), np.cumsum(bad)  # rows below the upper end of each bin
    return int(np.argmax(caught / max(1, bad.sum()) - GOOD_WEIGHT * lost / max(1, good.sum())))


def judge(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` and ``kept``."""
    names = [*stats.columns, "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATS], axis=1)
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.verdicts(counts, failed))], names)

    schema = ", ".join(f"`{n}` {t}" for n, t in stats.dtypes)
    return stats.mapInArrow(run, schema + ", kept boolean")


def quality_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, five counts, base_failed, kept) of every row.  The statistics are written once: fitting, calibration and
    the verdicts read them, never the texts again."""
    stats = stored(statistics(df, id_col, text_col))
    return judge(stats, fit(stats, labels, id_col))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the rules keep, all columns.  Row-local after the fit: texts are not shuffled."""
    model = fit(stored(statistics(df, id_col, text_col)), labels, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                counts = np.array([count_text(t or "") for t in rows.column(text_col).to_pylist()], np.int64).reshape(-1, 5)
                failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
                yield rows.filter(pa.array(model.verdicts(counts, failed)))

    return df.mapInArrow(run, df.schema)
