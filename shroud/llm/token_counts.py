"""Operator 10: token counts of whole texts with a sentencepiece model.

A text longer than ``CHUNK`` is encoded as overlapping chunks with offsets.  Two neighbours are spliced
at a place inside their overlap where both have a token boundary and which is proven stable: the code point there
stands for a blank, the one before does not, and no piece of the vocabulary holds a blank behind something else.  So
no merge can cross the place, whatever stands further left or right.  Where an overlap has no such place, it is
doubled until it has or the text ends.  Row-local, no shuffle; null texts count as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import ROWS_AT_ONCE, read_file

CHUNK = 16_384  # bytes of a chunk, without its overlap
OVERLAP = 256  # bytes that a chunk shares with the next, at first
LIMIT = 4096
MARK = "▁"  # fixed value: the character that stands for a blank in pieces
BLANKS = (b" ", MARK.encode())

_counters: dict[bytes, "Counter"] = {}


class Counter:
    def __init__(self, model: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chunk, self.overlap = chunk, overlap
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        # the proof behind every splice; a vocabulary without it is encoded whole
        self.provable = not any(MARK in p.lstrip(MARK) for p in pieces)

    def starts(self, data: bytes, begin: int, end: int) -> list[int]:
        """Byte offsets in ``data`` where the tokens of ``data[begin:end]`` start."""
        proto = self.model.encode(data[begin:end].decode(), return_type="proto")
        return [begin + p.begin for p in proto.pieces]

    def splice(self, data: bytes, left: list[int], right: list[int], begin: int) -> int | None:
        """First place behind ``begin`` where both chunks start a token and no merge can cross."""
        both = set(right)
        for at in left:
            if at > begin and at in both and data.startswith(BLANKS, at) and not data[max(0, at - 4):at].endswith(BLANKS):
                return at
        return None

    def count_long(self, data: bytes) -> int:
        total, begin, counted = 0, 0, 0  # tokens that start before ``counted`` are in ``total``
        overlap = self.overlap
        own: list[int] | None = None
        while True:
            end = whole(data, begin + self.chunk + overlap)
            if own is None or overlap > self.overlap:
                own = self.starts(data, begin, end)
            if end >= len(data):
                return total + sum(x >= counted for x in own)
            following = whole(data, begin + self.chunk)
            other = self.starts(data, following, whole(data, following + self.chunk + self.overlap))
            at = self.splice(data, own, other, following)
            if at is None:
                overlap *= 2
                continue
            total += sum(counted <= x < at for x in own)
            begin, counted, own, overlap = following, at, other, self.overlap

    def count(self, texts: list[str]) -> list[int]:
        long = [self.provable and len(t) > self.chunk + self.overlap for t in texts]
        rest = iter(self.model.encode([t for t, cut in zip(texts, long) if not cut], num_threads=1))
        return [self.count_long(t.encode()) if cut else len(next(rest)) for t, cut in zip(texts, long)]


def whole(data: bytes, at: int) -> int:
    """``at``, moved forward to where a code point starts."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(data))


def counter_of(model: bytes) -> Counter:
    key = hashlib.sha256(model).digest()
    if key not in _counters:
        _counters[key] = Counter(model)
    return _counters[key]


def token_counts(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; ids may be null or repeated, other columns are not read."""
    data = df.sparkSession.sparkContext.broadcast(read_file(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(data.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                     pa.array(counter.count(texts), pa.int64())], [id_col, "n_bytes", "n_tokens"])

    kind = dict(df.dtypes)[id_col]
    counted = df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
