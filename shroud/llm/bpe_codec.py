"""Operator 1: byte-level BPE encoding and decoding of a text column.

The vocabulary file is read once on the driver (a fixed file of about 1 MB) and sent to the workers; a worker builds
its encoder once and keeps it with its cache of merged pieces.  Work is row-local: no shuffle.  A null text counts
as empty.  Only the named columns are read, so further columns of any name do no harm; ids may be null or repeated,
each row is answered by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, json_file, rank_file

ROWS_AT_ONCE = 512
TOKENS_AT_ONCE = 1 << 18

_encoders: dict[str, Encoder] = {}
_pieces: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder_of(data: bytes, kind: str) -> Encoder:
    """The worker's encoder for a vocabulary file, built once per worker."""
    key = kind + hashlib.sha256(data).hexdigest()
    if key not in _encoders:
        if kind == "ranks":
            _encoders[key] = Encoder(rank_file(data))
        else:
            vocabulary, merges, _ = json_file(data)
            _encoders[key] = Encoder(vocabulary, merges)
    return _encoders[key]


def pieces_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all pieces of a rank file by id, where each begins, and how long it is: all that decoding needs."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _pieces:
        ranks = rank_file(data)
        by_id = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            by_id[i] = piece
        size = np.array([len(p) for p in by_id], np.int64)
        _pieces[key] = np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(size) - size, size
    return _pieces[key]


def laid_out(pieces: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The bytes of the tokens, each put where its offset says."""
    flat, begin, _ = pieces
    out = []
    for at in range(0, len(ids), TOKENS_AT_ONCE):
        some, stops = ids[at:at + TOKENS_AT_ONCE], ends[at:at + TOKENS_AT_ONCE].astype(np.int64)
        upto = int(ends[at - 1]) if at else 0
        size = np.diff(stops, prepend=upto)
        out.append(flat[np.arange(upto, int(stops[-1])) + np.repeat(begin[some] - (stops - size), size)].tobytes())
    return b"".join(out)


def _packed(ends: np.ndarray) -> bytes:
    return ends.astype("<u8").tobytes()


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, ends): ``ids`` are the token ids as little-endian unsigned 32-bit integers, ``ends`` the byte offset
    behind every token as little-endian unsigned 64-bit integers.  ``vocabulary`` is the path of a rank file."""
    data = df.sparkSession.sparkContext.broadcast(read_file(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(data.value, "ranks")
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                ids = list(encoder.encode([t or "" for t in rows.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                     pa.array([_packed(encoder.ends(x)) for x in ids], pa.binary())], [id_col, "ids", "ends"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, ends binary")


def decode(df: DataFrame, vocabulary: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``decoded``: the bytes of the tokens of ``ids``, laid out by ``ends``."""
    data = df.sparkSession.sparkContext.broadcast(read_file(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(data.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                out = [laid_out(pieces, np.frombuffer(ids, "<u4"), np.frombuffer(ends, "<u8").astype(np.int64))
                       for ids, ends in zip(rows.column("ids").to_pylist(), rows.column("ends").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keep), pa.array(out, pa.binary())], [*keep, "decoded"])

    fields = [f for f in df.schema.fields if f.name in keep]
    order = sorted(fields, key=lambda f: keep.index(f.name))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in order)
    return df.mapInArrow(run, f"{schema}, decoded binary")


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): ``encode`` and ``decode`` in one pass, so that offsets stay in the worker and a core needs one
    worker instead of two."""
    data = df.sparkSession.sparkContext.broadcast(read_file(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces = encoder_of(data.value, "ranks"), pieces_of(data.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                ids = list(encoder.encode([t or "" for t in rows.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                     pa.array([laid_out(pieces, x, encoder.ends(x)) for x in ids], pa.binary())], [id_col, "ids", "decoded"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")


def digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: number of tokens, digest of the ids, digest of the text decoded from them."""
    hexed: Callable[[str], Column] = lambda c: F.sha2(F.col(c), 256)
    return round_trip(df, vocabulary, id_col, text_col).select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       hexed("ids").alias("ids_sha256"), hexed("decoded").alias("decoded_sha256"))
