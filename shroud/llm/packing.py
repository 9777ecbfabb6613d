"""Operator 9: packing documents into sequences of bounded length, first-fit decreasing.

A document's ids (with a closing id 0) are cut every ``length`` ids; full pieces are sequences of their own.  The
remainders are packed by first-fit decreasing: a tournament tree over the free places of all bins finds the leftmost
bin that takes an item in log n steps.  Packing runs independently in randomised groups of about ``GROUP`` documents,
so no task sees more than that, whatever the corpus.  Only lengths and checksums are shuffled, never ids or texts.

Defined results: a null or empty text is the closing id alone.  Ids may be null, repeated or of any type and come back as they
are; repeated rows are packed each.  Items of one size are taken in order of id (null last), then of document length.  An
empty table gives no pieces.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import json_file
from .bpe_codec import ROWS_AT_ONCE, encoder_of, read_file
from .common import stored

LENGTH = 1024
GROUP = 20_000  # documents packed together, about
CLOSING = 0
PIECE = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def tokenise(df: DataFrame, vocabulary: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, doc_tokens, crcs): number of ids with the closing one, and the CRC-32 of every piece of ``length`` ids.
    ``vocabulary`` is a byte-level tokenizer in JSON; its special strings in a text are single tokens, as that
    library has it by default.  Null texts count as empty."""
    data = df.sparkSession.sparkContext.broadcast(read_file(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(data.value, "json")
        special = json_file(data.value)[2]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                tokens, crcs = [], []
                for ids in encode_special(encoder, special, [t or "" for t in rows.column(1).to_pylist()]):
                    ids = np.append(ids, CLOSING).astype("<u4")
                    tokens.append(len(ids))
                    crcs.append([zlib.crc32(ids[k:k + length]) for k in range(0, len(ids), length)])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
                                                 [id_col, "doc_tokens", "crcs"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, doc_tokens long, crcs array<long>")


def encode_special(encoder, special: dict[str, int], texts: list[str]) -> Iterator[np.ndarray]:
    """Ids of every text, in which special strings stand for their own ids (leftmost first, longest at one place)."""
    plan: list[list[str | int]] = []
    for text in texts:
        parts: list[str | int] = []
        while text:
            places = [(at, -len(s), s) for s in special if (at := text.find(s)) >= 0]
            if not places:
                break
            at, _, s = min(places)
            parts += [text[:at], special[s]]
            text = text[at + len(s):]
        plan.append([*parts, text])
    ids = encoder.encode([p for parts in plan for p in parts if isinstance(p, str)])
    for parts in plan:
        got = [next(ids) if isinstance(p, str) else np.array([p], np.uint32) for p in parts]
        yield np.concatenate(got) if len(got) > 1 else got[0]


def first_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of every item, items taken in the given order; the leftmost bin with room takes an item."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    best = [capacity] * (2 * leaves)  # best[k]: the largest free place below node k
    bins, offsets = [], []
    for size in sizes:
        k = 1
        while k < leaves:
            k *= 2
            if best[k] < size:
                k += 1
        bins.append(k - leaves)
        offsets.append(capacity - best[k])
        best[k] -= size
        while k > 1:
            k //= 2
            top = max(best[2 * k], best[2 * k + 1])
            if best[k] == top:
                break
            best[k] = top
    return bins, offsets


def pack(tokens: DataFrame, length: int = LENGTH, group: int = GROUP, id_col: str = "doc_id") -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).  ``tokens`` is stored first:
    its rows are counted for the number of groups, and a group is drawn per row, not by id, so that repeated or null
    ids do not gather in one group."""
    tokens = stored(tokens)
    groups = max(1, -(-tokens.count() // group))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows.select([id_col, "doc_tokens"]), [(id_col, "ascending"), ("doc_tokens", "ascending")]))
        total = rows.column("doc_tokens").to_numpy()
        rest = total % length
        order = np.argsort(-rest, kind="stable")
        order = order[rest[order] > 0]
        bins, offsets = first_fit(rest[order].tolist(), length)
        pieces = -(-total // length)
        doc = np.repeat(np.arange(len(total)), pieces)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(length, total[doc] - k * length)
        sequence, offset = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        last = (np.cumsum(pieces) - 1)[order]
        sequence[last], offset[last] = bins, offsets
        full = np.flatnonzero(size == length)
        sequence[full] = (max(bins) + 1 if bins else 0) + np.arange(len(full))
        crcs = rows.column("crcs").combine_chunks().flatten()
        figures = [k * length, size, crcs, total[doc], key[0].as_py() * (1 << 32) + sequence, offset]
        return pa.table([rows.column(id_col).take(pa.array(doc)), *(pa.array(c) for c in figures)], names=[id_col, *PIECE])

    kind = dict(tokens.dtypes)[id_col]
    drawn = tokens.withColumn("pack_group", F.floor(F.rand(42) * groups).cast("long"))
    return drawn.groupBy("pack_group").applyInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in PIECE))


def pack_documents(df: DataFrame, vocabulary: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(tokenise(df, vocabulary, length, id_col, text_col), length, id_col=id_col)
