"""Operator 6: removal of byte strings of ``SPAN`` bytes that occur more than once in the corpus, by suffix order.

Every text is cut into stretches of consecutive windows of ``SPAN`` bytes that share their least gram hash (of all
grams of ``GRAM`` bytes inside the window).  Equal windows have equal least hashes, so all windows that could be equal
lie in stretches of one hash, and a shuffle on that hash brings them together; each window lies in exactly one
stretch.  A stretch whose hash occurs nowhere else and only once in itself has no repeats and is dropped at once.
Equal stretches are counted before anything else, so copies, however many, are one class with a count.

The classes of a hash are then compared by a transform built column-wise, many strings at a time: all windows that can
be equal hold the same gram at the same place, so strings are aligned there, and each round inserts one symbol of every
string (from the last column to the first), updating the order of all suffixes that start in the column, the column of
the transform, and the longest common prefixes of neighbours, with sequential files for columns and results.  Windows
whose neighbours share ``SPAN`` bytes are repeated.  Alignment is what keeps a round proportional to the number of
strings: the transform of unaligned suffixes (all of them in one order, as in the textbook construction) was built first
and cost the whole collection a round, see the README for figures.

A hash with more than ``HOT_CLASSES`` different stretches (a passage that very many texts share, each time with
another context), or with more than ``HOT_PERIODIC`` of which some hold the gram several times, is split further: its
windows are counted one by one under their own 128-bit hash, exactly and spread over all tasks.  Nothing is dropped or
capped.

Null and empty texts count as empty.  Rows are named by 128 bits of their values, so ids may be null or repeated;
equal rows are documents of their own (they repeat each other) and get equal results.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import ROWS_AT_ONCE
from .common import free_names, own_exchange, row_key, stored

SPAN = 200
GRAM = 32
STRETCH = 200  # windows in one stretch, at most
BLOCK = 1 << 18  # bytes of text whose windows are hashed at once
COLLECTION = 8192  # strings in one transform, about
HOT_CLASSES, HOT_PERIODIC = 65_536, 1024  # what one task holds of one hash: about 100 MB


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every ``gram`` bytes, by doubling; equal grams have equal hashes."""
    h = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = ((h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB))[data]
    n, factor = 1, 0xD6E8FEB86659FD93
    while n < gram:
        step = min(n, gram - n)
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = (factor * factor * 0xA0761D6478BD642F | 1) & 0xFFFFFFFFFFFFFFFF
        n += step
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` over every ``width`` consecutive values, by doubling."""
    n = 1
    while 2 * n <= width:
        values = best(values[:-n], values[n:])
        n *= 2
    return best(values[:len(values) - (width - n)], values[width - n:]) if width > n else values


def stretches(data: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Start, number of windows, least hash and ``own`` (the hash occurs twice or more in the stretch) of every
    stretch of the texts that lie in ``data`` one after the other, ending at ``ends``."""
    if len(data) < span:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, bool))
    hashes = gram_hashes(data, gram)
    width = span - gram + 1
    least = sliding(hashes, width, np.minimum)
    valid = np.ones(len(least), bool)
    for end in ends.tolist():  # windows that reach into the next text
        valid[max(0, end - span + 1):end] = False
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(least))
    gaps = np.flatnonzero(~valid)
    at = np.searchsorted(gaps, start)
    stop = np.minimum(stop, np.where(at < len(gaps), gaps[np.minimum(at, len(gaps) - 1)], len(least))) if len(gaps) else stop
    # long stretches (periodic text) in parts
    parts = -(-(stop - start) // STRETCH)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(start, parts) + k * STRETCH
    windows = np.minimum(np.repeat(stop, parts) - begin, STRETCH)
    value = least[begin]
    # grams that are the least of some window that holds them
    padded = np.concatenate([np.zeros(width - 1, np.uint64), np.where(valid, least, np.uint64(0)), np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(sliding(padded, width, np.maximum) == hashes)
    low = np.searchsorted(chosen, begin)
    high = np.searchsorted(chosen, begin + windows + width - 1)
    count = high - low
    held = chosen[np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)]
    same = hashes[held] == np.repeat(value, count)
    own = np.bincount(np.repeat(np.arange(len(begin)), count), same, len(begin)) >= 2
    return begin, windows, value, own


def anchors(strings: list[bytes], hashes: list[int], gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every gram that has the string's hash."""
    size = np.array([len(s) for s in strings])
    found = gram_hashes(np.frombuffer(b"".join(strings), np.uint8), gram)
    owner = np.repeat(np.arange(len(strings)), size)[:len(found)]
    offset = np.arange(len(found)) - (np.cumsum(size) - size)[owner]
    hit = np.flatnonzero((found == np.array(hashes, np.int64).view(np.uint64)[owner]) & (offset <= size[owner] - gram))
    return owner[hit], offset[hit]


def repeated_windows(strings: list[bytes], hashes: list[int], folder: str, span: int = SPAN, gram: int = GRAM) -> list[np.ndarray]:
    """For every string, which of its windows of ``span`` bytes occur elsewhere among the strings of its hash (or in
    itself).  Strings of one hash come one after the other.

    Every window holds a gram of the string's hash, and equal windows hold it at the same place; so each string is laid
    out with that gram at one column (once for each of its grams), and only suffixes that start in the same column can
    begin with equal windows.  The construction goes through the columns from the last to the first.  A round inserts
    one symbol of every string: it takes the suffixes in order (by hash, then bytes), sorts them stably by the new
    symbol, which is the last column of the transform, and updates the longest common prefix of neighbours, all of it in
    time proportional to the number of strings.  Columns are read from one sequential file; which windows have a neighbour
    with ``span`` common bytes goes to another."""
    entry, place = anchors(strings, hashes, gram)
    before, width = span - gram, 2 * span - gram
    size = np.array([len(s) for s in strings])
    begin = np.cumsum(size) - size
    text = np.frombuffer(b"".join(strings), np.uint8)
    low = np.maximum(0, before - place)  # columns of the entry's first byte, and behind its last
    high = np.minimum(width, before - place + size[entry])
    useful = high - low >= span
    entry, place, low, high = entry[useful], place[useful], low[useful], high[useful]
    out = [np.zeros(n - span + 1, bool) for n in size.tolist()]
    if not len(entry):
        return out
    base = begin[entry] + place - before  # of column 0
    columns, flags = os.path.join(folder, "columns"), os.path.join(folder, "flags")
    with open(columns, "wb") as sink:
        for t in range(width):
            text[np.clip(base + t, 0, len(text) - 1)].tofile(sink)
    _, group = np.unique(np.array(hashes, np.int64)[entry], return_inverse=True)
    joining = np.argsort(high, kind="stable")
    joins = np.searchsorted(high[joining], np.arange(width + 2))
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int64)
    with open(columns, "rb") as source, open(flags, "wb") as sink:
        for t in range(width - 1, -1, -1):
            source.seek(t * len(entry))
            symbol = np.frombuffer(source.read(len(entry)), np.uint8)
            stay = np.flatnonzero(low[order] <= t)  # the others began in the column before
            if len(stay) < len(order):
                order, common = order[stay], _range_min(common, np.append(0, stay[:-1] + 1), stay + 1)
            new = joining[joins[t + 1]:joins[t + 2]]
            if len(new):  # their suffix was empty so far: the least of its hash
                order = np.concatenate([new, order])
                common = np.concatenate([np.zeros(len(new), np.int64), common])
                first = np.argsort(group[order], kind="stable")
                order, common = order[first], common[first]
            key = group[order] * 256 + symbol[order]
            step = np.argsort(key, kind="stable")
            same = np.flatnonzero(key[step[1:]] == key[step[:-1]])
            fresh = np.zeros(len(order), np.int64)
            fresh[same + 1] = np.minimum(_range_min(common, step[same] + 1, step[same + 1] + 1) + 1, span)
            order, common = order[step], fresh
            if t <= width - span:
                long = common >= span
                flag = np.zeros(len(entry), bool)
                flag[order[long | np.append(long[1:], False)]] = True
                flag.tofile(sink)
    flat = np.zeros(len(text), bool)
    with open(flags, "rb") as source:
        for t in range(width - span, -1, -1):
            flat[base[np.frombuffer(source.read(len(entry)), bool)] + t] = True
    return [flat[b:b + n - span + 1] for b, n in zip(begin.tolist(), size.tolist())]


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value of every [low, high)."""
    if not len(low):
        return np.zeros(0, values.dtype)
    order = np.argsort(-low, kind="stable")  # from the right, so that nothing between two ranges is read
    pairs = np.stack([low[order], high[order]], axis=1).reshape(-1)
    out = np.empty(len(low), values.dtype)
    out[order] = np.minimum.reduceat(np.append(values, np.iinfo(values.dtype).max), pairs)[::2]
    return out


def covered(windows: np.ndarray, span: int) -> tuple[list[int], list[int]]:
    """Byte ranges that repeated windows cover, as starts and ends."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], windows.astype(np.int8), [0]])))
    return edge[::2].tolist(), (edge[1::2] + span - 1).tolist()


def _cut_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for group in _blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data = b"".join(g[3] for g in group)
            ends = np.cumsum([len(g[3]) for g in group])
            begin, windows, value, own = stretches(np.frombuffer(data, np.uint8), ends)
            text = np.searchsorted(ends, begin, side="right")
            base = (ends - np.array([len(g[3]) for g in group]) - np.array([g[2] for g in group]))[text]
            content = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(begin.tolist(), (begin + windows + SPAN - 1).tolist())]
            k1, k2 = np.array([g[0] for g in group])[text], np.array([g[1] for g in group])[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(begin - base), pa.array(windows, pa.int32()), pa.array(value.view(np.int64)),
                 pa.array(np.array(content, np.uint64).view(np.int64)), pa.array(own)], ["k1", "k2", "pos", "windows", "m", "c", "own"])


def _blocks(k1: list, k2: list, texts: list) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """(key, key, offset, bytes) in groups of bounded size; a long text comes in parts that overlap by all but one
    byte of a window, so that each window is in one part."""
    group, held = [], 0
    for a, b, text in zip(k1, k2, texts):
        data = (text or "").encode()
        for at in range(0, max(1, len(data) - SPAN + 1), BLOCK):
            part = data[at:at + BLOCK + SPAN - 1]
            if len(part) < SPAN:
                continue
            group.append((a, b, at, part))
            held += len(part)
            if held >= BLOCK:
                yield group
                group, held = [], 0
    if group:
        yield group


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the stretches that a text was asked for."""
    for batch in batches:
        rows = batch.to_pylist()
        out = [(w["m"], w["c"], w["n"], w["hot"], text[w["pos"]:w["pos"] + w["windows"] + SPAN - 1])
               for r in rows for text in [_unpacked(r["packed"])] for w in r["wanted"]]
        for at in range(0, len(out), 4096):
            m, c, n, hot, content = zip(*out[at:at + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int64()),
                                              pa.array(hot, pa.bool_()), pa.array(content, pa.binary())], ["m", "c", "n", "hot", "content"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash: the classes of several hashes make one collection, those of one hash never two."""
    held: list[tuple[int, int, int, bytes]] = []

    def result() -> pa.RecordBatch:
        with tempfile.TemporaryDirectory() as folder:  # scratch of this task alone, gone at its end
            flags = repeated_windows([h[3] for h in held], [h[0] for h in held], folder)
        out = []
        for (m, c, n, _), windows in zip(held, flags):
            starts, ends = covered(np.ones(len(windows), bool) if n > 1 else windows, SPAN)
            if starts:
                out.append((m, c, starts, ends))
        cols = list(zip(*out)) or [(), (), (), ()]
        ints = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], ints),
                                           pa.array(cols[3], ints)], ["m", "c", "starts", "ends"])

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("m", "c", "n", "content"))):
            if len(held) >= COLLECTION and held[-1][0] != row[0]:
                yield result()
                held = []
            held.append(row)
    if held:
        yield result()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a stretch by its own hash."""
    for batch in batches:
        for m, c, n, content in zip(*(batch.column(k).to_pylist() for k in ("m", "c", "n", "content"))):
            digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(content[k:k + SPAN]) for k in range(len(content) - SPAN + 1)]), "<i8")
            count = len(digests) // 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests[::2]), pa.array(digests[1::2]), pa.array(np.full(count, m)), pa.array(np.full(count, c)),
                 pa.array(np.full(count, n)), pa.array(np.arange(count), pa.int32())], ["h1", "h2", "m", "c", "n", "at"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of repeated windows, as the byte ranges that they cover."""
    ints = pa.list_(pa.int32())
    for batch in batches:
        out = [union_ranges([(x, x + SPAN) for x in at]) for at in batch.column("starts").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("m"), batch.column("c"), pa.array([[b for b, _ in r] for r in out], ints),
                                          pa.array([[e for _, e in r] for r in out], ints)], ["m", "c", "starts", "ends"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            rows = batch.slice(at, ROWS_AT_ONCE)
            packer = zstandard.ZstdCompressor(level=1)
            texts = [packer.compress((t or "").encode()) for t in rows.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(texts, pa.binary())], [*batch.schema.names[:3], "packed"])


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def repeated_ranges(keyed: DataFrame, packed: DataFrame) -> DataFrame:
    """(k1, k2, spans): for every text with repeats, the byte ranges that repeated windows cover (they may overlap).
    ``keyed`` has k1, k2 and text; ``packed`` k1, k2 and the compressed text."""
    cut = stored(keyed.mapInArrow(_cut_stretches, "k1 long, k2 long, pos long, windows int, m long, c long, own boolean"))
    shared = cut.groupBy("m").agg(F.count("*").alias("n"), F.max("own").alias("o")).where("n > 1 or o").select("m")
    found = stored(cut.join(own_exchange(shared, "m"), "m"))
    classes = found.groupBy("m", "c").agg(F.count("*").alias("n"), F.max("own").alias("own"), F.max("windows").alias("windows"),
                                          F.min(F.struct("k1", "k2", "pos")).alias("at"))
    per_hash = classes.groupBy("m").agg(F.count("*").alias("classes"), F.max("own").alias("any_own"))
    classes = stored(classes.join(own_exchange(per_hash, "m"), "m"))
    unlike = F.expr("classes > 1 or any_own")
    copies = classes.where(~unlike).where("n > 1").select(
        "m", "c", F.array(F.lit(0)).alias("starts"), F.array(F.col("windows") + (SPAN - 1)).alias("ends"))
    hot = (F.col("classes") > HOT_CLASSES) | (F.col("any_own") & (F.col("classes") > HOT_PERIODIC))
    asked = classes.where(unlike).select(
        F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2"),
        F.struct("m", "c", "n", hot.alias("hot"), "at.pos", "windows").alias("w"))
    asked = asked.groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted"))  # bounded by one text
    once = packed.select("k1", "k2", "packed").join(asked, ["k1", "k2"])
    contents = stored(once.mapInArrow(_contents, "m long, c long, n long, hot boolean, content binary").dropDuplicates(["m", "c"]))
    compared = contents.where("not hot").repartition("m").sortWithinPartitions("m", "c").mapInArrow(
        _compare, "m long, c long, starts array<int>, ends array<int>")
    windows = contents.where("hot").mapInArrow(_windows, "h1 long, h2 long, m long, c long, n long, at int")
    again = windows.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").select("h1", "h2")
    counted = windows.join(own_exchange(again, "h1", "h2"), ["h1", "h2"]).groupBy("m", "c").agg(F.collect_list("at").alias("starts")).select(
        "m", "c", "starts").mapInArrow(_joined, "m long, c long, starts array<int>, ends array<int>")
    ranges = copies.unionByName(compared).unionByName(counted)
    spans = found.join(ranges, ["m", "c"]).select("k1", "k2", F.expr(
        "explode(arrays_zip(transform(starts, x -> pos + x), transform(ends, x -> pos + x))) as span"))
    return spans.select("k1", "k2", F.struct(F.col("span.0").alias("b"), F.col("span.1").alias("e")).alias("span")).groupBy(
        "k1", "k2").agg(F.collect_set("span").alias("spans"))  # bounded by one text


def union_ranges(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2, n_bytes, n_removed, n_spans, kept): ``kept`` are the remaining bytes."""
    keyed = df.select(id_col, *row_key(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text"))
    kind = dict(df.dtypes)[id_col]
    packed = keyed.mapInArrow(_packed, f"`{id_col}` {kind}, k1 long, k2 long, packed binary")
    ranges = repeated_ranges(keyed.select("k1", "k2", "text"), packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                size, removed, spans, kept = [], [], [], []
                for data, found in zip(map(_unpacked, rows.column("packed").to_pylist()), rows.column("spans").to_pylist()):
                    gone = union_ranges([(x["b"], x["e"]) for x in found or []])
                    edges = [0, *(x for r in gone for x in r), len(data)]
                    kept.append(b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])]))
                    size.append(len(data))
                    removed.append(len(data) - len(kept[-1]))
                    spans.append(len(gone))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(k) for k in (id_col, "k1", "k2")), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], [id_col, "k1", "k2", "n_bytes", "n_removed", "n_spans", "kept"])

    return packed.join(ranges, ["k1", "k2"], "left").select(id_col, "k1", "k2", "packed", "spans").mapInArrow(
        run, f"`{id_col}` {kind}, k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept binary")


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: str = "__removed") -> DataFrame:
    """All columns of ``df``, the text without its repeated bytes, and as ``count`` (a name that ``df`` must not have) how many
    those were.  A code point that loses some of its bytes goes as a whole.  An empty table gives an empty one."""
    h1, h2, found_spans = free_names(df, "__k1", "__k2", "__spans")
    keyed = df.select(*row_key(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text"))
    packed = keyed.select(F.lit(0).alias("x"), "k1", "k2", "text").mapInArrow(_packed, "x int, k1 long, k2 long, packed binary")
    ranges = repeated_ranges(keyed, packed).select(F.col("k1").alias(h1), F.col("k2").alias(h2), F.col("spans").alias(found_spans))
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    joined = df.withColumns({h1: k1, h2: k2}).join(ranges, [h1, h2], "left").drop(h1, h2)
    own = df.columns
    place, names = own.index(text_col), [*own, count]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                texts, removed = [], []
                for text, found in zip(rows.column(text_col).to_pylist(), rows.column(found_spans).to_pylist()):
                    gone = union_ranges([(x["b"], x["e"]) for x in found or []])
                    if gone:
                        data = text.encode()
                        edges = [0, *(x for r in gone for x in r), len(data)]
                        text = b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])]).decode(errors="ignore")
                    texts.append(text)
                    removed.append(sum(e - b for b, e in gone))
                columns = [rows.column(k) for k in own]
                columns[place] = pa.array(texts, columns[place].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())], names)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return joined.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in df.columns) + f", `{count}` long")


def removal_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return remove_repeats(df, id_col, text_col).select(
        id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
