"""Operators 1, 9 and 10 against the tokenizer libraries."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as tokenizer_files
import pytest
import sentencepiece
import tiktoken
import tokenizers

from shroud.llm import bpe, token_counts
from shroud.llm.bpe_codec import decode, digests, encode
from shroud.llm.packing import first_fit, pack_documents

RANKS = tokenizer_files.path("byte_bpe_multi_50k.tiktoken")
JSON = tokenizer_files.path("byte_bpe_50k.json")
MODEL = tokenizer_files.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, decoded int, `offset` int, k1 string"
ROWS = [(1, None), (1, ""), (None, "a b's  \n c"), (2, "é'll \U0001f600 12½\t\t x"), (2, "é'll \U0001f600 12½\t\t x"), (3, "word " * 5000), (4, "x" * 9000),
        (5, "say <|endoftext|> twice<|endoftext|>"), (6, "\x00 \x85　 a")]


def rows_of(spark):
    return spark.createDataFrame([(i, t, "clash", 1, 2, "k") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=tokenizer_files.PATTERN, mergeable_ranks=bpe.rank_file(open(RANKS, "rb").read()), special_tokens={})


def fuzzed(n):
    rnd = random.Random(7)
    alphabet = ["a", "'s", "'re", "'", "'ll", "l", "v", "e", " ", "  ", "\n", "\t", "1", "½", "!", "?é", "中", "\U0001f600", "\x85", "\xa0", "\x1c", "'ve", "'d", "\r\n", "٣"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25))) for _ in range(n)] + ["a" * 3000, "ab" * 900 + "x" * 777, " " * 999]


def test_encoder_equals_libraries(library):
    texts = fuzzed(4000) + [t or "" for _, t in ROWS]
    own = bpe.Encoder(bpe.rank_file(open(RANKS, "rb").read()))
    assert [x.tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    vocabulary, merges, _ = bpe.json_file(open(JSON, "rb").read())
    texts = [t for t in texts if "<|endoftext|>" not in t]
    theirs = tokenizers.Tokenizer.from_file(JSON).encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in bpe.Encoder(vocabulary, merges).encode(texts)] == [x.ids for x in theirs]


def test_every_code_point_has_the_class_of_the_pattern(library):
    own = bpe.Encoder(bpe.rank_file(open(RANKS, "rb").read()))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 7 == 0)]
    texts = [f"a{c}b 1{c}2 !{c}! {c}" for c in points]
    assert [x.tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_long_texts_are_cut_where_the_pattern_must_cut(library, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_CODE_POINTS", 64)
    own = bpe.Encoder(bpe.rank_file(open(RANKS, "rb").read()))
    texts = ["it's  a \n\n test'll do " * 200, "x" * 2000, "a " * 900]
    assert [x.tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_cut_where_no_white_space_is(library, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_CODE_POINTS", 16)
    own = bpe.Encoder(bpe.rank_file(open(RANKS, "rb").read()))
    texts = ["a1" * 300, "ab'sx'll1'" * 90, "1!'re" * 100, "it's''s'" * 70, "\n" * 500 + "x", "!?" * 300 + "'s", "é½" * 200]
    assert [x.tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    assert max(len(part) for group in own.cutter.batches(["a1" * 3000]) for part, _ in group) <= 3 * 16


def test_more_distinct_pieces_than_the_table_has_slots(library):
    """The table of pieces is emptied in time, whatever one text holds, and between texts."""
    own = bpe.Encoder(bpe.rank_file(open(RANKS, "rb").read()))
    texts = [" ".join(map(str, range(10**6, 10**6 + 2_300_000))), " ".join(map(str, range(4 * 10**6, 4 * 10**6 + 700_000)))]
    for text in texts:
        ids = next(own.encode([text]))
        assert own.merger.pieces <= bpe.CACHE_ENTRIES and (own.merger.held >= 0).mean() <= 0.5
        assert own.decode(ids) == text.encode()
    for at in range(0, len(texts[0]), 4_000_000):  # the library, on stretches between two spaces
        begin, end = texts[0].find(" ", at), texts[0].find(" ", at + 40_000)
        assert next(own.encode([texts[0][begin:end]])).tolist() == library.encode_ordinary(texts[0][begin:end])


def test_memory_follows_the_batch_not_the_text():
    import tracemalloc

    own = bpe.Encoder(bpe.rank_file(open(RANKS, "rb").read()))
    next(own.encode(["warm up"]))
    peaks = []
    for words in (400_000, 1_600_000):
        text = "some words " * words
        tracemalloc.start()
        ids = next(own.encode([text]))
        peaks.append(tracemalloc.get_traced_memory()[1] - 3 * ids.nbytes)  # the ids, their parts and what joins them
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + (20 << 20)


def test_digests_and_round_trip(spark, library):
    got = digests(rows_of(spark), RANKS).collect()
    want = []
    for i, t in ROWS:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert digests(rows_of(spark).limit(0), RANKS).count() == 0
    encoded = encode(rows_of(spark), RANKS)
    for r in encoded.where("doc_id = 2").collect():
        assert np.frombuffer(r.ends, "<u8")[-1] == len(ROWS[3][1].encode())
    assert {bytes(r.decoded) for r in decode(encoded, RANKS, ["doc_id", "ids"]).collect()} == {(t or "").encode() for _, t in ROWS}


def test_token_counts(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = token_counts.token_counts(rows_of(spark), MODEL).collect()
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in ROWS]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.token_counts(rows_of(spark).limit(0), MODEL).count() == 0


@pytest.mark.parametrize("chunk, overlap", [(16, 2), (64, 8), (500, 40)])
def test_chunks_resynchronise(chunk, overlap):
    counter = token_counts.Counter(open(MODEL, "rb").read(), chunk, overlap)
    assert counter.provable
    texts = fuzzed(150) + ["a b" * 300, "a  b   c \n\n" * 200, "▁a ▁ b" * 100, "中文 字" * 100, "\U0001f600 \U0001f600x" * 100, "nospace" * 300]
    assert counter.count(texts) == [len(counter.model.encode(t)) for t in texts]


def test_first_fit_takes_the_leftmost_bin():
    rnd = random.Random(3)
    sizes = sorted((rnd.randint(1, 100) for _ in range(300)), reverse=True)
    free, bins, offsets = [], [], []
    for s in sizes:
        k = next((k for k, room in enumerate(free) if room >= s), len(free))
        if k == len(free):
            free.append(100)
        bins.append(k)
        offsets.append(100 - free[k])
        free[k] -= s
    assert first_fit(sizes, 100) == (bins, offsets)
    assert first_fit([], 100) == ([], [])


def test_packing(spark):
    rows = pack_documents(rows_of(spark), JSON).collect()
    library = tokenizers.Tokenizer.from_file(JSON)
    ids_of = [(i, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in ROWS]
    want = collections.Counter()
    for i, ids in ids_of:
        for at in range(0, len(ids), 1024):
            want[(i, at, len(ids[at:at + 1024]), zlib.crc32(np.array(ids[at:at + 1024], "<u4").tobytes()), len(ids))] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack_documents(rows_of(spark).limit(0), JSON).count() == 0


def test_packing_keeps_ids(spark):
    """Null, repeated and very large ids come back as they are, and string ids too."""
    large = 9007199254740993
    df = spark.createDataFrame([(large, "a b"), (None, "c"), (None, None), (large, "a b"), (-1, "")], "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in pack_documents(df, JSON).collect()) == [(-1, 1), (0, 1), (0, 2), (large, 3), (large, 3)]
    named = df.selectExpr("cast(doc_id as string) doc_id", "text")
    assert {r.doc_id for r in pack_documents(named, JSON).collect()} == {None, "-1", str(large)}
