"""Operators 5, 6 and 7 against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import tempfile

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shroud.llm import simhash, suffix_dedup
from shroud.llm.components import components
from shroud.llm.line_dedup import common_blocks, dedup_lines, large_enough, line_report, patience
from shroud.llm.simhash import keep_one, near_duplicates
from shroud.llm.suffix_dedup import cut_repeats, removal_digests

SCHEMA = "doc_id long, text string, k1 string, fp int, root string, lines int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, "r", 2) for i, t in rows], SCHEMA)


def prose(rnd, n):
    return " ".join("".join(rnd.choice(["ta", "ro", "min", "el", "ös", "k"]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    passage = prose(rnd, 120)
    out = [(k, prose(rnd, rnd.randint(20, 200)) + "\n" + (passage if k % 3 == 0 else "") + "\n" + prose(rnd, 60)) for k in range(1, 30)]
    out += [(k + 100, t) for k, t in out[:6]]
    out += [(k + 200, t.replace("min", "mon", 1)) for k, t in out[:6]]
    out += [(None, None), (None, ""), (7, ""), (300, "a" * 3000), (301, "ab" * 700), (302, "é" * 400), (303, "Two Words"), (303, "Two Words"), (304, "x" * 199), (305, out[0][1])]
    return out


# SimHash


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_near_duplicates(spark, rows):
    prints = [fingerprint(t or "") for _, t in rows]
    group = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    least = {g: min((i for (i, _), h in zip(rows, group) if h == g and i is not None), default=None) for g in set(group)}
    want = collections.Counter((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, group))
    assert collections.Counter(map(tuple, near_duplicates(frame(spark, rows)).collect())) == want
    assert len(set(group)) < len(rows) - 8
    kept = keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(set(group))
    assert near_duplicates(frame(spark, []).limit(0)).count() == 0
    assert keep_one(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("bits", [3, 6, 11])
def test_balls_meet_in_every_bucket_size(bits, monkeypatch):
    monkeypatch.setattr(simhash, "ROUND_VARIANTS", 1 << 11)
    rng = np.random.default_rng(1)
    prints = set()
    for base in rng.integers(0, 2**63, 60, dtype=np.uint64):
        for _ in range(5):
            x = int(base)
            for f in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(f)
            prints.add(x)
    fp = np.array(sorted(prints), np.uint64)
    place = {int(x): k for k, x in enumerate(fp)}
    links = []
    ball = simhash.Ball(2, bits)
    own = ball.bucket(fp)
    for b in range(1 << bits):
        u, v = simhash.meet(fp[ball.flips(own ^ b)[1] > 0], 2, bits, b)
        links += [(place[int(x)], place[int(y)]) for x, y in zip(u, v)]
    near = [(a, b) for a in range(len(fp)) for b in range(a) if int(np.bitwise_count(fp[a] ^ fp[b])) <= 4]
    assert union(len(fp), links) == union(len(fp), near)
    assert sum(ball.count) == 1 + 64 + 64 * 63 // 2
    assert len(ball.steps) == 1 + bits + bits * (bits - 1) // 2


def test_a_bucket_receives_a_bounded_share_at_every_size():
    """No size at which the plan changes: more fingerprints make more buckets, and what one fingerprint sends stays small."""
    before = 0
    for n in (0, 1, 10**5, 10**7, 10**8, 10**9, 10**10, 5 * 10**10):
        bits = simhash.label_bits(n, 2)
        share = simhash.reached(2, bits) / (1 << bits)
        assert bits >= before and n * share <= simhash.BUCKET_ROWS and share < 0.06
        assert 8 * simhash.reached(2, bits) < 2048 + 8
        before = bits


@pytest.mark.parametrize("rows_a_bucket", [1 << 22, 40])
def test_links_with_more_buckets(spark, rows_a_bucket, monkeypatch):
    """The links of a table do not depend on the number of buckets (10 label bits, or as many as 40 fingerprints a bucket ask for)."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", rows_a_bucket)
    rng = np.random.default_rng(3)
    prints = set()
    for base in rng.integers(0, 2**63, 400, dtype=np.uint64):
        for _ in range(4):
            x = int(base)
            for f in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(f)
            prints.add(x)
    fp = np.array(sorted(prints), np.uint64)
    assert (simhash.label_bits(len(fp), 2) > simhash.LEAST_BITS) == (rows_a_bucket == 40)
    place = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    got = simhash.links(spark.createDataFrame([(x,) for x in place], "fp long").repartition(3)).collect()
    links = [(place[r.u], place[r.v]) for r in got]
    near = [(a, a + 1 + int(b)) for a in range(len(fp)) for b in np.flatnonzero(np.bitwise_count(fp[a + 1:] ^ fp[a]) <= 4)]
    assert union(len(fp), links) == union(len(fp), near) and len(near) > 500


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 460)]
    want = union(500, links)
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {x: want[x] for a, b in links if a != b for x in (a, b)}


# suffix order


def brute_cut(texts, span):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(d[k:k + span] for d in data for k in range(len(d) - span + 1))
    out = []
    for d in data:
        hit = np.zeros(len(d) + 1, int)
        for k in range(len(d) - span + 1):
            if count[d[k:k + span]] > 1:
                hit[k] += 1
                hit[k + span] -= 1
        gone = np.cumsum(hit)[:len(d)] > 0
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [8192, 0])
def test_removal(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_CLASSES", hot)  # 0: every hash with unlike stretches is split by windows
    want = collections.Counter((i, *x) for (i, _), x in zip(rows, brute_cut([t for _, t in rows], 200)))
    assert collections.Counter(map(tuple, removal_digests(frame(spark, rows)).collect())) == want


def test_removal_of_nothing(spark):
    assert removal_digests(frame(spark, []).limit(0)).count() == 0
    cut = cut_repeats(frame(spark, [(1, "short"), (2, None), (None, "y" * 300 + "ö" * 200)]))
    assert {(r.doc_id, r.text, r["__removed"]) for r in cut.collect()} == {(1, "short", 0), (2, None, 0), (None, "", 700)}


def test_transform_finds_repeated_windows():
    rnd = random.Random(9)
    span, gram = 12, 4
    grams = suffix_dedup.gram_hashes(np.frombuffer(b"abbaaabb", np.uint8), gram).view(np.int64)
    for value, core in ((int(grams[0]), "abba"), (int(grams[4]), "aabb")):
        strings = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 8))) + core + "".join(rnd.choice("ab") for _ in range(rnd.randint(8, 16))) for _ in range(150)]
        strings = [s.encode() for s in strings] + [b"abba" * 9, b"aabb" * 8]
        strings = [s for s in strings if len(s) >= span]
        hashed = [suffix_dedup.gram_hashes(np.frombuffer(s, np.uint8), gram).view(np.int64).tolist() for s in strings]
        held = lambda s, h: [value in h[k:k + span - gram + 1] for k in range(len(s) - span + 1)]
        count = collections.Counter(s[k:k + span] for s, h in zip(strings, hashed) for k, x in enumerate(held(s, h)) if x)
        with tempfile.TemporaryDirectory() as folder:
            got = suffix_dedup.repeated_windows(strings, [value] * len(strings), folder, span, gram)
        assert [x.tolist() for x in got] == [[x and count[s[k:k + span]] > 1 for k, x in enumerate(held(s, h))] for s, h in zip(strings, hashed)]


def test_each_window_lies_in_one_stretch():
    rnd = random.Random(4)
    texts = [prose(rnd, 400).encode(), b"a" * 2000, b"abc" * 500, b"", b"short", prose(rnd, 90).encode()]
    ends = np.cumsum([len(t) for t in texts])
    begin, windows, value, own = suffix_dedup.stretches(np.frombuffer(b"".join(texts), np.uint8), ends)
    seen = [k for b, n in zip(begin.tolist(), windows.tolist()) for k in range(b, b + n)]
    assert seen == [k for t, e in zip(texts, ends.tolist()) for k in range(e - len(t), e - 199) if k >= e - len(t)]
    assert max(windows) <= suffix_dedup.STRETCH


# lines


def test_patience():
    a = [1, 2, 3, 4, 5, 9, 9, 6]
    assert patience(a, a) == [(k, k) for k in range(8)]
    assert patience([1, 2, 3, 4], [7, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert patience([1, 2, 3], [3, 1, 2]) == [(0, 1), (1, 2)]
    assert patience([], [1]) == [] and patience([5, 5], [6, 6]) == []
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.randint(0, 9) for _ in range(rnd.randint(0, 20))] for _ in range(2))
        got = patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_small_blocks_stay():
    assert common_blocks([1, 2], [1, 3], [99, 50]) == []
    assert common_blocks([1, 2], [1, 3], [100, 50]) == [0]
    assert common_blocks([1, 2, 3], [8, 1, 2, 3], [9, 1, 1, 1]) == [1, 2, 3]
    assert common_blocks([0, 0, 0], [0, 0, 0], [0, 0, 0]) == []


def test_line_dedup(spark):
    block = [f"shared line number {k} of the block" for k in range(4)]
    one = "\n".join(["own a", *block, "", "tail a"])
    rows = [(1, one), (2, "\n".join(["own b", *block, "tail b"])), (3, one), (3, one), (4, "own c\nshared line number 2 of the block"),
            (5, "w" * 120 + "\nx"), (6, "y\n" + "w" * 120), (None, None), (None, ""), (7, "")]
    got = {(r.doc_id, r.text): (r["__lines"], r["__deleted"]) for r in dedup_lines(frame(spark, rows)).collect()}
    assert got == {(1, one): (7, 0), (2, "own b\ntail b"): (6, 4), (3, ""): (7, 7), (4, rows[4][1]): (2, 0), (5, rows[5][1]): (2, 0),
                   (6, "y"): (2, 1), (None, None): (1, 0), (None, ""): (1, 0), (7, ""): (1, 0)}
    report = line_report(frame(spark, rows))
    assert report.count() == len(rows) and report.where("n_deleted > 0").count() == 4
    assert line_report(frame(spark, []).limit(0)).count() == 0


def test_a_common_line_makes_links_not_squares(spark):
    rows = [(k, f"only here {k}\n" + "the same boilerplate line of every document " * 3) for k in range(300)]
    kept = dedup_lines(frame(spark, rows)).where(F.col("__deleted") > 0)
    assert kept.count() == 299


def brute_lines(texts):
    """Lines that lie in a large enough run which an earlier text holds."""
    held, out = set(), []
    for text in texts:
        lines = [x if x.strip() else 0 for x in text.split("\n")]
        runs = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1)]
        gone = {k for a, b in runs if tuple(lines[a:b]) in held and large_enough(lines[a:b], [len(x or "") for x in lines[a:b]]) for k in range(a, b)}
        held |= {tuple(lines[a:b]) for a, b in runs}
        out.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone))
    return out


def test_a_block_whose_lines_all_have_earlier_holders(spark):
    block = ["first line", "second line", "", "third line"]
    rows = [(k, f"own {k}\n{x}\nown {k} too") for k, x in enumerate(x for x in block if x)]
    rows += [(10, "\n".join(["head 10", *block, "tail 10"])), (11, "\n".join(["head 11", *block, "tail 11"]))]
    long = ["l" * 150, "", "m" * 60, "n" * 60, "o"]
    rows += [(20, long[0]), (21, "\n".join(long[2:4])), (22, "\n".join(["p", *long[:3], "q"])), (23, "\n".join(["r", *long, "s"])), (24, "\n".join(["t", *long, "u"]))]
    got = {r.doc_id: r.text for r in dedup_lines(frame(spark, rows)).collect()}
    assert got == dict(zip([i for i, _ in rows], brute_lines([t for _, t in rows])))
    assert got[11] == "head 11\ntail 11" and got[24] == "t\nu"


def test_repeated_and_moved_blocks():
    o, p, b = [11, 12], [21, 22, 23], [31, 32, 33]
    assert common_blocks([o[0], *b, o[1]], [p[0], *b, p[1], *b, p[2]], [9] * 9) == [1, 2, 3, 5, 6, 7]
    assert common_blocks([o[0], *b, o[1], *b], [p[0], *b, p[1]], [9] * 5) == [1, 2, 3]
    assert common_blocks([*b, *o, 41, 42, 43], [41, 42, 43, *p, *b], [9] * 9) == [0, 1, 2, 6, 7, 8]
    rnd = random.Random(3)
    size = [0, 1, 40, 60, 99, 100]
    for _ in range(400):
        x, y = ([rnd.randint(0, 5) for _ in range(rnd.randint(0, 25))] for _ in range(2))
        n = [size[h] for h in y]
        held = {tuple(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        runs = [(i, j) for i in range(len(y)) for j in range(i + 1, len(y) + 1) if tuple(y[i:j]) in held and large_enough(y[i:j], n[i:j])]
        assert common_blocks(x, y, n) == sorted({k for i, j in runs for k in range(i, j)})


def test_repeated_blocks_against_brute_force(spark):
    rnd = random.Random(12)
    pool = ["", " ", "short", "another", "w" * 60, "v" * 100, "u" * 99, "last one"]
    rows = [(k, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 14)))) for k in range(80)]
    got = {r.doc_id: r.text for r in dedup_lines(frame(spark, rows)).collect()}
    assert got == dict(zip([i for i, _ in rows], brute_lines([t for _, t in rows])))


def test_columns_named_like_helpers_are_kept(spark):
    from shroud.llm.line_dedup import dedup_lines
    from shroud.llm.simhash import keep_one
    from shroud.llm.suffix_dedup import cut_repeats

    block = "\n".join(f"a shared line number {k} of some length" for k in range(12))
    rows = [(k, f"own beginning {k}\n{block}\nown end {k}", f"x{k}", k, "g", k * 2) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __k1 string, __K2 int, __gone string, __spans int")
    clash = ["__k1", "__K2", "__gone", "__spans"]
    for out in (dedup_lines(df), cut_repeats(df), keep_one(df)):
        got = {r["doc_id"]: tuple(r[c] for c in clash) for r in out.collect()}
        assert got and all(got[i] == rows[i][2:] for i in got)
    assert dedup_lines(df, counts=("n", "m")).columns == [*df.columns, "n", "m"] and cut_repeats(df, count="n").columns == [*df.columns, "n"]


@pytest.mark.parametrize("bits", [10, 20])
def test_senders_memory_with_many_buckets(bits):
    """A full batch of fingerprints: every pair once, and no more held than the bound says."""
    import tracemalloc

    from shroud.llm.simhash import PACKED, PAIRS, Ball, scattered

    ball = Ball(2, bits)
    fp = np.random.default_rng(5).integers(0, 1 << 63, PACKED // 2).astype(np.uint64)
    own = ball.bucket(fp)
    total = check = 0
    tracemalloc.start()
    for bucket, packed in scattered(fp, own, ball.steps):
        got = np.frombuffer(packed, np.uint64)
        total += len(got)
        check ^= int(np.bitwise_xor.reduce(got)) ^ bucket
        if total < 1000:
            assert ball.flips(ball.bucket(got) ^ bucket)[1].all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == len(fp) * len(ball.steps) and peak < 40 * PAIRS  # 0.7 GB
    assert PAIRS * 8 < 1 << 28
