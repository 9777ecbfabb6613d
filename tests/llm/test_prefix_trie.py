import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shroud.llm.prefix_trie import RangeMinimum, prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    """Nodes from a plain dictionary of prefixes."""
    given = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            given[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in given.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items())


def nodes(spark, rows, size=4096):
    return Counter(tuple(r) for r in prefix_trie(spark.createDataFrame(rows, TURNS), size).collect())


def test_range_minimum_against_plain_search():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 8, 61):
        values = rng.integers(0, 4, n)
        table = RangeMinimum(values)
        for d in range(5):
            start = np.arange(n)
            right = [next((j - 1 for j in range(i + 1, n) if values[j] < d), n - 1) for i in range(n)]
            left = [next((j for j in range(i, 0, -1) if values[j] < d), 0) for i in range(n)]
            assert table.reach_right(start, np.full(n, d)).tolist() == right
            assert table.reach_left(start, np.full(n, d)).tolist() == left


@pytest.mark.parametrize("size", [1, 2, 5, 4096])
def test_equal_to_plain_trie(spark, size):
    """Blocks of every size: whole nodes, parted nodes, copies over many blocks, turnless conversations."""
    rng = random.Random(size)
    rows = []
    for c in range(60):
        if rng.random() < 0.15:
            continue  # absent, maybe a base
        for t in range(rng.randrange(1, 12)):
            rows.append((c, t, rng.choice(["u", "a"]), rng.choice(["", "é", "xy", "z" * 40])))
    rows += [(c, t, "u", "same") for c in range(100, 140) for t in range(3)]  # a third are copies
    rng.shuffle(rows)
    assert nodes(spark, rows, size) == by_hand(rows)


def test_nulls_ties_long_texts_and_empty_tables(spark):
    rows = [(1, None, "u", "first"), (1, 0, None, None), (1, 1, "u", "x" * 300_000), (2, 5, "", ""), (None, 0, "u", "a"), (7, 1, "u", "a"),
            (11, 0, "ab", "c"), (16, 0, "a", "bc")]
    assert nodes(spark, rows) == by_hand(rows)
    twice = [(3, 0, "u", "t"), (3, 0, "u", "t")] * 6
    assert nodes(spark, twice) == by_hand(twice)
    assert nodes(spark, [(None, 0, "u", "a")]) == Counter()
    assert nodes(spark, []) == Counter()


def test_clashing_columns_are_not_read(spark):
    df = spark.createDataFrame([(1, 0, "u", "a", 5, "k")], TURNS + ", block long, key string")
    assert Counter(tuple(r) for r in prefix_trie(df).collect()) == by_hand([(1, 0, "u", "a")])


def test_one_long_conversation(spark):
    rows = [(c, t, "u", str(t % 7)) for c in (500, 501) for t in range(200)]
    assert nodes(spark, rows, 1) == by_hand(rows)
