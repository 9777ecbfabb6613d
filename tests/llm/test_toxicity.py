import random
import zlib

import numpy as np
import pytest

from shroud.llm.toxicity import (AIMED, AIMED_THREAT, GRAMMAR, MUTED, PLAIN, START, SYMBOLS, THREATENING, Lexicon, Model, entries, lexicon, regression,
                                 toxicity, weigh, window)

DOCS, LABELS = "doc_id long, text string", "doc_id long, toxic int"


@pytest.fixture(scope="module")
def unfitted():
    return Model(lexicon({}, 0.1), START)


def test_clauses_not_words_are_scored(unfitted):
    aimed, plain, denied, told, clean = unfitted.scores(
        ["You are an idiot.", "An idiot.", "You are not an idiot.", "They said: idiot.", "You are a friend."])
    assert aimed > plain > denied == told > clean
    quoted, after = unfitted.scores(['The word "idiot" was there.', "The word was there. Idiot."])
    assert quoted < after
    aimed_threat, threat = unfitted.scores(["We will hurt you.", "Stones hurt."])
    assert aimed_threat > threat > clean
    assert unfitted.scores(["Not here. You idiot."])[0] > unfitted.scores(["Not you idiot."])[0]  # a denial ends with its clause


@pytest.mark.parametrize("text, kind", [
    ("moron", PLAIN), ("you moron", AIMED), ("morons? moron like you", AIMED), ("never a moron", MUTED), ('"moron"', MUTED), ("du bist dumm", AIMED),
    ("kill", THREATENING), ("i will kill you", AIMED_THREAT), ("never kill", MUTED)])
def test_kinds_of_matches(unfitted, text, kind):
    found = np.array(unfitted.lexicon.matches(text))
    assert found[kind] > 0 and found[kind] == found.max()
    assert np.flatnonzero(found).tolist() == ([kind - 1, kind] if kind in (AIMED, AIMED_THREAT) else [kind])


def test_composition_equals_machines_run_side_by_side():
    one, two = window({3}, {1}, 2, "a"), window({4}, {1}, 3, "b")
    rng = random.Random(0)
    both, s1, s2 = one * two, one.start, two.start
    s = both.start
    for _ in range(500):
        symbol = rng.choice(list(SYMBOLS))
        s, marks = both.step(s, symbol)
        s1, m1 = one.step(s1, symbol)
        s2, m2 = two.step(s2, symbol)
        assert (s, marks) == ((s1, s2), m1 + m2)
    assert all(len(row) == len(SYMBOLS) and all(0 <= then < len(GRAMMAR) for then, _ in row) for row in GRAMMAR)


def test_weights_shrink_along_stems():
    weights = weigh({"vequ": (300, 0), "vequa$": (1, 0), "vequet$": (0, 20)}, 0.1)
    assert weights["vequ"] > weights["vequet$"] and weights["vequa$"] > 3 > 0 > weights["vequet$"]
    words = Lexicon(weights)
    assert words.read("vequxyz")[1] == weights["vequ"] and words.read("vequet")[1] == 0
    assert "vequa$" in entries("Vequa!") and "veq" in entries("Vequa!") and "vequa" not in entries("Vequa!")


def test_regression_against_gradient():
    rng = np.random.default_rng(0)
    x = rng.random((300, 5))
    y = (rng.random(300) < 0.3).astype(float)
    w = regression(x, y)
    features = np.column_stack([x, np.ones(300)])
    p = 1 / (1 + np.exp(-features @ w))
    gradient = features.T @ (p - y) + 0.5 * (w - START)
    assert (w[:-1] >= 0).all() and np.abs(gradient[w != 0]).max() < 1e-6 and (gradient[w == 0] >= 0).all()


def corpus(seed=0, n=900):
    """Invented words; a third of the documents toxic by one of two stems with any ending, one harmless word shares a stem."""
    rng = random.Random(seed)
    syllables = ["ba", "ko", "ri", "ne", "tu", "sa", "mi", "lo", "pe", "da"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(10, 60))]
        toxic = rng.random() < 0.33
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grum", "xilp"]) + word())
        elif rng.random() < 0.3:
            words.insert(0, "grumble")
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = corpus()
    df, given = spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, LABELS)
    got = {r["doc_id"]: r for r in toxicity(df, given).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    truth = dict(labels)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    # labels of the held-out fold, right or wrong, change nothing
    turned = spark.createDataFrame([(i, 1 - y if i in set(held) else y) for i, y in labels], LABELS)
    again = {r["doc_id"]: r["score"] for r in toxicity(df, turned).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_odd_rows_and_missing_labels(spark):
    rows = [(1, None), (None, "you idiot"), (None, "you idiot"), (3, ""), (4, "word " * 200_000 + "you idiot"), (5, "ok")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], DOCS + ", score double")
    none = spark.createDataFrame([(None, 1), (3, None)], LABELS)
    for labels in (none, spark.createDataFrame([], LABELS), spark.createDataFrame([(1, 0), (1, 1), (5, 0)], LABELS)):
        got = sorted((r["doc_id"] or 0, r["held_out"], r["score"], r["predicted"]) for r in toxicity(df, labels).collect())
        assert [g[0] for g in got] == [0, 0, 1, 3, 4, 5] and got[0] == got[1]
        assert got[0][2] > got[2][2] == got[3][2]
    assert toxicity(spark.createDataFrame([], DOCS), none).collect() == []
