import math

import numpy as np
import pytest

from shroud.llm.whitening import one_sided_jacobi, pivoted_cholesky, whiten

VECTORS = "vec_id long, embedding array<float>"


def by_hand(rows, components=32):
    """{row: (deviation, whitened)} and shares, by numpy's eigenvalues over Python integers."""
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in fine]
    n = len(x)
    sums = [sum(col) for col in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    return [i for i, _ in fine], deviation, centred @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def checked(spark, rows, components=32):
    got = whiten(spark.createDataFrame(rows, VECTORS).repartition(3), components).collect()
    ids, deviation, whitened, explained = by_hand(rows, components)
    k = len(explained)
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {len(ids)}
    table = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(k):
        ours = np.array([table[i, c + 1]["whitened"] for i in ids])
        sign = np.sign(ours @ whitened[:, c])
        assert np.allclose(sign * ours, whitened[:, c], rtol=1e-8, atol=1e-8)
    assert all(table[i, 1]["deviation"] == d for i, d in zip(ids, deviation))
    assert np.allclose([table[ids[0], c + 1]["explained"] for c in range(k)], explained, rtol=1e-9)
    assert got[0]["identity_error"] < 1e-8 and len({r["identity_error"] for r in got}) == 1


def test_equal_to_numpy(spark):
    rng = np.random.default_rng(0)
    mix = rng.normal(size=(12, 12))
    rows = [(i, (rng.normal(size=12) @ mix).tolist()) for i in range(400)]
    rows += [(1000 + i, v) for i, (_, v) in enumerate(rows[:100])]  # copies count each time
    rows += [(2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11)]
    checked(spark, rows)
    checked(spark, rows, 5)


def test_low_rank_and_small_tables(spark):
    rng = np.random.default_rng(1)
    plane = rng.integers(-3, 4, (2, 6)).astype(float)
    checked(spark, [(i, (rng.integers(-9, 9, 2) @ plane).tolist()) for i in range(50)])  # two components
    checked(spark, [(1, [1.0, 2.0]), (2, [3.0, -1.0])])
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, [])], [(1, None)]):
        assert whiten(spark.createDataFrame(rows, VECTORS)).collect() == []


def test_large_entries_null_ids_lengths_and_clashing_columns(spark):
    rows = [(None, [2.0 ** 15, 1.0], 1), (7, [-2.0 ** 15, 0.5], 2), (7, [3.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int")
    got = whiten(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (7, 1), (7, 1), (7, 2), (7, 2)]
    assert got[0].asDict().keys() >= {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    wide = spark.createDataFrame([(1, [2.0 ** 40, 1.0]), (2, [-2.0 ** 40, 0.5]), (3, [3.0, 3.0])], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whiten(wide).collect()} == {1}  # the other direction has no share of the variance in double precision
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whiten(huge).collect()} & {None}


@pytest.mark.parametrize("dims", [1, 2, 7, 30])
def test_factor_and_rotation(dims):
    rng = np.random.default_rng(dims)
    g = rng.normal(size=(dims, dims)) * 10.0 ** rng.uniform(-3, 3, dims)
    a = g @ g.T
    factor = pivoted_cholesky(a)
    assert np.allclose(factor @ factor.T, a, rtol=1e-9, atol=1e-12 * a.max())
    values, vectors = one_sided_jacobi(factor)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.allclose(vectors * values @ vectors.T, a, rtol=1e-9, atol=1e-12 * a.max())
    assert (np.diff(values) <= 0).all()
