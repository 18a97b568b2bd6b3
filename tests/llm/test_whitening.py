"""Embedding whitening against exact fractions and NumPy, and at its edges."""

import math
from fractions import Fraction

import numpy as np
import pytest

from sheetspark.llm import whitening
from sheetspark.llm.queries import queries


def expected(vectors):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(0)
    products = (n * x - sums).T @ (n * x - sums)  # n^3 times the covariance, exactly
    cov = np.array([[float(Fraction(int(v), n**3)) for v in row] for row in products])
    return x, n, sums, cov


def test_query_against_exact_sums(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, n, sums, cov = expected([r["embedding"] for r in rows])
    values, directions = np.linalg.eigh(cov)
    values, directions = values[::-1], directions[:, ::-1]
    got = queries()["op11_whitening"](spark, sf).collect()
    assert len(got) == 32 * len(rows) and {r["n"] for r in got} == {n}
    dev = {r["vec_id"]: int(((n * a - sums) ** 2).sum()) for r, a in zip(rows, x, strict=True)}
    assert all(r["deviation"] == dev[r["vec_id"]] for r in got)
    table = np.zeros((32, len(rows)))
    place = {r["vec_id"]: k for k, r in enumerate(rows)}
    for r in got:
        table[r["component"] - 1, place[r["vec_id"]]] = r["whitened"]
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-12
    mean = np.array([[float(Fraction(int(n * v - s), n)) for v, s in zip(a, sums, strict=True)] for a in x])
    want = (mean @ directions[:, :32] / np.sqrt(values[:32])).T
    for a, b in zip(table, want, strict=True):
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
    error = np.abs(table @ table.T / n - np.eye(32)).max()
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-10 and error < 1e-10


def test_pairs_of_doubles_hold_what_doubles_lose():
    rng = np.random.default_rng(3)
    high = rng.normal(size=(64, 5)) * 1e8
    low = high * 1e-17 * rng.normal(size=high.shape)
    i, j = np.triu_indices(5)
    p, e = whitening.outer_sums(high, low, i, j)
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        exact = sum((Fraction(h1) + Fraction(l1)) * (Fraction(h2) + Fraction(l2)) for h1, l1, h2, l2 in zip(high[:, a].tolist(), low[:, a].tolist(), high[:, b].tolist(), low[:, b].tolist(), strict=True))
        size = sum(abs(h1 * h2) for h1, h2 in zip(high[:, a].tolist(), high[:, b].tolist(), strict=True))
        assert abs(exact - Fraction(float(p[k])) - Fraction(float(e[k]))) < Fraction(size) * Fraction(2) ** -98


def test_a_spread_far_below_the_mean(spark):
    """Plain sums of squares of values near 2^45 would lose a spread of some units."""
    rng = np.random.default_rng(5)
    base = 2.0**44
    vectors = base + rng.integers(-8, 8, size=(300, 3)) @ np.array([[1, 0, 0], [1, 2, 0], [0, 1, 1]]) / 64
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    model = whitening.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), components=3)
    _, n, sums, cov = expected(vectors)
    assert (model.n, model.sums) == (n, [int(s) for s in sums])
    assert np.allclose(model.variances, np.sort(np.linalg.eigvalsh(cov))[::-1], rtol=1e-12) and model.identity_error < 1e-10


def test_many_tiles_and_tasks_merge_alike(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(200, 12)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = whitening.fit(df.coalesce(1), components=12)
    monkeypatch.setattr(whitening, "TILE", 7)
    many = whitening.fit(df.repartition(9), components=12)
    assert one.sums == many.sums and np.allclose(one.variances, many.variances, rtol=1e-14) and one.trace == pytest.approx(many.trace, rel=1e-14)


def test_at_the_edges(spark):
    kind = "vec_id long, embedding array<float>, deviation string, `a.b` int"
    good = [(1, [1.0, 0.0], "x", 1), (2, [0.0, 1.0], "x", 2), (None, [0.5, -1.0], None, None), (1, [1.0, 0.0], "x", 1)]
    bad = [(3, None, "x", 1), (4, [1.0, None], "x", 1), (5, [float("nan"), 1.0], "x", 1), (6, [float("inf"), 1.0], "x", 1), (7, [1.0], "x", 1), (8, [], "x", 1), (9, [1e38, 1.0], "x", 1)]
    df = spark.createDataFrame(good + bad, kind)
    model = whitening.fit(df, components=5)
    out = whitening.whiten(df, model)
    assert out.columns == ["vec_id", "embedding", "a.b", "deviation", "whitened"]
    got = out.collect()
    assert sorted((r["vec_id"] or -1) for r in got) == [-1, 1, 1, 2] and model.n == 4 and all(len(r["whitened"]) == 2 for r in got)
    # one direction without variance
    flat = spark.createDataFrame([(1, [1.0, 7.0]), (2, [2.0, 7.0])], "vec_id long, embedding array<double>")
    model = whitening.fit(flat)
    rows = whitening.whiten(flat, model).collect()
    assert model.explained == [1.0, 0.0] and [abs(r["whitened"][0]) for r in rows] == [1.0, 1.0] and all(r["whitened"][1] is None for r in rows)
    single = whitening.whiten(flat.limit(1), whitening.fit(flat.limit(1))).first()
    assert single["deviation"] == 0 and single["whitened"] == [None, None]
    # no usable row
    for none in (df.where("vec_id = 3"), df.limit(0), df.where("vec_id = 8")):
        assert whitening.fit(none) is None and whitening.whiten(none, None).count() == 0 and whitening.whiten(none, None).columns == out.columns


def test_deviations_beyond_a_long(spark):
    far = spark.createDataFrame([(1, [2.0**44]), (2, [-(2.0**44)]), (3, [0.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(far, whitening.fit(far)).collect()}
    assert got[1] is None and got[3] == 0
    with pytest.raises(ValueError, match="dimensions"):
        wide = spark.createDataFrame([(1, [0.0] * (whitening.MOST_DIMENSIONS + 1))], "vec_id long, embedding array<double>")
        whitening.fit(wide)
