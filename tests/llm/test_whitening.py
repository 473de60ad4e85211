"""Whitening against plain linear algebra on the distinct vectors, and its factorisations by themselves."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import queries, whitening

DIR = "/root/testdata/sf0.001"


def brute(rows):
    """Expected (n, x by row, explained, covariance) from exact sums of the distinct scaled vectors."""
    x = {i: tuple(math.floor(256 * c) for c in v) for i, v in rows}
    fit = sorted(set(x.values()))
    n, dim = len(fit), len(fit[0])
    sums = [sum(v[d] for v in fit) for d in range(dim)]
    v = [[sum((Fraction(f[i]) - Fraction(sums[i], n)) * (Fraction(f[j]) - Fraction(sums[j], n)) for f in fit) / n for j in range(dim)] for i in range(dim)]
    return n, x, sums, np.array([[float(c) for c in r] for r in v])


def check(rows, got, keep=4):
    n, x, sums, v = brute(rows)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    by = {}
    for r in got:
        by.setdefault(r["component"], {})[r["vec_id"]] = r
    assert sorted(by) == list(range(1, min(keep, int((values > 1e-9 * values[0]).sum())) + 1))
    for k, of in by.items():
        assert set(of) == set(x)
        want = {i: sum((c - s / n) * e for c, s, e in zip(xi, sums, vectors[:, k - 1])) / math.sqrt(values[k - 1]) for i, xi in x.items()}
        sign = np.sign(sum(of[i]["whitened"] * want[i] for i in want))
        for i, r in of.items():
            assert r["n"] == n and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(x[i], sums))
            assert abs(r["whitened"] - sign * want[i]) < 1e-9 and abs(r["explained"] / (values[k - 1] / np.trace(v)) - 1) < 1e-9 and r["identity_error"] < 1e-10


def test_against_linear_algebra(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(80, 6)) @ np.diag([3.0, 2.0, 1.0, 0.5, 0.2, 0.1]) + 40
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, base[0].tolist()) for i in range(30)] + [(200, [-0.0] * 6)]
    odd = [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (302, [math.nan, *[1.0] * 5]), (303, [math.inf, *[1.0] * 5]), (304, [])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5).withColumns({c: F.lit(1) for c in ("x", "n", "dim", "component")})
    check(rows, whitening.whiten(table).collect())
    assert whitening.whiten(table.limit(0)).count() == 0
    again = whitening.whiten(table.orderBy(F.rand(1)).repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, whitening.whiten(table).collect()))


def test_rank_lengths_and_rows_without_id(spark):
    flat = [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)]
    short = [(20 + i, [float(i % 3), float(i)]) for i in range(6)]
    table = spark.createDataFrame([*flat, *short, (None, [1.0, 2.0, 1.0]), (5, [5.0, 10.0, 1.0]), (40, [7.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(table).collect()
    check(flat, [r for r in got if r["vec_id"] is not None and r["vec_id"] < 9])
    check(short, [r for r in got if r["vec_id"] is not None and 20 <= r["vec_id"] < 40])
    assert sum(r["vec_id"] is None for r in got) == 1 and sum(r["vec_id"] == 5 for r in got) == 2 and not [r for r in got if r["vec_id"] == 40]


def test_huge_components(spark):
    rows = [(i, [1e300 if i == 3 else float(i), 1e12 * i, -1e9]) for i in range(8)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1, 2} and all(math.isfinite(r["whitened"]) and r["deviation"] is None and r["identity_error"] < 1e-4 for r in got)


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    clean = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    check(clean, queries.op12_whitening(spark, DIR).collect())


@pytest.mark.parametrize("spread", [0.0, 1e-12])
def test_factorisations(spread):
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    values = np.array([5, 4, 4, 1, 1e-3, 1e-6, spread, 0, 0])
    a = (q * values) @ q.T
    factor = whitening.pivoted_cholesky((a + a.T) / 2)
    assert factor.shape[1] == 6 + (spread > 0) and np.abs(factor @ factor.T - a).max() < 1e-14
    norms, vectors = whitening.one_sided_jacobi(factor)
    assert np.allclose(norms[:6] ** 2, values[:6], rtol=1e-9) and np.abs(vectors.T @ vectors - np.eye(len(norms))).max() < 1e-13
    assert np.abs((vectors * norms**2) @ vectors.T - a).max() < 1e-14
