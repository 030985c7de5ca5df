from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
from nightjar.llm import queries, whitening

VECTORS = "vec_id long, embedding array<float>, n string, component string"


def brute(rows, components=16):
    """The definition, with fractions, over rows of equal vector length."""
    kept = [(i, [floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    centred = [[Fraction(x[d]) - Fraction(sums[d], n) for d in range(dims)] for x in fit]
    cov = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(dims)] for i in range(dims)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    out = {}
    for i, x in kept:
        deviation = sum((n * x[d] - sums[d]) ** 2 for d in range(dims))
        off = np.array([float(Fraction(x[d]) - Fraction(sums[d], n)) for d in range(dims)])
        out.setdefault(i, []).append((n, deviation, off @ axes / np.sqrt(np.maximum(values, 1e-300)), values / np.trace(cov)))
    return out


def grouped(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["vec_id"], []).append(r)
    return {i: sorted(rs, key=lambda r: r["component"]) for i, rs in out.items()}


def same(got, want, components):
    assert set(got) == set(want)
    signs = None
    for i, rows in got.items():
        times = len(want[i])
        assert len(rows) == components * times
        n, deviation, white, explained = want[i][0]
        own = rows[::times]
        assert [r["component"] for r in own] == list(range(1, components + 1))
        assert {(r["n"], r["deviation"]) for r in rows} == {(n, deviation)}
        values = np.array([r["whitened"] for r in own])
        if signs is None or (signs == 0).any():
            found = np.where(np.abs(white) > 1e-6, np.sign(values * white), 0)
            signs = found if signs is None else np.where(signs == 0, found, signs)
        assert np.allclose(values, white * np.where(signs == 0, 1, signs), atol=1e-7)
        assert np.allclose([r["explained"] for r in own], explained, rtol=1e-9)
        assert all(0 <= r["identity_error"] < 1e-9 for r in rows)


@pytest.mark.parametrize("dims", [5, 24])
def test_whitening_against_the_definition(spark, monkeypatch, dims):
    monkeypatch.setattr(whitening, "ROWS", 37)
    rng = np.random.default_rng(11)
    spread = np.linspace(3, 0.4, dims) * rng.standard_normal((dims, dims))
    rows = [(i, (rng.standard_normal(dims) @ spread + 5).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1_000 + i, rows[7][1]) for i in range(150)] + [(1, rows[1][1])]
    frame = spark.createDataFrame([(*r, "n", "c") for r in rows], VECTORS).repartition(4)
    same(grouped(whitening.whiten(frame)), brute(rows), min(16, dims))


def test_query_on_the_whole_table(spark):
    got = grouped(queries.op11_whitening(spark, "/root/testdata/sf0.001"))
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    same(got, brute(rows), 16)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.5]), (4, [nan, 1.0]), (5, [-inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0]),
            (8, [0.25, -2.0]), (9, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, 3.0]), (None, [3.0, 2.0])]
    frame = spark.createDataFrame([(*r, "n", "c") for r in rows], VECTORS)
    got = grouped(whitening.whiten(frame))
    assert set(got) == {0, 3, 7, 8, 9, 10, None} and len(got[0]) == 4 and len(got[None]) == 2
    same({i: r for i, r in got.items() if i not in (9, 10)}, brute([r for r in rows if r[0] not in (9, 10)]), 2)
    assert all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, 0.0, 0.0) for r in got[9])
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0


def test_large_entries_stay_exact():
    y = np.array([[2**40, -(2**41)], [3, 2**45]], dtype=np.int64)
    squares = whitening.exact_squares(y)
    assert squares == [2**80 + 9, (2**40 - 2**41) ** 2 + (3 + 2**45) ** 2, 2**82 + 2**90]


def test_an_axis_without_variance(spark):
    rows = [(i, [float(i % 5), 2.0, float(i % 3)]) for i in range(30)]
    got = grouped(whitening.whiten(spark.createDataFrame([(*r, "n", "c") for r in rows], VECTORS)))
    assert all(r[2]["whitened"] is None and r[2]["explained"] == 0 and r[0]["whitened"] is not None and r[0]["identity_error"] < 1e-9 for r in got.values())
