"""Whitening against plain NumPy and Python integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from stridelake.llm import whitening

KIND = "vec_id long, embedding array<float>, n int, x int"


def brute(rows):
    """vec_id, exact deviation and whitened coordinates (up to sign) of each row, and the shares of the trace."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    c = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    v = c.T @ c / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    of = {i: (sum((n * a - s) ** 2 for a, s in zip(x, sums)), np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ (axes / np.sqrt(np.abs(values)))) for i, x in kept}
    return n, of, values / v.trace()


@pytest.mark.parametrize("d", [3, 20])
def test_whitening(spark, d):
    rng = np.random.default_rng(d)
    plain = (rng.normal(size=(300, d)) @ rng.normal(size=(d, d)) * 0.3 + 0.1).astype("f4")
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(plain)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(2000, rows[9][1][:2]), (2001, None), (2002, []), (2003, [None] * d), (2004, [math.nan] * d), (2005, [math.inf] * d), (None, rows[3][1])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], KIND).repartition(5)
    n, want, shares = brute([r for r in rows if r[0] != 2000])
    got = whitening.whiten(table).collect()
    k = min(d, 16)
    assert len(got) == k * len([r for r in rows if r[0] is None or r[0] < 2000])
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    sign = {r.component: np.sign(r.whitened * want[5][1][r.component - 1]) for r in got if r.vec_id == 5}
    for r in got:
        assert r.deviation == want[r.vec_id][0]
        assert r.whitened == pytest.approx(sign[r.component] * want[r.vec_id][1][r.component - 1], rel=1e-6, abs=1e-8)
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)


def test_whitening_edges(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame([(i, v, 1, 2) for i, v in rows], KIND.replace("float", "double"))).collect()
    assert make([]) == make([(1, None)]) == make([(1, [1.0, 2.0])]) == make([(i, [1.0, 2.0]) for i in range(9)]) == []
    two = make([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])])  # one axis
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9), r.explained) for r in two) == [(i, 1, 2, 64**2, 1.0, 1.0) for i in (1, 2, 3)]
    huge = make([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 5.0])])  # beyond a long: told apart, not wrong
    assert {r.deviation for r in huge if r.vec_id < 3} == {None}
    # Exact where squares of 64-bit numbers wrap on the way: deviations near 2**63.
    wide = whitening.Whitener(3, [3_000_000, 3_000_000], np.zeros((2, 0)), np.zeros(0), np.zeros(0))
    x = np.array([[1_000_000 + 10**9, 1_000_000], [1_000_000 + 1_012_333_499, 1_000_000 - 3], [1_000_000 + 2 * 10**9, 0]])
    assert wide.deviations(x) == [9 * 10**18, (3 * 1_012_333_499) ** 2 + 81 if (3 * 1_012_333_499) ** 2 + 81 < 2**63 else None, None]
