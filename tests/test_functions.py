import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crestline.functions import algebra
from crestline.functions.kernels import Kernel, derivative, gaussian
from crestline.functions.scales import parse_scales, sorted_distinct, to_thirds
from crestline.operators.blocks import convolve, crossings, eigen, eigen_literal
from crestline.plans.detection import detection
from crestline.plans.oracle import GAUSSIANS

from .test_detection import image


def test_kernels():
    assert gaussian(0) is None and gaussian(1 / 6) is None
    assert gaussian(1 / 3).taps == pytest.approx([1 / 6, 2 / 3, 1 / 6])
    assert gaussian(2 / 3).taps == pytest.approx([1 / 36, 2 / 9, 1 / 2, 2 / 9, 1 / 36])
    assert derivative().taps == (-0.5, 0.0, 0.5)
    assert gaussian(1, sampled=True).taps[3] == pytest.approx(1 / math.sqrt(2 * math.pi))


def test_weights_of_the_sql_are_those_of_the_binomials():
    """(1 + 4x + x^2)^n / 6^n, in whole numbers."""
    for n, taps in GAUSSIANS.items():
        exact = [1]
        for _ in range(n):
            exact = [a + 4 * b + c for a, b, c in zip([*exact, 0, 0], [0, *exact, 0], [0, 0, *exact])]
        assert [t * 6**n for t in taps] == pytest.approx(exact, rel=1e-15)
        assert gaussian(n / 3).taps == pytest.approx(taps, rel=1e-15)


_NUMBER = st.floats(-1e6, 1e6).filter(lambda x: x == 0 or abs(x) > 1e-6)


@given(_NUMBER, _NUMBER, _NUMBER)
def test_eigenvalues_have_the_trace_and_determinant(a, b, d):
    l1, l2, c, s = (float(x) for x in eigen(*(np.array(x) for x in (a, b, d))))
    size = max(abs(a), abs(b), abs(d))
    assert l1 + l2 == pytest.approx(a + d, abs=1e-6 * size)
    assert l1 * l2 == pytest.approx(a * d - b * b, abs=1e-6 * size * size)
    assert c * c + s * s == pytest.approx(1)
    # (c, -s) is the vector of l1, (s, c) that of l2
    for value, x, y in ((l1, c, -s), (l2, s, c)):
        assert [a * x + b * y - value * x, b * x + d * y - value * y] == pytest.approx([0, 0], abs=1e-6 * size)


@given(st.floats(0.2, 12))
def test_gaussian_sums_to_one(t):
    k = gaussian(t)
    assert sum(k.taps) == pytest.approx(1) and len(k.taps) == 2 * round(3 * t) + 1


def test_scales():
    assert parse_scales("1:0.5:2") == [1, 1.5, 2] == parse_scales("2:-0.5:1")
    assert parse_scales("0.7") == [0.7]
    assert sorted_distinct([2, 1, 2]) == [1, 2]
    assert to_thirds([0.5, 0.34]) == [2 / 3, 1 / 3]
    for bad in ("1:2", "1:0:2", "a", "-1", "2:1:1", "nan", "1:2:3:4"):
        with pytest.raises(ValueError):
            parse_scales(bad)


def test_convolve_clamps_each_end():
    a = np.array([[1.0, 2.0, 4.0]])
    assert convolve(a, derivative(), 1).tolist() == [[-0.5, -1.5, -1.0]]
    assert convolve(a, Kernel((1.0,)), 0).tolist() == a.tolist()


@pytest.mark.parametrize(
    "abd, want",
    [
        ((-3, 0, 1), (-3, 1, 1, 0)),
        ((1, 2, 1), (3, -1, 0.70710678, -0.70710678)),
        ((0, 2, 3), (4, -1, -0.4472136, 0.8944272)),
        ((3, 2, 0), (-1, 4, 0.4472136, 0.8944272)),
        ((2, 0, 2), (2, 2, 1, 0)),
    ],
)
def test_eigen(abd, want):
    got = [float(x[0]) for x in eigen(*(np.array([float(v)]) for v in abd))]
    assert got == pytest.approx(want)


def test_eigen_stays_stable_for_small_off_diagonals():
    l1, l2, _, _ = eigen(np.array([1e-5]), np.array([1e-5]), np.array([1.0]))
    assert l1[0] == pytest.approx(1.0, abs=1e-8) and l2[0] == pytest.approx(1e-5, rel=1e-3)


@pytest.mark.parametrize("lp, want", [((1, -1), 64), ((1, 0), 128), ((0, 1), 0), ((-1, 3), 32), ((0, 0), -1), ((0, -1), -1), ((-1, 0), -1), ((1, 1), -1), ((-1, -1), -1), ((math.nan, 1), -1)])
def test_edge_truth_table(lp, want):
    assert crossings(np.array([lp], float), np.full((1, 2), -1.0), 1).tolist() == [[want]]


@pytest.mark.parametrize("lpp, ok", [((-1, -1), True), ((1, -1), True), ((3, -1), False)])
def test_edge_curvature(lpp, ok):
    assert (crossings(np.array([[1.0, -1.0]]), np.array([lpp], float), 1)[0, 0] >= 0) == ok


def test_literal_shift_reproduces_its_cancellation(spark):
    """a = b = 1e-5, d = 1: the shift is lost, so the rotation is 45 degrees and the diagonal is no spectrum."""
    rng = np.random.default_rng(3)
    a, b, d = (rng.normal(size=4000).astype(np.float32) for _ in range(3))
    b[::3] *= np.float32(1e-4)
    b[::7] = 0
    d[::11] = a[::11]
    a[0], b[0], d[0] = 1e-5, 1e-5, 1
    b[1] = np.nan
    rows = [(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(zip(a, b, d))]
    e = algebra.eigen_literal(F.col("a"), F.col("b"), F.col("d"))
    got = spark.createDataFrame(rows, "i int, a double, b double, d double").select("i", e.alias("e")).orderBy("i").collect()
    mine = np.array([[r.e.l1, r.e.l2, r.e.e11, r.e.e21] for r in got], np.float32)
    want = np.stack(eigen_literal(a, b, d), axis=1)
    assert mine.tobytes() == want.tobytes() and want.dtype == np.float32
    assert want[0, 2] == pytest.approx(0.5**0.5, abs=1e-6) and abs(want[0, 3]) == pytest.approx(0.5**0.5, abs=1e-6)
    assert max(want[0, :2]) < 0.6  # the larger eigenvalue is 1
    stable = np.stack(eigen(*(x.astype(np.float64) for x in (a, b, d))), axis=1)
    sharp = (np.abs(b) > 0.5 * np.abs(a - d)) & (np.abs(a - d) > 0.1)  # where nothing cancels
    assert np.allclose(want[sharp], stable[sharp], atol=1e-4)


def test_detection_in_single_precision(spark):
    grid = np.random.default_rng(8).normal(size=(40, 40))
    raw = image(spark, grid)
    near = [detection(raw, 1.0, plan=p, compat=True).edges.select("row", "col", "dir", "d", "brightness", "strength") for p in ("blocks", "tiles")]
    one, two = (sorted(map(tuple, df.collect())) for df in near)
    assert one == two and all(np.float32(r[5]) == r[5] for r in one)
    wide = sorted(map(tuple, detection(raw, 1.0).edges.select("row", "col", "dir", "d", "brightness", "strength").collect()))
    assert wide != one and len({r[:3] for r in wide} ^ {r[:3] for r in one}) < len(one) / 20
    with pytest.raises(ValueError):
        detection(raw, plan="windows", compat=True)
