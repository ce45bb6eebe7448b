import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.llm import hard_negatives as hard
from crestline.llm.hard_negatives import hard_negatives
from crestline.llm.vantage import nearest
from crestline.llm.vectors import floats

SCHEMA = "vec_id bigint, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def cosine(a, b):
    a, b = (np.ldexp(np.array(x), -math.frexp(max(map(abs, x)))[1]) for x in (a, b))
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def last(x):
    return (x is None, x or 0)


def near_brute(rows, every, k):
    live = [r for r in rows if usable(r[1]) and any(r[1])]
    out = []
    for i, q in enumerate(live):
        if q[0] is not None and q[0] % every == 0:
            found = sorted(((-cosine(q[1], r[1]), last(r[0])) for j, r in enumerate(live) if j != i and len(r[1]) == len(q[1])))[:k]
            out += [(q[0], n + 1, None if none else id_, -s) for n, (s, (none, id_)) in enumerate(found)]
    return sorted(out, key=repr)


def hard_brute(rows, every, positives, k):
    live = [(i, r[0], [math.floor(256.0 * x) if abs(x) < 2**52 else 256 * int(x) for x in r[1]], r[2]) for i, r in enumerate(rows) if usable(r[1]) and r[2] is not None]
    clamp = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    out = []
    for i, a, v, label in live:
        if a is None or a % every:
            continue
        all_ = sorted((-clamp(sum(x * y for x, y in zip(v, w))), last(b), j, c) for j, b, w, c in live if j != i and len(w) == len(v))
        for s, p, _, _ in [x for x in all_ if x[3] == label][:positives]:
            fits = [x for x in all_ if x[3] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:k]
            out += [(a, None if p[0] else p[1], n + 1, None if b[0] else b[1], -s, -t) for n, (t, b, _, _) in enumerate(fits)]
    return sorted(out, key=repr)


def noise(n, dim, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=dim) * spread).tolist(), int(rng.integers(3))) for i in range(n)]


def whole(n, dim, seed=2):
    """Small integers: many equal and parallel vectors, so many ties."""
    rng = np.random.default_rng(seed)
    return [(i, rng.integers(-1, 2, dim).astype(float).tolist(), int(rng.integers(3))) for i in range(n)]


CASES = {
    "empty": [],
    "one row": noise(1, 4),
    "fewer rows than asked for": noise(4, 4),
    "noise": noise(400, 8),
    "ties": whole(300, 3),
    "nothing counts": [(0, None, 1), (2, [], 1), (4, [0.0, 0.0], 1), (6, [NAN, 1.0], 1), (8, [INF, 1.0], None), (10, [None, 1.0], 1)],
    "some count": [(0, None, 1), (2, [], 1), (4, [0.0, 0.0], 1), (6, [NAN, 1.0], 1), (8, [1.0, 1.0], None), (10, [None, 1.0], 1), (12, [1.0, 2.0], 0), (13, [2.0, 1.0], 1), (None, [2.0, 1.5], 0), (None, [2.0, 1.5], 1)],
    "two lengths": noise(60, 3) + [(i + 60, v, c) for i, v, c in noise(60, 5, 3)],
    "repeated ids and rows": noise(40, 3) + noise(20, 3) * 3 + [(0, [1.0, 2.0, 3.0], 1)] * 9,
    "a hot vector": [(i, [1.0, 2.0, 2.0], i % 2) for i in range(150)] + [(200 + i, v, c) for i, v, c in noise(60, 3)],
    "large and small": [(i, [x * 10.0 ** (40 * (i % 8) - 160) for x in v], c) for i, v, c in noise(60, 3)],
}


@pytest.mark.parametrize("rows_per_tree", [4096, 30])
@pytest.mark.parametrize("case", CASES)
def test_factor_one_is_exact(spark, case, rows_per_tree):
    rows = CASES[case]
    got = nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") % 2 == 0, 3, 1.0, rows_per_tree=rows_per_tree)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    got = sorted(map(tuple, got.collect()), key=repr)
    want = near_brute(rows, 2, 3)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=0, atol=1e-12)


@pytest.mark.parametrize("dim, least", [(4, 0.9), (8, 0.9), (64, 0.99)])
def test_default_factor_finds_nearly_all(spark, dim, least):
    rows = noise(6000, dim)
    got = {(r[0], r[2]) for r in nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") % 50 == 0, rows_per_tree=500).collect()}
    units = np.array([r[1] for r in rows])
    units /= np.sqrt((units * units).sum(axis=1))[:, None]
    s = units[::50] @ units.T
    s[np.arange(len(s)), np.arange(0, len(units), 50)] = -2
    want = {(50 * i, int(j)) for i, row in enumerate(s) for j in np.argsort(-row)[:5]}
    assert len(got & want) >= least * len(want)


def test_factors_below_one_are_refused(spark):
    with pytest.raises(ValueError):
        nearest(spark.createDataFrame([], SCHEMA), F.lit(True), factor=0.5)


@pytest.mark.parametrize("blocks", [(4096, 2048), (16, 7)])
@pytest.mark.parametrize("case", CASES)
def test_hard_negatives_equal_brute_force(spark, monkeypatch, case, blocks):
    monkeypatch.setattr(hard, "ROWS_PER_BLOCK", blocks[0])
    monkeypatch.setattr(hard, "ANCHORS_PER_BLOCK", blocks[1])
    rows = CASES[case]
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 5 == 0, 2, 3)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=repr) == hard_brute(rows, 5, 2, 3)


def test_labels_may_be_replaced_and_other_columns_do_not_matter(spark):
    rows = noise(80, 4)
    data = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("id"), F.lit(2).alias("VEC"), F.lit(3).alias("a`b"), F.lit(4).alias("Label2"))
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label"))
    got = hard_negatives(data, F.col("id") % 5 == 0, 2, 3, label=moved)
    want = hard_brute([(i, v, (c + 1) % 3 if i % 7 == 0 else c) for i, v, c in rows], 5, 2, 3)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    got = nearest(data, F.col("id") % 2 == 0, 3, 1.0)
    assert sorted(x[:3] for x in got.collect()) == sorted(x[:3] for x in near_brute(rows, 2, 3))


def test_lists_of_an_arrow_slice():
    import pyarrow as pa

    column = pa.array([[9.0], [1.0, 2.0], [], [3.0, 4.0], [5.0]]).slice(1, 4)
    assert {n: m.tolist() for m in (x[1] for x in floats(column)) for n in [m.shape[1]]} == {0: [[]], 1: [[5.0]], 2: [[1.0, 2.0], [3.0, 4.0]]}
