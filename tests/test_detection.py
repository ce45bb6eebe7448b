import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.operators import lines as L
from crestline.functions.kernels import derivative, gaussian
from crestline.operators import blocks, scalespace, stencil, surface
from crestline.operators.blocks import edges_by_blocks
from crestline.operators.detect import EDGE_SCHEMA, edges_by_windows
from crestline.plans.detection import detection


def image(spark, grid, name="im"):
    rows = [(name, i, j, float(v)) for i, r in enumerate(grid) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, surface.SCHEMA)


def bar(vertical):
    a = np.zeros((5, 5))
    a[:, 2] = 1
    return a if vertical else a.T


def test_vertical_bar(spark):
    d = detection(image(spark, bar(True)))
    got = [tuple(r) for r in d.points().orderBy("entry_id").select("row_fx", "col_fx", "brightness", "strength").collect()]
    assert got == [(128 * r, 256, 1.0, 0.0) for r in range(5)]
    assert d.segments().count() == 4
    lines = d.lines().collect()
    assert len(lines) == 1 and [(p.row_fx, p.col_fx) for p in lines[0].points] == [(128 * r, 256) for r in range(5)]
    strong = detection(image(spark, bar(True)), 0.125)
    assert strong.points().select("strength").distinct().first()[0] == 2.0**-16


def test_horizontal_bar_keeps_the_tie_rule(spark):
    assert detection(image(spark, bar(False))).points().count() == 0
    d = detection(image(spark, bar(False)), 1 / 3)
    assert sorted((r.row_fx, r.col_fx) for r in d.points().collect()) == [(256, 128 * c) for c in range(5)]
    assert d.segments().count() == 4 and d.lines().count() == 1


@pytest.mark.parametrize("metric, t, block", [("N", 0.0, 7), ("M", 1 / 3, 64), ("A", 2.0, 16)])
def test_both_plans_agree(spark, metric, t, block):
    grid = np.random.default_rng(5).normal(size=(23, 31)).astype(np.float32)
    grid[3, 4], grid[9, 9] = np.nan, np.inf
    im = image(spark, grid)
    a = edges_by_windows(im, t, metric, 0.5).collect()
    b = edges_by_blocks(im, t, metric, 0.5, block).collect()
    key = lambda r: (r.row, r.col, r.dir, r.d, repr(r.brightness), repr(r.strength))
    assert len(a) > 20 and sorted(map(key, a)) == sorted(map(key, b))


def same(a, b, n):
    """Equal rows, to the last bit of every double."""
    assert sorted(a.columns) == sorted(b.columns)
    a, b = (sorted(map(repr, df.select(*sorted(df.columns)).collect())) for df in (a, b))
    assert len(a) == n and a == b


@pytest.mark.parametrize("t, block", [(0.0, 7), (1.0, 5), (2.0, 64)])
def test_stencils_by_blocks_equal_windows(spark, t, block):
    grid = np.random.default_rng(6).normal(size=(23, 11))
    grid[3, 4], grid[9, 9] = np.nan, np.inf
    raw = image(spark, grid, "a").unionByName(image(spark, grid[:9] * 3, "b"))
    im, n = surface.filled(raw, 0.5), 32 * 11
    same(blocks.smoothed(im, t, block), stencil.smoothed(im, t), n)
    same(blocks.derivatives(im, t, block), stencil.derivatives(stencil.smoothed(im, t)), n)
    for metric in "AMN":
        same(blocks.metrics_by_blocks(raw, t, metric, 0.5, block), stencil.metrics(stencil.smoothed(im, t), t, metric), n)
    same(blocks.filtered(im, gaussian(t, sampled=True), ("cols",), block), stencil.filter_surface(im, gaussian(t, sampled=True), ("cols",)), n)


def test_missing_and_null_pixels_by_blocks(spark):
    im = image(spark, np.ones((4, 4))).filter("row <> 1 or col <> 2").withColumn("v", F.expr("if(row = 3 and col = 3, null, v)"))
    got = {(r.row, r.col): r.v for r in blocks.smoothed(im, 1 / 3).collect()}
    assert len(got) == 15 and (1, 2) not in got
    assert np.isnan(got[1, 1]) and np.isnan(got[3, 3]) and got[3, 0] == pytest.approx(1)


def test_blocks_grow_with_the_halo():
    assert blocks.side(6) == 256 and blocks.side(303) == 1212
    assert all((1 + 2 * h / blocks.side(h)) ** 2 <= 2.25 for h in range(3, 2000))


def test_unknown_choices(spark):
    with pytest.raises(ValueError):
        detection(image(spark, bar(True)), metric="X")
    with pytest.raises(ValueError):
        detection(image(spark, bar(True))).entries("blobs")


def edges(spark, cells, rows=9, cols=9):
    """Edges that give cells the flags asked for; each edge lies in the middle."""
    found = set()
    for (r, c), flags in cells.items():
        for bit, e in ((1, (r, c, "N")), (2, (r, c, "W")), (4, (r + 1, c, "N")), (8, (r, c + 1, "W"))):
            if flags & bit:
                found.add(e)
    df = spark.createDataFrame([("im", r, c, d, 64, 1.0, 1.0) for r, c, d in sorted(found)], EDGE_SCHEMA)
    return df, spark.createDataFrame([("im", rows, cols)], "image_id string, rows int, cols int")


def places(line):
    return [(p.row_fx, p.col_fx) for p in line.points]


def test_open_path(spark):
    got = L.lines(*edges(spark, {(0, 0): 10, (0, 1): 6, (1, 1): 5})).collect()
    assert [places(x) for x in got] == [[(64, 0), (64, 128), (128, 192), (256, 192)]]


def test_loop(spark):
    got = L.lines(*edges(spark, {(0, 0): 12, (0, 1): 6, (1, 0): 9, (1, 1): 3})).collect()
    assert len(got) == 1 and len(got[0].points) == 5
    p = places(got[0])
    assert p[0] == p[-1] == (64, 128) and p[1] == (128, 64)  # first step south


def test_three_sided_cell_breaks(spark):
    got = L.lines(*edges(spark, {(0, 0): 10, (0, 1): 14, (0, 2): 10})).orderBy("entry_id").collect()
    assert [len(x.points) for x in got] == [2, 2] and [x.entry_id for x in got] == [0, 1]


@pytest.mark.parametrize("block", [1, 2, 5, 256])
def test_lines_do_not_depend_on_blocks(spark, monkeypatch, block):
    grid = np.random.default_rng(8).normal(size=(40, 40))
    d = detection(image(spark, grid, "a").unionByName(image(spark, grid.T[:9], "b")), 1.0)
    whole = sorted(map(repr, d.lines().collect()))
    monkeypatch.setattr(L, "BLOCK", block)
    got = d.lines().collect()
    assert sorted(map(repr, got)) == whole and len(got) > 20
    if block == 1:  # nothing is contracted: doubling alone
        ends = [(places(x)[0], places(x)[-1]) for x in got]
        assert any(a == b for a, b in ends) and any(a != b for a, b in ends)


def test_lines_match_a_walk(spark):
    grid = np.random.default_rng(8).normal(size=(40, 40))
    d = detection(image(spark, grid), 1.0)
    segs = d.segments().collect()
    lines = d.lines().collect()
    near = {}
    for s in segs:
        a, b = (s.start.row_fx, s.start.col_fx), (s.end.row_fx, s.end.col_fx)
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    steps = sorted(tuple(sorted(x)) for ln in lines for x in zip(places(ln), places(ln)[1:]))
    assert steps == sorted(tuple(sorted(((s.start.row_fx, s.start.col_fx), (s.end.row_fx, s.end.col_fx)))) for s in segs)
    assert any(places(x)[0] == places(x)[-1] for x in lines) or len(lines) > 10
    for ln in lines:
        p = places(ln)
        assert p[0] == p[-1] or (len(near[p[0]]) == 1 or near[p[0]].count(p[1]) == 1)


def test_empty_surface(spark):
    d = detection(spark.createDataFrame([], surface.SCHEMA), 1.0)
    assert d.points().count() == d.segments().count() == d.lines().count() == 0


def test_two_images_stay_apart(spark):
    both = image(spark, bar(True), "a").unionByName(image(spark, bar(True), "b"))
    got = detection(both).points().groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.max("entry_id").alias("m")).collect()
    assert sorted(tuple(r) for r in got) == [("a", 5, 4), ("b", 5, 4)]
    assert detection(both).lines().count() == 2


def test_clip_transpose_fill(spark):
    im = image(spark, np.arange(12).reshape(3, 4))
    got = {(r.row, r.col): r.v for r in surface.clipped(im, 1, 2, 2, 2).collect()}
    assert got == {(0, 0): 6, (0, 1): 7, (1, 0): 10, (1, 1): 11}
    assert {(r.row, r.col): r.v for r in surface.transposed(im).collect()}[(3, 2)] == 11
    holes = image(spark, [[np.nan, np.inf, -np.inf, 1.0]])
    assert [r.v for r in surface.filled(holes).orderBy("col").collect()] == [0, 0, 0, 1]


def test_scale_space(spark):
    im = image(spark, np.random.default_rng(1).normal(size=(6, 6)))
    space = scalespace.generate(im, [0.0, 1.0, 0.34, 1.01])
    assert [tuple(r) for r in space.select("scale_idx", "scale").distinct().orderBy("scale_idx").collect()] == [(0, 0.0), (1, 1 / 3), (2, 1.0)]
    first = {(r.row, r.col): r.v for r in scalespace.section(space, "scale", 0).collect()}
    assert first == {(r.row, r.col): r.v for r in im.collect()}
    assert scalespace.view(space, 1, 1, 2, 3, 1).count() == 12
    assert scalespace.scale_metrics(space).count() == 108
    assert stencil.filter_surface(im, None).columns == im.columns


def test_scale_space_by_blocks_equals_windows(spark):
    im = image(spark, np.random.default_rng(2).normal(size=(19, 8)))
    scales = [0.34, 1.0, 2.0]
    space, windows = scalespace.generate(im, scales), scalespace.generate(im, scales, "windows")
    same(space, windows, 3 * 152)
    same(blocks.scale_space(im, scales, 5), windows, 3 * 152)
    for metric in "AMN":
        same(scalespace.scale_metrics(space, metric), scalespace.scale_metrics(space, metric, "windows"), 3 * 152)
    same(blocks.scale_metrics(space, "N", 4), scalespace.scale_metrics(space, "N", "windows"), 3 * 152)
    for axes in (("scale",), ("rows", "scale"), ("rows", "cols", "scale"), ("cols",)):
        same(scalespace.filter_space(space, derivative(), axes), scalespace.filter_space(space, derivative(), axes, "windows"), 3 * 152)
    upper = scalespace.view(space, 0, 0, 19, 8, 1)
    assert scalespace.filter_space(upper, derivative(), ("rows", "scale")).count() == 2 * 152


def test_stencils_of_an_empty_surface(spark):
    none = spark.createDataFrame([], surface.SCHEMA)
    assert blocks.metrics_by_blocks(none, 1.0).count() == blocks.derivatives(none).count() == scalespace.generate(none, [1.0]).count() == 0
