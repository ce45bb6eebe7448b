import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.functions.kernels import derivative, gaussian
from crestline.operators import blocks, scalespace, surface, tiles
from crestline.operators.region import EVERYWHERE, Region
from crestline.plans.detection import detection, detection_of_tiles
from crestline.plans.windowed import Windowed
from crestline.sources import tables

from .test_detection import image, same

FOLDER = "/root/testdata/sf0.001"


def runs(spark, grid, name="im"):
    return spark.createDataFrame([(name, i, 0, [float(x) for x in r]) for i, r in enumerate(grid)], surface.RUN)


def plan_of(df):
    return df._jdf.queryExecution().toString()


GRID = np.random.default_rng(5).normal(size=(43, 31))
GRID[3, 4], GRID[9, 9] = np.nan, np.inf


@pytest.mark.parametrize("t, side", [(0.0, 5), (1.0, 7), (1.0, 16), (2.0, 64)])
def test_tiles_equal_blocks(spark, t, side):
    raw = image(spark, GRID, "a").unionByName(image(spark, GRID[:9] * 3, "b"))
    held = tiles.staged(tiles.from_pixels(raw, side))
    cut = tiles.staged(tiles.from_runs(runs(spark, GRID, "a").unionByName(runs(spark, GRID[:9] * 3, "b")), side))
    same(tiles.to_pixels(held), raw, 52 * 31)
    same(tiles.to_pixels(cut), raw, 52 * 31)
    found = blocks.edges_by_blocks(raw, t, "A", 0.5)
    n = found.count()
    halo = gaussian(t).ofs + 3 if t else 3
    if halo > side:
        with pytest.raises(Exception, match="smaller than the"):
            tiles.edges(held, t).collect()
        return
    same(tiles.edges(held, t, "A", 0.5), found, n)
    same(tiles.edges(cut, t, "A", 0.5), found, n)
    im = surface.filled(raw, 0.5)
    held = tiles.staged(tiles.from_pixels(im, side))
    planes = ("v", "dx", "dy", "dxx", "dyy", "dxy")
    same(tiles.to_pixels(tiles.derivatives(held, t), *planes), blocks.derivatives(im, t), 52 * 31)
    same(tiles.to_pixels(tiles.filtered(held, gaussian(t), ("cols",))), blocks.filtered(im, gaussian(t), ("cols",)), 52 * 31)
    for metric in "AMN":
        same(tiles.to_pixels(tiles.metrics(held, t, metric), "v", "l1", "l2", "lp", "lpp", "r"), blocks.metrics_by_blocks(im, t, metric), 52 * 31)


def test_only_strips_are_exchanged(spark):
    grid = np.random.default_rng(1).normal(size=(96, 96))
    held = tiles.staged(tiles.from_runs(runs(spark, grid), 32))
    plan = plan_of(tiles.edges(held, 1.0))
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Exchange") == 1 and "FlatMapCoGroupsInArrow" in physical
    sent = tiles.strips(held, 4).filter("tr < 3 and tc < 3").agg(F.sum(F.size("v"))).first()[0]
    assert sent <= 4 * 4 / 32 * 96 * 96


def test_sparse_and_ragged_runs(spark):
    some = spark.createDataFrame([("a", 0, 3, [1.0, None, 2.0]), ("a", 2, 6, [4.0]), ("a", 2, 0, []), ("b", 9, 0, [7.0] * 9)], surface.RUN)
    got = {(r.image_id, r.row, r.col): r.v for r in tiles.to_pixels(tiles.from_runs(some, 4)).collect() if not np.isnan(r.v)}
    assert got == {("a", 0, 3): 1.0, ("a", 0, 5): 2.0, ("a", 2, 6): 4.0, **{("b", 9, c): 7.0 for c in range(9)}}
    assert tiles.from_runs(some.limit(0)).count() == 0


def test_detection_and_sizes_of_tiles(spark):
    raw = image(spark, np.nan_to_num(GRID, posinf=1.0))
    a, b = detection(raw, 1.0), detection(raw, [2.0, 1.0], plan="tiles")
    assert a.dims.collect() == b.dims.collect()
    same(a.points(), b.points(), a.points().count())
    with pytest.raises(ValueError):
        detection_of_tiles(tiles.staged(tiles.from_pixels(raw)), metric="X")
    some = tiles.clipped(tiles.from_pixels(raw, 8), Region(rows=(9, 17)), 8)
    assert sorted({r.tr for r in some.collect()}) == [1, 2]


SCALES = [1.0, 0.34, 2.0, 1.01]


def windowed(spark, grid=GRID):
    return Windowed(lambda region: region.of(image(spark, np.nan_to_num(grid, posinf=1.0))))


@pytest.mark.parametrize("region", [Region(), Region((5, 9)), Region((0, 3), (28, 31)), Region((40, 90), (7, 8)), Region((4, 4), (2, 5))])
def test_regions_give_the_rows_of_the_whole(spark, region):
    w = windowed(spark)
    for whole in (w.smoothed(1.0), w.derivatives(1.0), w.metrics(1.0).smoothed(0.5), w.edges(1.0, "M"), w.filtered(gaussian(1.0), ("rows",)), w.smoothed(0.5).edges(1.0)):
        want = region.of(whole.df())
        same(whole.where(region.rows, region.cols).df(), want, want.count())


@pytest.mark.parametrize("region", [Region(scales=(0, 1)), Region((5, 9), scales=(1, 3)), Region((1, 7), (8, 11), (3, 9)), Region(scales=(2, 2))])
def test_regions_of_scale_spaces(spark, region):
    space = windowed(spark).scale_space(SCALES)
    for whole in (space, space.filtered(derivative(), ("cols", "scale")), space.scale_metrics("A")):
        want = region.of(whole.df())
        same(whole.where(region.rows, region.cols, region.scales).df(), want, want.count())
    want = scalespace.generate(image(spark, np.nan_to_num(GRID, posinf=1.0)), SCALES)
    same(space.section("row", 5).df(), scalespace.section(want, "row", 5), want.filter("row = 5").count())
    same(space.view(3, 4, 5, 6, 1, 2), scalespace.view(want, 3, 4, 5, 6, 1, 2), 60)


def test_regions_reach_the_scan(spark):
    asked = []

    def source(region):
        asked.append(region)
        return tables.emb(spark, FOLDER, region)

    df = Windowed(source).smoothed(1.0).scale_space(SCALES).where((200, 210), (20, 30), (0, 2)).df()
    reach = gaussian(1.0).ofs + sum(k.ofs for k in blocks.scale_kernels(SCALES)[1][:2] if k)
    assert asked == [Region((200 - reach, 210 + reach), (20 - reach, 30 + reach))]
    plan = plan_of(df)
    assert f"GreaterThanOrEqual(vec_id,{200 - reach})" in plan and f"LessThan(vec_id,{210 + reach})" in plan
    assert EVERYWHERE.widened(3) == EVERYWHERE and Region((0, 4)).met(Region((9, 12))).rows == (9, 9)


@pytest.mark.parametrize("name", ["evt", "li"])
def test_grids_of_tables_are_dealt_to_tasks(spark, name):
    whole = tables.SURFACES[name](spark, FOLDER)
    region = Region((3, 9), (5, 8))
    same(tables.SURFACES[name](spark, FOLDER, region), region.of(whole), 18)
    assert "SinglePartition" not in plan_of(whole) and whole.select(F.spark_partition_id()).distinct().count() > 1
