"""Images as dense tiles, whose passes exchange halo strips only.

A tile is one row: (image_id, tr, tc, top, left, height, width, v), v its pixels row by
row as float64 (NaN where a pixel is absent or null).  Tiles are stored bucketed by
(image_id, tr, tc).  A pass that reaches ``halo`` pixels cuts strips off each tile's
sides and corners for its eight neighbours, which shuffles 4 x halo / side of the image;
the tiles themselves stay where their bucket is and meet their strips there.

Passes run in numpy with the term order of the other plans, so results agree bit for bit.
A tile's side is four halos at least.  Passes clamp where the image ends.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.kernels import Kernel, gaussian
from ..plans.staging import stage_buckets
from . import blocks
from .blocks import BLOCK, convolve, edge_table, slopes, smooth
from .detect import EDGE_SCHEMA
from .region import Region

KEYS = ("image_id", "tr", "tc")
_PLACE = "image_id string, tr int, tc int, top int, left int, height int, width int"
SCHEMA = f"{_PLACE}, v array<double>"
_AXIS = {"rows": 1, "cols": 0}


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([a.ravel() for a in arrays]) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(a.size for a in arrays)]).astype(np.int32)), pa.array(flat))


def _row(key: tuple, top: int, left: int, **planes: np.ndarray) -> pa.Table:
    height, width = next(iter(planes.values())).shape
    place = dict(zip(("tr", "tc", "top", "left", "height", "width"), (*key[1:], top, left, height, width)))
    columns = {"image_id": pa.array([key[0]], pa.string()), **{n: pa.array([x], pa.int32()) for n, x in place.items()}}
    return pa.table(columns | {n: _lists([a]) for n, a in planes.items()})


def _key(table: pa.Table) -> tuple:
    return tuple(table[k][0].as_py() for k in KEYS)


def from_runs(runs: DataFrame, side: int = BLOCK) -> DataFrame:
    """Tiles of (image_id, row, left, v) stretches, which are cut where tiles meet."""
    first, last = F.col("left"), F.col("left") + F.size("v") - 1
    tile = lambda x: F.floor(x / side).cast("int")
    cut = runs.filter(F.size("v") > 0).select("*", tile(F.col("row")).alias("tr"), F.explode(F.sequence(tile(first), tile(last))).alias("tc"))
    begin, end = F.greatest(first, F.col("tc") * side), F.least(last, F.col("tc") * side + side - 1)
    cut = cut.select(*KEYS, "row", begin.alias("left"), F.slice("v", begin - first + 1, end - begin + 1).alias("v"))

    def run(table: pa.Table) -> pa.Table:
        row, left = (table[c].to_numpy().astype(np.int64) for c in ("row", "left"))
        lists = table["v"].combine_chunks()
        size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
        top, start = row.min(), left.min()
        out = np.full((row.max() - top + 1, (left + size).max() - start), np.nan)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(row - top, size), np.repeat(left - start, size) + at] = flat
        return _row(_key(table), int(top), int(start), v=out)

    return cut.groupBy(*KEYS).applyInArrow(run, SCHEMA)


def from_pixels(surface: DataFrame, side: int = BLOCK) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        row, col = (table[c].to_numpy().astype(np.int64) for c in ("row", "col"))
        top, left = row.min(), col.min()
        out = np.full((row.max() - top + 1, col.max() - left + 1), np.nan)
        out[row - top, col - left] = table["v"].to_numpy(zero_copy_only=False)
        return _row(_key(table), int(top), int(left), v=out)

    tile = lambda x: F.floor(F.col(x) / side).cast("int")
    return surface.select("image_id", tile("row").alias("tr"), tile("col").alias("tc"), "row", "col", "v").groupBy(*KEYS).applyInArrow(run, SCHEMA)


def to_pixels(tiles: DataFrame, *planes: str) -> DataFrame:
    """(image_id, row, col) and a column of each plane, ``v`` unless others are named."""
    planes = planes or ("v",)
    one = F.arrays_zip(*[F.col(p) for p in planes])
    out = tiles.select("image_id", "top", "left", "width", F.posexplode(one).alias("at", "x"))
    row, col = F.expr("cast(top + at div width as int)"), (F.col("left") + F.col("at") % F.col("width")).cast("int")
    return out.select("image_id", row.alias("row"), col.alias("col"), *[F.col(f"x.{p}").alias(p) for p in planes])


def staged(tiles: DataFrame) -> DataFrame:
    """The tiles as a table bucketed by their place, from where passes need not move them."""
    return stage_buckets(tiles, "tiles", KEYS)


def dims(tiles: DataFrame) -> DataFrame:
    """(image_id, rows, cols), from the tiles' places alone."""
    return tiles.groupBy("image_id").agg(F.max(F.col("top") + F.col("height")).alias("rows"), F.max(F.col("left") + F.col("width")).alias("cols"))


def clipped(tiles: DataFrame, region: Region, side: int = BLOCK) -> DataFrame:
    """The tiles that a region touches."""
    touched = lambda r: r and (r[0] // side, -(-r[1] // side))
    return tiles.filter(Region(touched(region.rows), touched(region.cols)).condition(F.col("tr"), F.col("tc")))


def strips(tiles: DataFrame, halo: int) -> DataFrame:
    """What each tile gives its neighbours: places (tr, tc) of theirs, pixels of its own."""

    def given(dr: int, dc: int) -> Column:
        span = lambda size, d: (F.lit(0), F.least(size, F.lit(halo))) if d < 0 else (F.greatest(F.lit(0), size - halo), size) if d else (F.lit(0), size)
        (r0, r1), (c0, c1) = span(F.col("height"), dr), span(F.col("width"), dc)
        rows = F.transform(F.sequence(r0, r1 - 1), lambda r: F.slice("v", r * F.col("width") + c0 + 1, c1 - c0))
        body = F.slice("v", r0 * F.col("width") + 1, (r1 - r0) * F.col("width")) if not dc else F.flatten(rows)
        return F.struct(
            (F.col("tr") + dr).alias("tr"), (F.col("tc") + dc).alias("tc"), (F.col("top") + r0).alias("top"), (F.col("left") + c0).alias("left"),
            (r1 - r0).alias("height"), (c1 - c0).alias("width"), body.alias("v"),
        )

    around = [given(dr, dc) for dr, dc in product((-1, 0, 1), repeat=2) if dr or dc]
    out = tiles.select("image_id", F.inline(F.array(*around)))
    return out.filter("tr >= 0 and tc >= 0")


Met = Callable[[tuple, np.ndarray, int, int, tuple[int, int, int, int]], pa.Table]
"""(key, grid with halo, its top, its left, the tile's own top, bottom, left, right) to rows."""


def met(tiles: DataFrame, halo: int, run: Met, schema: str) -> DataFrame:
    """``run`` for every tile, laid out with the strips of its neighbours."""

    def both(tile: pa.Table, around: pa.Table) -> pa.Table:
        if not tile.num_rows:  # a strip over the edge of the image
            return nothing
        places = [{n: t[n][i].as_py() for n in ("top", "left", "height", "width")} for t in (tile, around) for i in range(t.num_rows)]
        top, left = (min(p[n] for p in places) for n in ("top", "left"))
        bottom, right = (max(p[a] + p[b] for p in places) for a, b in (("top", "height"), ("left", "width")))
        grid = np.full((bottom - top, right - left), np.nan)
        lists = [t["v"].chunk(k)[i].values for t in (tile, around) for k in range(t["v"].num_chunks) for i in range(len(t["v"].chunk(k)))]
        for p, v in zip(places, lists):
            r, c = p["top"] - top, p["left"] - left
            grid[r : r + p["height"], c : c + p["width"]] = v.to_numpy(zero_copy_only=False).reshape(p["height"], p["width"])
        own = places[0]
        for p in places[1:]:
            if (p["top"] + p["height"] == own["top"] and p["height"] < halo) or (p["left"] + p["width"] == own["left"] and p["width"] < halo):
                raise ValueError(f"tiles are smaller than the {halo} pixels that the passes reach")
        return run(_key(tile), grid, top, left, (own["top"], own["top"] + own["height"], own["left"], own["left"] + own["width"]))

    nothing = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return tiles.groupBy(*KEYS).cogroup(strips(tiles, halo).groupBy(*KEYS)).applyInArrow(both, schema)


def edges(tiles: DataFrame, t: float = 0.0, metric: str = "N", fill: float = 0.0, literal: bool = False) -> DataFrame:
    """Edges of raw tiles; ``literal``: in the arithmetic of 32-bit floats."""
    kernel = gaussian(t)
    halo = (kernel.ofs if kernel else 0) + 3
    return met(tiles, halo, lambda key, grid, top, left, own: edge_table(key[0], grid, top, left, t, metric, fill, own, literal), EDGE_SCHEMA)


Passes = Callable[[np.ndarray], dict[str, np.ndarray]]


def planes(tiles: DataFrame, halo: int, passes: Passes, made: tuple[str, ...]) -> DataFrame:
    """The tiles with the planes that ``passes`` makes of a grid, in place of ``v``."""

    def run(key: tuple, grid: np.ndarray, top: int, left: int, own: tuple[int, int, int, int]) -> pa.Table:
        inside = np.s_[own[0] - top : own[1] - top, own[2] - left : own[3] - left]
        new = passes(grid)
        return _row(key, own[0], own[2], **{n: new[n][inside] for n in made})

    return met(tiles, halo, run, _PLACE + "".join(f", {n} array<double>" for n in made))


def filtered(tiles: DataFrame, kernel: Kernel | None, axes: tuple[str, ...] = ("rows", "cols")) -> DataFrame:
    if not kernel or not axes:
        return tiles

    def passes(v: np.ndarray) -> dict[str, np.ndarray]:
        for axis in axes:
            v = convolve(v, kernel, _AXIS[axis])
        return {"v": v}

    return planes(tiles, kernel.ofs, passes, ("v",))


def derivatives(tiles: DataFrame, t: float = 0.0) -> DataFrame:
    """dx, dy, dxx, dyy, dxy beside v, of the tiles smoothed by ``t``."""
    kernel = gaussian(t)

    def passes(v: np.ndarray) -> dict[str, np.ndarray]:
        v = smooth(v, kernel)
        return {"v": v, **slopes(v)}

    return planes(tiles, (kernel.ofs if kernel else 0) + 2, passes, ("v", "dx", "dy", "dxx", "dyy", "dxy"))


def metrics(tiles: DataFrame, t: float, metric: str = "N", fill: float = 0.0) -> DataFrame:
    """l1, l2, lp, lpp, r beside v, of raw tiles filled and smoothed by ``t``."""
    kernel = gaussian(t)

    def passes(v: np.ndarray) -> dict[str, np.ndarray]:
        v = smooth(np.where(np.isfinite(v), v, fill), kernel)
        return {"v": v, **blocks.metrics(v, t, metric)}

    return planes(tiles, (kernel.ofs if kernel else 0) + 2, passes, ("v", "l1", "l2", "lp", "lpp", "r"))
