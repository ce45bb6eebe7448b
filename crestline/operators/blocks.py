"""The fused stencil: one exchange for all passes over an image.

Every pixel goes to the blocks whose halo holds it (as far as the passes reach: N for
smoothing, two for derivatives, one for the neighbour of an edge); a block is one dense
array, so all passes run in numpy without another shuffle, and the number of tasks
grows with the pixels, whatever the shape of the image.  Values are float64 and every
sum has the window plan's term order, so both plans agree bit for bit.

Surfaces may have several planes (scale_idx, and scale where a pass needs it), which
travel together.  A null value counts as NaN; pixels that are absent from a grid which
should be dense are read as NaN and not made up in the result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.algebra import finite_or
from ..functions.kernels import Kernel, derivative, gaussian
from ..functions.scales import sorted_distinct, to_thirds
from .detect import EDGE_SCHEMA
from .region import Range

BLOCK = 256
_AXIS = {"scale": 0, "rows": 2, "cols": 1}


def side(halo: int) -> int:
    """Side of a block: four halos at least, so that no pixel is sent more than 2.25 times on average."""
    return max(BLOCK, 4 * halo)


def convolve(a: np.ndarray, kernel: Kernel, axis: int) -> np.ndarray:
    n, reach = a.shape[axis], kernel.ofs
    wide = np.pad(a, [(reach, reach) if k == axis % a.ndim else (0, 0) for k in range(a.ndim)], mode="edge")
    at = [slice(None)] * a.ndim
    out = None
    for by, weight in kernel.terms():
        at[axis] = slice(reach + by, reach + by + n)
        term = weight * wide[tuple(at)]
        out = term if out is None else out + term
    return out


def eigen(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """l1, l2, c, s: the rotation of algebra.eigen."""
    b = np.where(np.isnan(b), 0.0, b)
    b = np.where(np.abs(b) < 2.0**-23 * (np.abs(a) + np.abs(d)), 0.0, b)
    with np.errstate(all="ignore"):
        half = (a - d) / 2.0
        h = np.sqrt(half * half + b * b)
        far = b * b / (h + np.abs(half))
        x = np.where(half <= 0.0, far, -far)
        steep = np.abs(b) > np.abs(x)
        q = np.where(steep, -x / b, -b / x)
        r = 1.0 / np.sqrt(1.0 + q * q)
        flat = b == 0.0
        c = np.where(flat, 1.0, np.where(steep, r * q, r))
        s = np.where(flat, 0.0, np.where(steep, r, r * q))
        cross = 2.0 * (c * s) * b
        l1 = np.where(flat, a, (c * c * a - cross) + s * s * d)
        l2 = np.where(flat, d, (s * s * a + cross) + c * c * d)
    return l1, l2, c, s


def eigen_literal(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """l1, l2, c, s: the rotation of algebra.eigen_literal, in 32-bit floats."""
    a, b, d = (np.asarray(x, np.float32) for x in (a, b, d))
    b = np.where(np.isnan(b) | (np.abs(b) < np.float32(2.0**-23) * (np.abs(a) + np.abs(d))), np.float32(0), b)
    with np.errstate(all="ignore"):
        half = (a - d) * np.float32(0.5)
        h = np.sqrt(half.astype(np.float64) ** 2 + b.astype(np.float64) ** 2).astype(np.float32)
        by = b * (b / np.where(half < 0, half + h, h - half))
        mu = np.where(half == 0, d - np.abs(b), np.where(half < 0, d - by, d + by))
        mu = np.where(np.float32(2.0**-23) * np.abs(mu) > np.abs(a) + np.abs(b), np.float32(0), mu)
        x = a - mu
        steep = np.abs(b) > np.abs(x)
        q = np.where(steep, -x / b, -b / x)
        r = np.float32(1) / np.sqrt(np.float32(1) + q * q)
        flat = b == 0
        c = np.where(flat, np.float32(1), np.where(steep, r * q, r))
        s = np.where(flat, np.float32(0), np.where(steep, r, r * q))
        p, o, u, w = c * a - s * b, s * a + c * b, c * b - s * d, s * b + c * d
        return np.where(flat, a, p * c - u * s), np.where(flat, d, o * s + w * c), c, s


def smooth(v: np.ndarray, kernel: Kernel | None) -> np.ndarray:
    return convolve(convolve(v, kernel, -1), kernel, -2) if kernel else v


def slopes(v: np.ndarray) -> dict[str, np.ndarray]:
    """dx, dy, dxx, dyy, dxy: each pass clamps by itself; dxy runs down the columns of dx."""
    diff = derivative()
    dx, dy = convolve(v, diff, -1), convolve(v, diff, -2)
    return {"dx": dx, "dy": dy, "dxx": convolve(dx, diff, -1), "dyy": convolve(dy, diff, -2), "dxy": convolve(dx, diff, -2)}


def metrics(v: np.ndarray, t: float | np.ndarray, metric: str) -> dict[str, np.ndarray]:
    """l1, l2, lp, lpp, r of a filled and smoothed surface; ``t`` may differ by plane.

    A surface of 32-bit floats is worked on in their arithmetic, with the literal shift.
    """
    d = slopes(v)
    dx, dy = d["dx"], d["dy"]
    l1, l2, c, s = (eigen_literal if v.dtype == np.float32 else eigen)(d["dyy"], d["dxy"], d["dxx"])
    first = np.abs(l1) > np.abs(l2)
    lpp = np.where(first, l1, l2)
    lp = np.where(first, c * dy + (-s) * dx, s * dy + c * dx)
    if metric == "M":
        r = t * np.fmax(np.abs(l1), np.abs(l2))
    elif metric == "N":
        d = l1 * l1 - l2 * l2
        r = ((t * t) * (t * t)) * d * d
    elif metric == "A":
        d = l1 - l2
        r = (t * t) * (d * d)
    else:
        raise ValueError(f"metric must be A, M or N, not {metric!r}")
    return {"l1": l1, "l2": l2, "lp": lp, "lpp": lpp, "r": r}


def crossings(lp: np.ndarray, lpp: np.ndarray, axis: int) -> np.ndarray:
    """Place of the crossing in 1/128 pixel towards the next pixel, -1 for none."""
    one, two = (slice(None, -1), slice(1, None))
    cut = (lambda a, s: a[s]) if axis == 0 else (lambda a, s: a[:, s])
    p, q, a, b = cut(lp, one), cut(lp, two), cut(lpp, one), cut(lpp, two)
    with np.errstate(all="ignore"):
        x = p / (p - q)
        ok = ~np.isnan(p) & ~np.isnan(q) & ((p > 0) == (q <= 0))
        ok &= ~((1.0 - x) * a + x * b > 0)
        return np.where(ok, np.rint(np.where(ok, x, 0) * 128.0), -1).astype(np.int64)


def edge_table(image_id: str, grid: np.ndarray, top: int, left: int, t: float, metric: str, fill: float, own: tuple[int, int, int, int], literal: bool = False) -> pa.Table:
    """Edges of the pixels in ``own`` (top, bottom, left, right) of a raw grid whose first pixel is (top, left).

    ``literal``: in the arithmetic of 32-bit floats.
    """
    grid = grid.astype(np.float32) if literal else grid
    made = metrics(smooth(np.where(np.isfinite(grid), grid, fill), gaussian(t)), t, metric)
    lp, lpp, r = made["lp"], made["lpp"], made["r"]
    out = []
    for dir_, axis in (("N", 1), ("W", 0)):
        d = crossings(lp, lpp, axis)
        i, j = np.nonzero(d >= 0)
        mine = (i + top >= own[0]) & (i + top < own[1]) & (j + left >= own[2]) & (j + left < own[3])
        i, j = i[mine], j[mine]
        at = d[i, j] / 128.0
        i2, j2 = (i, j + 1) if axis else (i + 1, j)
        mean = lambda z: (1.0 - at) * z[i, j] + at * z[i2, j2]  # noqa: B023, E731
        out.append((i + top, j + left, np.full(len(i), dir_), d[i, j], mean(grid), mean(r)))
    row, col, dir_, d, bright, strong = (np.concatenate(x) for x in zip(*out))
    return pa.table(
        {
            "image_id": pa.array([image_id] * len(row), pa.string()),
            "row": pa.array(row.astype(np.int32)),
            "col": pa.array(col.astype(np.int32)),
            "dir": pa.array(dir_.astype(object), pa.string()),
            "d": pa.array(d.astype(np.int32)),
            "brightness": pa.array(bright.astype(np.float64)),
            "strength": pa.array(strong.astype(np.float64)),
        }
    )


def _block(t: float, metric: str, fill: float, block: int, literal: bool = False):
    def run(table: pa.Table) -> pa.Table:
        row, col, raw = (table[c].to_numpy() for c in ("row", "col", "v"))
        br, bc = table["br"][0].as_py(), table["bc"][0].as_py()
        top, left = row.min(), col.min()
        grid = np.full((row.max() - top + 1, col.max() - left + 1), np.nan)
        grid[row - top, col - left] = raw
        return edge_table(table["image_id"][0].as_py(), grid, top, left, t, metric, fill, (br * block, (br + 1) * block, bc * block, (bc + 1) * block), literal)

    return run


def dealt(surface: DataFrame, halo: int, block: int) -> DataFrame:
    """The pixels with the blocks (br, bc) whose halo holds them."""

    def reach(x: str) -> list:
        return [F.floor((F.col(x) - halo) / block).cast("int"), F.floor((F.col(x) + halo) / block).cast("int")]

    spread = surface.select("*", F.explode(F.sequence(*reach("row"))).alias("br")).select("*", F.explode(F.sequence(*reach("col"))).alias("bc"))
    return spread.filter("br >= 0 and bc >= 0")


def edges_by_blocks(surface: DataFrame, t: float = 0.0, metric: str = "N", fill: float = 0.0, block: int | None = None, literal: bool = False) -> DataFrame:
    """Edges of a raw, dense surface from one shuffle of its pixels; ``literal``: in the arithmetic of 32-bit floats."""
    kernel = gaussian(t)
    halo = (kernel.ofs if kernel else 0) + 3
    block = block or side(halo)
    spread = dealt(surface.select("image_id", "row", "col", "v"), halo, block)
    return spread.groupBy("image_id", "br", "bc").applyInArrow(_block(t, metric, fill, block, literal), EDGE_SCHEMA)


Passes = Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]


def by_blocks(surface: DataFrame, halo: int, passes: Passes, made: tuple[str, ...], block: int | None = None) -> DataFrame:
    """The surface's rows with columns ``made``; one of them replaces a column of its name.

    ``passes`` gets a block as an array (plane, row, col) and the scale of every plane
    (NaN without such a column), and gives an array of that shape for each new column.
    """
    block = block or side(halo)
    kept = [c for c in surface.columns if c not in made]
    schema = StructType([*(surface.schema[c] for c in kept), *(StructField(c, DoubleType()) for c in made)])

    def run(table: pa.Table) -> pa.Table:
        row, col = (table[c].to_numpy().astype(np.int64) for c in ("row", "col"))
        names, plane = np.unique(table["scale_idx"].to_numpy(), return_inverse=True) if "scale_idx" in table.column_names else (np.zeros(1), np.zeros(len(row), np.int64))
        top, left = row.min(), col.min()
        cube = np.full((len(names), row.max() - top + 1, col.max() - left + 1), np.nan)
        cube[plane, row - top, col - left] = table["v"].to_numpy()
        scales = np.full(len(names), np.nan)
        if "scale" in table.column_names:
            scales[plane] = table["scale"].to_numpy()
        new = passes(cube, scales)
        own = (row // block == table["br"][0].as_py()) & (col // block == table["bc"][0].as_py())
        places = plane[own], row[own] - top, col[own] - left
        out = table.select(kept).filter(pa.array(own))
        for c in made:
            out = out.append_column(c, pa.array(new[c][places]))
        return out

    return dealt(surface, halo, block).groupBy("image_id", "br", "bc").applyInArrow(run, schema).select(*surface.columns, *[c for c in made if c not in surface.columns])


def reach_of(kernel: Kernel | None) -> int:
    return kernel.ofs if kernel else 0


def filtered(surface: DataFrame, kernel: Kernel | None, axes: tuple[str, ...] = ("rows", "cols"), block: int | None = None) -> DataFrame:
    """``v`` filtered along each axis in turn, "rows", "cols" or "scale"; no kernel or no axis changes nothing."""
    if not kernel or not axes:
        return surface

    def passes(v: np.ndarray, _) -> dict[str, np.ndarray]:
        for axis in axes:
            v = convolve(v, kernel, _AXIS[axis])
        return {"v": v}

    return by_blocks(surface, kernel.ofs if {"rows", "cols"} & set(axes) else 0, passes, ("v",), block)


def smoothed(surface: DataFrame, t: float, block: int | None = None) -> DataFrame:
    return filtered(surface, gaussian(t), block=block)


def derivatives(surface: DataFrame, t: float = 0.0, block: int | None = None) -> DataFrame:
    """dx, dy, dxx, dyy, dxy beside v, of the surface smoothed by ``t``."""
    kernel = gaussian(t)

    def passes(v: np.ndarray, _) -> dict[str, np.ndarray]:
        v = smooth(v, kernel)
        return {"v": v, **slopes(v)}

    return by_blocks(surface, reach_of(kernel) + 2, passes, ("v", "dx", "dy", "dxx", "dyy", "dxy"), block)


def metrics_by_blocks(surface: DataFrame, t: float, metric: str = "N", fill: float = 0.0, block: int | None = None) -> DataFrame:
    """l1, l2, lp, lpp, r beside v, of a raw surface filled and smoothed by ``t``."""
    kernel = gaussian(t)

    def passes(v: np.ndarray, _) -> dict[str, np.ndarray]:
        v = smooth(v, kernel)
        return {"v": v, **metrics(v, t, metric)}

    raw = surface.withColumn("v", finite_or(F.col("v"), fill))
    return by_blocks(raw, reach_of(kernel) + 2, passes, ("v", "l1", "l2", "lp", "lpp", "r"), block)


def scale_kernels(scales: list[float]) -> tuple[list[float], list[Kernel | None]]:
    """The scales rounded, in order, and the kernel from each plane to the next."""
    ordered = [float(s) for s in sorted_distinct(to_thirds(scales))]
    return ordered, [gaussian(b - a) for a, b in pairwise([0.0, *ordered])]


def scale_space(surface: DataFrame, scales: list[float], block: int | None = None, planes: Range = None) -> DataFrame:
    """(image_id, scale_idx, scale, row, col, v): plane i is plane i-1 smoothed by the difference of their scales.

    ``planes`` (half-open) are those returned; none after the last of them is computed.
    """
    ordered, kernels = scale_kernels(scales)
    first, last = planes or (0, len(ordered))
    kernels = kernels[:last]
    names = tuple(f"_v{i}" for i in range(first, len(kernels)))
    if not names:
        return surface.limit(0).select("image_id", F.lit(0).alias("scale_idx"), F.lit(0.0).alias("scale"), "row", "col", "v")

    def passes(v: np.ndarray, _) -> dict[str, np.ndarray]:
        out = {}
        for i, kernel in enumerate(kernels):
            out[f"_v{i}"] = v = smooth(v, kernel)
        return out

    wide = by_blocks(surface.select("image_id", "row", "col", "v"), sum(map(reach_of, kernels)), passes, names, block)
    made = [F.struct(F.lit(i).alias("scale_idx"), F.lit(ordered[i]).alias("scale"), F.col(f"_v{i}").alias("v")) for i in range(first, len(kernels))]
    return wide.select("image_id", "row", "col", F.inline(F.array(*made))).select("image_id", "scale_idx", "scale", "row", "col", "v")


def scale_metrics(space: DataFrame, metric: str = "N", block: int | None = None) -> DataFrame:
    """lp, lpp, r of every plane, and the first and second derivative of r along the scales, in one shuffle."""

    def passes(v: np.ndarray, scales: np.ndarray) -> dict[str, np.ndarray]:
        m = metrics(v, scales[:, None, None], metric)
        m["dr"] = convolve(m["r"], derivative(), 0)
        m["ddr"] = convolve(m["dr"], derivative(), 0)
        return m

    out = by_blocks(space, 2, passes, ("lp", "lpp", "r", "dr", "ddr"), block)
    return out.select("image_id", "scale_idx", "scale", "row", "col", "lp", "lpp", "r", "dr", "ddr")
