"""Scale space: smoothed planes (image_id, scale_idx, scale, row, col, v).

Generation, in-plane filters and metrics have two plans with equal results: "blocks"
(one shuffle of halo blocks, the default) and "windows" (SQL windows).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import derivative
from ..functions.scales import sorted_distinct, to_thirds
from . import blocks
from .stencil import along, convolved, filter_surface, metrics, smoothed


def generate(surface: DataFrame, scales: list[float], plan: str = "blocks") -> DataFrame:
    """Plane i is plane i-1 smoothed by the difference of their scales (rounded to 1/3)."""
    return {"blocks": blocks.scale_space, "windows": _generate}[plan](surface, scales)


def _generate(surface: DataFrame, scales: list[float]) -> DataFrame:
    planes, plane, last = [], surface, 0.0
    for i, s in enumerate(sorted_distinct(to_thirds(scales))):
        plane = smoothed(plane, s - last)
        last = s
        planes.append(plane.select("image_id", F.lit(i).alias("scale_idx"), F.lit(float(s)).alias("scale"), "row", "col", "v"))
    return reduce(DataFrame.unionByName, planes)


def section(space: DataFrame, axis: str, offset: int) -> DataFrame:
    """A planar cut: axis "scale" gives a surface, "row" and "col" cut across the scales."""
    key = {"scale": "scale_idx", "row": "row", "col": "col"}[axis]
    return space.filter(F.col(key) == offset)


def view(space: DataFrame, top: int, left: int, height: int, width: int, first: int = 0, scales: int | None = None) -> DataFrame:
    inside = F.col("row").between(top, top + height - 1) & F.col("col").between(left, left + width - 1) & (F.col("scale_idx") >= first)
    if scales is not None:
        inside &= F.col("scale_idx") < first + scales
    return space.filter(inside).withColumns({"row": F.col("row") - top, "col": F.col("col") - left, "scale_idx": F.col("scale_idx") - first})


def filter_space(space: DataFrame, kernel, axes: tuple[str, ...], plan: str = "blocks") -> DataFrame:
    """In-plane passes first, then along the scales (alone, a window of one pixel's few planes)."""
    ordered = tuple(a for a in ("rows", "cols", "scale") if a in axes)
    if plan == "windows" or ordered == ("scale",):
        return filter_surface(space, kernel, ordered)
    return blocks.filtered(space, kernel, ordered)


def scale_metrics(space: DataFrame, metric: str = "N", plan: str = "blocks") -> DataFrame:
    """lp, lpp, r of every plane, and the first and second derivative of r along the scales."""
    return {"blocks": blocks.scale_metrics, "windows": _scale_metrics}[plan](space, metric)


def _scale_metrics(space: DataFrame, metric: str) -> DataFrame:
    scales = [(r[0], r[1]) for r in space.select("scale_idx", "scale").distinct().orderBy("scale_idx").collect()]  # one row per scale
    planes = [metrics(space.filter(F.col("scale_idx") == i).drop("scale"), s, metric).withColumn("scale", F.lit(s)) for i, s in scales]
    m = reduce(DataFrame.unionByName, planes)
    w = along(m, "scale")
    m = m.withColumn("dr", convolved(F.col("r"), derivative(), w)).withColumn("ddr", convolved(F.col("dr"), derivative(), w))
    return m.select("image_id", "scale_idx", "scale", "row", "col", "lp", "lpp", "r", "dr", "ddr")
