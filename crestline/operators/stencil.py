"""Stencils as windows: one exchange per axis, several filters share it.

An axis names the direction a filter runs in: "rows" along a row (over col), "cols"
along a column (over row), "scale" over scale_idx.  Beyond the border the nearest
sample is repeated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.algebra import eigen, strength
from ..functions.kernels import Kernel, derivative, gaussian

_KEYS = ("image_id", "scale_idx", "row", "col")
_ALONG = {"rows": "col", "cols": "row", "scale": "scale_idx"}


def along(df: DataFrame, axis: str) -> WindowSpec:
    over = _ALONG[axis]
    return Window.partitionBy(*[k for k in _KEYS if k in df.columns and k != over]).orderBy(over)


def shifted(v: Column, by: int, w: WindowSpec) -> Column:
    """The sample ``by`` places on, the last one there is beyond the border."""
    if by == 0:
        return v
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.lead(v, by).over(w), F.last(v).over(whole)) if by > 0 else F.coalesce(F.lag(v, -by).over(w), F.first(v).over(whole))


def convolved(v: Column, kernel: Kernel, w: WindowSpec) -> Column:
    return reduce(Column.__add__, [F.lit(weight) * shifted(v, by, w) for by, weight in kernel.terms()])


def filter_surface(surface: DataFrame, kernel: Kernel | None, axes: tuple[str, ...] = ("rows", "cols"), column: str = "v") -> DataFrame:
    """``column`` filtered along each axis in turn; no kernel or no axis changes nothing."""
    for axis in axes if kernel else ():
        surface = surface.withColumn(column, convolved(F.col(column), kernel, along(surface, axis)))
    return surface


def smoothed(surface: DataFrame, t: float) -> DataFrame:
    return filter_surface(surface, gaussian(t))


def derivatives(surface: DataFrame) -> DataFrame:
    """dx, dy, dxx, dyy, dxy: each pass clamps by itself; dxy runs down the columns of dx."""
    d = derivative()
    rows = along(surface, "rows")
    out = surface.withColumn("dx", convolved(F.col("v"), d, rows)).withColumn("dxx", convolved(F.col("dx"), d, rows))
    cols = along(surface, "cols")
    out = out.withColumns({"dy": convolved(F.col("v"), d, cols), "dxy": convolved(F.col("dx"), d, cols)})
    return out.withColumn("dyy", convolved(F.col("dy"), d, cols))


def metrics(surface: DataFrame, t: float, metric: str = "N") -> DataFrame:
    """l1, l2, lp, lpp, r beside v, of a surface already smoothed."""
    out = derivatives(surface).withColumn("e", eigen(F.col("dyy"), F.col("dxy"), F.col("dxx")))
    first = F.abs(F.col("e.l1")) > F.abs(F.col("e.l2"))
    lpp = F.when(first, F.col("e.l1")).otherwise(F.col("e.l2"))
    lp = F.when(first, F.col("e.e11") * F.col("dy") + F.col("e.e12") * F.col("dx")).otherwise(F.col("e.e21") * F.col("dy") + F.col("e.e22") * F.col("dx"))
    keys = [k for k in _KEYS if k in surface.columns]
    return out.select(*keys, "v", F.col("e.l1").alias("l1"), F.col("e.l2").alias("l2"), lp.alias("lp"), lpp.alias("lpp"), strength(metric, t, F.col("e.l1"), F.col("e.l2")).alias("r"))
