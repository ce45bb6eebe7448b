"""Surfaces: dense grids (image_id, row, col, v) made from tables, clipped, filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import finite_or
from .region import EVERYWHERE, Region

SCHEMA = "image_id string, row int, col int, v double"


RUN = "image_id string, row int, left int, v array<double>"


def runs_from_arrays(df: DataFrame, image_id: str, row: Column, values: Column, region: Region = EVERYWHERE) -> DataFrame:
    """Stretches of image rows (image_id, row, left, v), one for each table row: its array's elements.

    The region's rows are a condition on ``row`` as the table has it, so a scan can use
    it; its columns are a slice of the array.
    """
    inside = df.filter(region.condition(row)) if region.rows else df
    low, high = region.cols or (0, None)
    part = F.slice(values, low + 1, max(0, high - low)) if high is not None else values
    return inside.select(F.lit(image_id).alias("image_id"), row.cast("int").alias("row"), F.lit(low).alias("left"), part.cast("array<double>").alias("v"))


def runs_from_sums(sums: DataFrame, image_id: str, rows: int, cols: int, region: Region = EVERYWHERE) -> DataFrame:
    """One stretch for each of ``rows`` rows of a grid of few columns; pixels absent from (row, col, v) are 0.

    The rows are dealt to tasks; only what a row has is grouped.
    """
    wanted = region.met(Region((0, rows), (0, cols)))
    (top, bottom), (left, right) = wanted.rows, wanted.cols
    held = Region(wanted.rows, wanted.cols).of(sums).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "v"))).alias("m"))
    grid = sums.sparkSession.range(top, max(top, bottom)).select(F.col("id").cast("int").alias("row"))
    at = lambda c: F.coalesce(F.try_element_at("m", c).cast("double"), F.lit(0.0))
    every = F.transform(F.sequence(F.lit(left), F.lit(right - 1)), at) if right > left else F.array().cast("array<double>")
    return grid.join(held, "row", "left").select(F.lit(image_id).alias("image_id"), "row", F.lit(left).alias("left"), every.alias("v"))


def from_runs(runs: DataFrame) -> DataFrame:
    out = runs.select("image_id", "row", "left", F.posexplode("v").alias("at", "v"))
    return out.select("image_id", "row", (F.col("left") + F.col("at")).alias("col"), "v")


def clipped(surface: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    """The half-open window, moved to the origin."""
    inside = (F.col("row") >= top) & (F.col("row") < top + height) & (F.col("col") >= left) & (F.col("col") < left + width)
    return surface.filter(inside).withColumns({"row": F.col("row") - top, "col": F.col("col") - left})


def transposed(surface: DataFrame) -> DataFrame:
    swap = {"row": F.col("col").alias("row"), "col": F.col("row").alias("col")}
    return surface.select(*[swap.get(c, F.col(c)) for c in surface.columns])


def filled(surface: DataFrame, fill: float = 0.0) -> DataFrame:
    return surface.withColumn("v", finite_or(F.col("v"), fill))


def size(surface: DataFrame) -> DataFrame:
    """(image_id, rows, cols), one row per image."""
    return surface.groupBy("image_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
