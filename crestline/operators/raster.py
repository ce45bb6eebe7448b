"""Masks: pixels that entries touch, and dense 0/255 grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .entries import kind_of


def _pair_pixel(p: Column, q: Column, compat: bool) -> Column:
    """The cell of a segment: the smaller of the two ends' pixels (``compat``: the start's)."""
    r, c = (p["row_fx"], p["col_fx"]) if compat else (F.least(p["row_fx"], q["row_fx"]), F.least(p["col_fx"], q["col_fx"]))
    return F.struct(F.shiftright(r, 7).alias("row"), F.shiftright(c, 7).alias("col"))


def pixels(entries: DataFrame, compat: bool = False) -> DataFrame:
    """Distinct image_id, row, col; row-local up to the distinct."""
    kind = kind_of(entries)
    if kind == "points":
        hit = entries.select("image_id", F.shiftright("row_fx", 7).alias("row"), F.shiftright("col_fx", 7).alias("col"))
    elif kind == "segments":
        hit = entries.select("image_id", _pair_pixel(F.col("start"), F.col("end"), compat).alias("p")).select("image_id", "p.row", "p.col")
    else:
        pairs = F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("a"), F.slice("points", 2, F.size("points") - 1).alias("b"))
        hit = entries.select("image_id", F.explode(pairs).alias("z")).select("image_id", _pair_pixel(F.col("z.a"), F.col("z.b"), compat).alias("p")).select("image_id", "p.row", "p.col")
    return hit.distinct()


ROWS_OF_BLOCK = 256


def grid(dims: DataFrame) -> DataFrame:
    """Every (image_id, row, col); blocks of rows are dealt to tasks before they are filled."""
    last = F.floor((F.col("rows") - 1) / ROWS_OF_BLOCK)
    blocks = dims.filter("rows > 0 and cols > 0").select("image_id", "rows", "cols", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))
    blocks = blocks.repartition("image_id", "block")
    first = F.col("block") * ROWS_OF_BLOCK
    rows = blocks.select("image_id", "cols", F.explode(F.sequence(first, F.least(first + ROWS_OF_BLOCK, F.col("rows")) - 1)).alias("row"))
    return rows.select("image_id", F.col("row").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.col("cols").cast("int") - 1)).alias("col"))


def mask(hit: DataFrame, dims: DataFrame) -> DataFrame:
    """Dense image_id, row, col, m (0 or 255); pixels outside the image are dropped."""
    marked = hit.select("image_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.lit(255).cast("smallint").alias("m"))
    return grid(dims).join(marked, ["image_id", "row", "col"], "left").withColumn("m", F.coalesce("m", F.lit(0)).cast("smallint"))
