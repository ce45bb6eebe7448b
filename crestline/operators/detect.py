"""Ridge detection: edge crossings, cells, points and segments.

An edge joins a pixel to its right neighbour (dir "N", the north side of the cell
whose top-left pixel it is) or to the one below (dir "W").  Each edge is
computed once; what a cell needs from its south and east sides are the N and W
edges of its neighbours, so cells, points and segments all derive from the edge
table by grouping, without another look at the pixels.

edges: image_id, row, col, dir, d (place in 1/128 pixel), brightness, strength.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.algebra import SUBPIXELS, crossing, lerp
from .stencil import along, metrics, smoothed
from .surface import filled

EDGE_SCHEMA = "image_id string, row int, col int, dir string, d int, brightness double, strength double"
POINT = "struct<row_fx:bigint,col_fx:bigint,brightness:double,strength:double>"
BITS = {"N": 1, "W": 2, "S": 4, "E": 8}
ORDER = ("N", "W", "S", "E")


def edges_by_windows(surface: DataFrame, t: float = 0.0, metric: str = "N", fill: float = 0.0) -> DataFrame:
    """Edges of a raw surface, with window functions only."""
    m = metrics(smoothed(filled(surface, fill), t), t, metric).select("image_id", "row", "col", "lp", "lpp", "r")
    m = m.join(surface.select("image_id", "row", "col", F.col("v").alias("raw")), ["image_id", "row", "col"])
    parts = []
    for dir_, axis in (("N", "rows"), ("W", "cols")):
        w = along(m, axis)
        nxt = {c: F.lead(c).over(w) for c in ("lp", "lpp", "r", "raw")}
        both = m.withColumns({f"{c}2": x for c, x in nxt.items()}).filter(F.col("lp2").isNotNull())
        x = crossing(F.col("lp"), F.col("lp2"), F.col("lpp"), F.col("lpp2"))
        met = both.withColumn("d", F.rint(x * SUBPIXELS).cast("int")).filter("d is not null")
        at = F.col("d") / F.lit(float(SUBPIXELS))
        parts.append(met.select("image_id", "row", "col", F.lit(dir_).alias("dir"), "d", lerp(at, F.col("raw"), F.col("raw2")).alias("brightness"), lerp(at, F.col("r"), F.col("r2")).alias("strength")))
    return parts[0].unionByName(parts[1])


def position(row: Column, col: Column, dir_: Column, d: Column) -> tuple[Column, Column]:
    """Fixed-point position of an edge's ridge point."""
    north = dir_ == "N"
    return row.cast("bigint") * SUBPIXELS + F.when(north, 0).otherwise(d), col.cast("bigint") * SUBPIXELS + F.when(north, d).otherwise(0)


def as_point(edge: DataFrame) -> DataFrame:
    r, c = position(F.col("row"), F.col("col"), F.col("dir"), F.col("d"))
    return edge.withColumns({"row_fx": r, "col_fx": c})


ROWS_OF_BLOCK = 1024


def numbered(df: DataFrame, *order: str, name: str = "entry_id") -> DataFrame:
    """``name`` = place in row-major order within the image, from 0.

    Rows are ranked inside each image row and shifted by the counts of the rows
    above, summed in two levels: inside blocks of 1024 rows, and over blocks.  So no
    task sorts an image, and one that sums over an image sees a row per 1024 rows.
    """
    rank = F.row_number().over(Window.partitionBy("image_id", "row").orderBy(*order))
    above = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy("image_id", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = df.groupBy("image_id", "row").count().withColumn("_block", F.floor(F.col("row") / ROWS_OF_BLOCK))
    blocks = counts.groupBy("image_id", "_block").agg(F.sum("count").alias("total"))
    blocks = blocks.select("image_id", "_block", above("total", "_block").alias("_before"))
    starts = counts.withColumn("_in", above("count", "_block", "row")).join(blocks, ["image_id", "_block"]).select("image_id", "row", (F.col("_in") + F.col("_before")).alias("_above"))
    return df.withColumn("_rank", rank).join(starts, ["image_id", "row"]).withColumn(name, F.col("_above") + F.col("_rank") - 1).drop("_rank", "_above")


def points(edges: DataFrame) -> DataFrame:
    """image_id, entry_id, row_fx, col_fx, brightness, strength: row-major, N before W."""
    out = numbered(as_point(edges), "col", "dir")
    return out.select("image_id", "entry_id", "row_fx", "col_fx", "brightness", "strength")


def cell_sides(edges: DataFrame, dims: DataFrame) -> DataFrame:
    """One row per (cell, flagged side): image_id, row, col, bit, and the point.

    South and east sides count only where the cell is a full square.  ``dims`` has
    one row per image.
    """
    e = as_point(edges).join(dims, "image_id")
    north = F.col("dir") == "N"
    own = F.struct(F.col("row").alias("row"), F.col("col").alias("col"), F.when(north, BITS["N"]).otherwise(BITS["W"]).alias("bit"))
    other = F.struct(
        F.when(north, F.col("row") - 1).otherwise(F.col("row")).alias("row"),
        F.when(north, F.col("col")).otherwise(F.col("col") - 1).alias("col"),
        F.when(north, BITS["S"]).otherwise(BITS["E"]).alias("bit"),
    )
    point = F.struct("row_fx", "col_fx", "brightness", "strength").alias("point")
    sides = e.select("image_id", "rows", "cols", point, F.col("row").alias("er"), F.col("col").alias("ec"), F.col("dir").alias("ed"), "d", F.explode(F.array(own, other)).alias("cell"))
    full = (F.col("cell.row") < F.col("rows") - 1) & (F.col("cell.col") < F.col("cols") - 1)
    sides = sides.filter((F.col("cell.row") >= 0) & (F.col("cell.col") >= 0) & ((F.col("cell.bit") <= 2) | full))
    return sides.select("image_id", F.col("cell.row").alias("row"), F.col("cell.col").alias("col"), F.col("cell.bit").alias("bit"), "point", "er", "ec", "ed", "d")


def cells(edges: DataFrame, dims: DataFrame) -> DataFrame:
    """image_id, row, col, flags, north, west of the cells with a flag (null = none)."""
    s = cell_sides(edges, dims)
    d = lambda b: F.max(F.when(F.col("bit") == b, F.col("d"))).cast("smallint")
    return s.groupBy("image_id", "row", "col").agg(F.sum("bit").cast("tinyint").alias("flags"), d(1).alias("north"), d(2).alias("west"))


def two_sided(edges: DataFrame, dims: DataFrame) -> DataFrame:
    """Cells with exactly two flags and their sides in order N, W, S, E."""
    s = cell_sides(edges, dims)
    by = s.groupBy("image_id", "row", "col").agg(F.sum("bit").alias("flags"), F.array_sort(F.collect_list(F.struct("bit", "point", "er", "ec", "ed"))).alias("sides"))  # four at most
    return by.filter(F.bit_count("flags") == 2)


def segments(edges: DataFrame, dims: DataFrame) -> DataFrame:
    """image_id, entry_id, start, end of every two-sided cell, row-major."""
    s = numbered(two_sided(edges, dims), "col")
    return s.select("image_id", "entry_id", F.col("sides")[0]["point"].alias("start"), F.col("sides")[1]["point"].alias("end"))
