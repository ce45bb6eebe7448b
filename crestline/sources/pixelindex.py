"""A stored index from pixels to lines, in Morton order.

Pixels near each other in an image are near in the order of their interleaved bits, so a
file holds a patch of an image.  Files are dealt by ranges of (image, Morton code); a small
table tells where each begins and ends.  A pick looks there and reads one file; a window
reads the files whose ranges it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.region import Region

ROWS_PER_FILE = 1 << 20
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(x: Column) -> Column:
    """The bits of a number below 2^31 at even places."""
    x = x.cast("bigint")
    for by, mask in _SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask))
    return x


def morton(row: Column, col: Column) -> Column:
    return F.shiftleft(_spread(row), 1).bitwiseOR(_spread(col))


def morton_of(row: int, col: int) -> int:
    out = 0
    for bit in range(31):
        out |= (row >> bit & 1) << (2 * bit + 1) | (col >> bit & 1) << (2 * bit)
    return out


def store(index: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write (image_id, row, col, entry_id) as an index at ``path``, which must be new."""
    spark = index.sparkSession
    files = max(1, -(-index.count() // rows_per_file))
    keyed = index.select("image_id", "row", "col", "entry_id", morton(F.col("row"), F.col("col")).alias("z"))
    dealt = keyed.repartitionByRange(files, "image_id", "z").withColumn("part", F.spark_partition_id())
    dealt.sortWithinPartitions("part", "image_id", "z").write.partitionBy("part").parquet(f"{path}/pixels")
    key = F.struct("image_id", "z")
    parts = spark.read.schema("image_id string, z bigint, part int").parquet(f"{path}/pixels").groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    parts.coalesce(1).write.parquet(f"{path}/parts")  # a row per file


def _read(spark: SparkSession, path: str, image_id: str, low: int, high: int) -> DataFrame:
    """The pixels of the files that may hold codes from low to high."""
    a, b = (F.struct(F.lit(image_id).alias("image_id"), F.lit(z).alias("z")) for z in (low, high))
    parts = spark.read.schema("part int, first struct<image_id:string,z:bigint>, last struct<image_id:string,z:bigint>").parquet(f"{path}/parts")
    touched = [r["part"] for r in parts.filter((F.col("first") <= b) & (F.col("last") >= a)).select("part").collect()]  # files of one window
    pixels = spark.read.schema("image_id string, row int, col int, entry_id bigint, z bigint, part int").parquet(f"{path}/pixels")
    return pixels.filter(F.col("part").isin(touched) & (F.col("image_id") == image_id) & F.col("z").between(low, high))


def pick(spark: SparkSession, path: str, image_id: str, x: float, y: float) -> DataFrame:
    """The entry at the pixel nearest (x = column, y = row); no row where there is none."""
    row, col = round(y), round(x)
    z = morton_of(row, col) if min(row, col) >= 0 else -1
    return _read(spark, path, image_id, z, z).select("entry_id")


def within(spark: SparkSession, path: str, image_id: str, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """(row, col, entry_id) of the pixels in a half-open window."""
    (top, bottom), (left, right) = ((max(0, a), b) for a, b in (rows, cols))
    ends = (morton_of(top, left), morton_of(bottom - 1, right - 1)) if top < bottom and left < right else (0, -1)
    found = _read(spark, path, image_id, *ends)
    return Region((top, bottom), (left, right)).of(found).select("row", "col", "entry_id")
