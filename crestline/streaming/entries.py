"""Row-local operators over streams of entries, and a stream over container files.

Culling, attributes, classes and rasterising need one entry at a time, so they
run on unbounded inputs as they are; pixel sets are kept distinct per watermark.
Line assembly needs a whole image and stays a batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entries as E
from ..operators import raster
from ..sources import ridg


def container_stream(spark: SparkSession, folder: str, kind: str, files_per_batch: int = 64) -> DataFrame:
    """Entries of the files that appear in ``folder``."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return ridg.entries_of(files.select("path", "content"), kind)


def culled_stream(stream: DataFrame, *thresholds: float | None, **options) -> DataFrame:
    return E.cull(stream, *thresholds, **options)


def pixel_counts(stream: DataFrame, time_col: str, window: str, late: str) -> DataFrame:
    """Entries per image and event-time window, late ones within ``late`` included."""
    w = F.window(time_col, window)
    return stream.withWatermark(time_col, late).groupBy(w, "image_id").agg(F.count(F.lit(1)).alias("entries"))


def pixels_stream(stream: DataFrame) -> DataFrame:
    """Distinct pixels touched so far; state grows with the images, not with the entries."""
    return raster.pixels(stream)
