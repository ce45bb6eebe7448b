"""Surfaces over the relational tables: any table that rasterises to a grid is an image.

Each is a relation of runs, one for each image row, that reads only the rows and columns
of a region; the pixel form is made from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.region import EVERYWHERE, Region
from ..operators.surface import from_runs, runs_from_arrays, runs_from_sums
from ..plans.staging import stage, table


def emb_runs(spark: SparkSession, sf_dir: str, region: Region = EVERYWHERE) -> DataFrame:
    """embeddings: a vector per row."""
    return runs_from_arrays(table(spark, sf_dir, "embeddings"), "emb", F.col("vec_id"), F.col("embedding"), region)


def evt_runs(spark: SparkSession, sf_dir: str, region: Region = EVERYWHERE) -> DataFrame:
    """events: users by days of January 2024, number of events."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("int").alias("row"), (F.dayofmonth("ts") - 1).alias("col"))
    counts = stage(e.groupBy("row", "col").agg(F.count(F.lit(1)).alias("v")), "evt-counts")
    (top,) = counts.agg(F.max("row")).first()
    return runs_from_sums(counts, "evt", 0 if top is None else top + 1, 30, region)


def li_runs(spark: SparkSession, sf_dir: str, region: Region = EVERYWHERE) -> DataFrame:
    """lineitem: suppliers by months since the first shipment, quantity shipped."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("int").alias("row"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("m"), "l_quantity")
    sums = stage(x.groupBy("row", "m").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("v")), "li-sums")
    low, high, top = sums.agg(F.min("m"), F.max("m"), F.max("row")).first()
    if low is None or top is None:
        low, high, top = 0, -1, -1
    return runs_from_sums(sums.select("row", (F.col("m") - low).alias("col"), "v"), "li", top + 1, high - low + 1, region)


RUNS = {"emb": emb_runs, "evt": evt_runs, "li": li_runs}


def _surface(name: str):
    def made(spark: SparkSession, sf_dir: str, region: Region = EVERYWHERE) -> DataFrame:
        return from_runs(RUNS[name](spark, sf_dir, region))

    made.__doc__ = RUNS[name].__doc__
    return made


emb, evt, li = map(_surface, RUNS)
SURFACES = {"emb": emb, "evt": evt, "li": li}
