"""Intermediate tables in the shared folder named by spark.checkpoint.dir.

Writing a table there cuts lineage: a lost executor costs a re-read.  The folder
comes from the session; only a local session without one gets a folder of its own.
Tables belong to a database in that folder, so that dropping one deletes its files:
``drop`` frees tables that nothing reads any more, ``clear`` all of a session's once
its results have been read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_homes: dict[str, str] = {}
_names: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="crestline-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _home(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _homes:
        name = f"crestline_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE spark_catalog.{name} LOCATION '{shared_dir(spark)}/{name}'")
        _homes[app] = f"spark_catalog.{name}"
    return _homes[app]


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends: its result is a table by then."""
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it read back."""
    spark = df.sparkSession
    key = f"{_home(spark)}.{name.replace('-', '_')}_{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.format("parquet").option("compression", "zstd").saveAsTable(key)
    out = spark.table(key)
    _names[out] = key
    return out


def stage_buckets(df: DataFrame, name: str, keys: tuple[str, ...]) -> DataFrame:
    """``stage``, bucketed by ``keys``: later groupings and joins on them find the rows in place."""
    spark = df.sparkSession
    key = f"{_home(spark)}.{name.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with freed_shuffles(spark):
        df.repartition(buckets, *keys).write.format("parquet").option("compression", "zstd").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(key)
    out = spark.table(key)
    _names[out] = key
    return out


def folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the staged tables, for files that tasks write; ``clear`` deletes it with them."""
    return f"{shared_dir(spark)}/{_home(spark).split('.')[1]}/{name}-{uuid.uuid4().hex}"


def drop(*staged: DataFrame) -> None:
    """Delete tables made by ``stage`` that nothing will read again."""
    for df in staged:
        if key := _names.pop(df, None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {key}")


def clear(spark: SparkSession) -> None:
    """Delete every table staged in this application; results that still read them are lost."""
    if home := _homes.pop(spark.sparkContext.applicationId, None):
        spark.sql(f"DROP DATABASE IF EXISTS {home} CASCADE")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
