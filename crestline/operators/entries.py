"""Attributes, thresholds and counts of ridge entries; entry access and metadata.

Lines come as (image_id, entry_id, points); segments as start, end; points flat.
All of this is row-local, so it also runs on streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("points", "segments", "lines")


def kind_of(entries: DataFrame) -> str:
    c = set(entries.columns)
    if "points" in c:
        return "lines"
    return "segments" if {"start", "end"} <= c else "points"


def attributes(entries: DataFrame) -> DataFrame:
    """length, mean_brightness, mean_strength: 0 and own for a point, 1 and the mean of two
    for a segment, n - 1 and the mean of all for a line."""
    kind = kind_of(entries)
    if kind == "points":
        return entries.withColumns({"length": F.lit(0), "mean_brightness": F.col("brightness").cast("double"), "mean_strength": F.col("strength").cast("double")})
    if kind == "segments":
        mean = lambda f: (F.col(f"start.{f}") + F.col(f"end.{f}")) / F.lit(2.0)
        return entries.withColumns({"length": F.lit(1), "mean_brightness": mean("brightness"), "mean_strength": mean("strength")})
    n = F.size("points")
    mean = lambda f: F.aggregate("points", F.lit(0.0), lambda a, p: a + p[f].cast("double")) / n
    return entries.withColumns({"length": n - 1, "mean_brightness": mean("brightness"), "mean_strength": mean("strength")})


def culled(min_brightness: float | None, min_length: float | None, min_strength: float | None, invert: bool = False, compat: bool = False) -> Column:
    """Whether an entry (with attributes) goes.

    Without ``invert``: below any threshold (an equal value stays; NaN is not below).
    With it: at or above any given one.  ``compat`` inverts unset thresholds too, so
    they remove everything.
    """
    tests = []
    for name, least in (("length", min_length), ("mean_brightness", min_brightness), ("mean_strength", min_strength)):
        below = F.lit(False) if least is None else ~F.isnan(F.col(name).cast("double")) & (F.col(name) < F.lit(float(least)))
        if invert:
            tests.append(~below if least is not None or compat else F.lit(False))
        else:
            tests.append(below)
    return tests[0] | tests[1] | tests[2]


def cull(entries: DataFrame, min_brightness: float | None = None, min_length: float | None = None, min_strength: float | None = None, invert: bool = False, compat: bool = False) -> DataFrame:
    out = attributes(entries).filter(~culled(min_brightness, min_length, min_strength, invert, compat))
    return out.select(entries.columns)


def cull_counts(entries: DataFrame, *thresholds, **options) -> DataFrame:
    """One row: culled and total."""
    gone = culled(*(list(thresholds) + [None] * 3)[:3], **options)
    return attributes(entries).agg(F.count_if(gone).alias("culled"), F.count(F.lit(1)).alias("total"))


def at_index(entries: DataFrame, index: int, kind: str | None = None) -> DataFrame:
    """The entry, or no row if it is out of range or of another kind."""
    if kind is not None and kind != kind_of(entries):
        return entries.limit(0)
    return entries.filter(F.col("entry_id") == index)


def appended(entries: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` behind ``entries``, numbered on."""
    last = entries.groupBy("image_id").agg((F.max("entry_id") + 1).alias("_next"))
    moved = more.join(last, "image_id", "left").withColumn("entry_id", F.col("entry_id") + F.coalesce("_next", F.lit(0))).drop("_next")
    return entries.unionByName(moved.select(entries.columns))


def without(entries: DataFrame, index: int) -> DataFrame:
    return entries.filter(F.col("entry_id") != index)


def with_metadata(meta: Column, key: int, value: bytes | None) -> Column:
    """map<int,binary> with the key set, or removed where value is None."""
    rest = F.map_filter(meta, lambda k, _: k != key)
    return rest if value is None else F.map_concat(rest, F.create_map(F.lit(key), F.lit(bytearray(value))))


def metadata_uint32(meta: Column, key: int) -> Column:
    """The 4-byte big-endian value as bigint; null if absent or of another length."""
    raw = F.try_element_at(meta, F.lit(key))
    return F.when(F.octet_length(raw) == 4, F.conv(F.hex(raw), 16, 10).cast("bigint"))
