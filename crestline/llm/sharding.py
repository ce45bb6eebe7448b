"""Sharding by sampled splitters, DataFrame functions only.  Law: bytes.

1. Slim rows (id, size, crc, key hash, number) are computed in one scan and staged.
2. Keys are drawn with probability proportional to load (size against the mean bytes of a
   range, plus one row against its mean rows; a hash of the row decides, so a rerun draws
   the same) and their weighted quantiles bound ranges of the key (text hash, id, row
   number).  Equal texts are neighbours in that order.
3. Exact bytes and rows per range are counted; ranges over twice the mean of either are
   subdivided by a fresh sample from inside them until none is left but single rows.  As row
   numbers are distinct, any range can be cut: by id where one text fills it, by number
   where text and id are equal.
4. A row's shard is where the midpoint of its bytes falls on the cumulated
   bytes: exact offsets of ranges plus a running sum inside each range.  A group
   of equal texts moves as one unless it is larger than 1/64 of a shard; where ranges
   cut a group, its bytes and its begin come from a small table of such groups.

The driver holds range boundaries and sums only: about max(8 per shard, rows/1e6)
ranges, 32 samples each, i.e. about 16 MB for 30 billion rows.

Cases: null text has size 8; null ids sort first; repeated rows are rows of
their own; an empty table gives an empty result; extra columns are ignored.
A row larger than a shard stays whole, so its shard is larger.
"""

from __future__ import annotations

import bisect
import math
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage

_MIN = -(2**63)
SAMPLES_PER_RANGE = 32
ROWS_PER_RANGE = 1_000_000
WHOLE_GROUP = 64  # a group up to 1/64 of a shard is never split


def _array(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


Bound = tuple[int, int, int]  # h, k, u
_KEYS = ("h", "k", "u")


def range_of(bounds: list[Bound]) -> Column:
    """Number of bounds <= (h, k, u), by binary search inside the expression."""
    if not bounds:
        return F.lit(0)
    at_ = [_array([b[i] for b in bounds]) for i in range(3)]
    steps = [2**i for i in reversed(range(len(bounds).bit_length()))]

    def probe(pos: Column, step: Column) -> Column:
        h, k, u = (F.get(a, pos + step - 1) for a in at_)
        below = (h < F.col("h")) | ((h == F.col("h")) & ((k < F.col("k")) | ((k == F.col("k")) & (u <= F.col("u")))))
        return F.when(below, pos + step).otherwise(pos)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), probe)


def _uniform(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*_KEYS, F.lit(seed)), 11) / F.lit(float(2**53))


def _sample(rows: DataFrame, unit: float, seed: int) -> list[tuple[Bound, float, float]]:
    """(key, load, weight) drawn with probability load/unit, at most 1."""
    got = rows.filter(_uniform(seed) < F.col("load") / F.lit(unit)).select(*_KEYS, "load").collect()
    return sorted(((r["h"], r["k"], r["u"]), r["load"], max(r["load"], unit)) for r in got)


def _quantiles(drawn: list[tuple[Bound, float, float]], parts: int, mean: float) -> list[Bound]:
    """Bounds at the weighted quantiles; a row larger than a range is cut out on both sides."""
    total, run, out = sum(w for *_, w in drawn), 0.0, []
    for (h, k, u), size, w in drawn:
        run += w
        if run >= total * (len(out) + 1) / parts and len(out) < parts - 1:
            out.append((h, k, u))
            while len(out) < parts - 1 and run >= total * (len(out) + 1) / parts:
                out.append((h, k, u))  # several quantiles in one heavy row: merged below
        if size > mean:
            out += [(h, k, u), (h, k, u + 1)]
    return out


def _snapped(bounds: set[Bound]) -> set[Bound]:
    """A text hit once is cut before its group; one hit repeatedly is cut inside too."""
    by: dict[int, set[Bound]] = {}
    for b in bounds:
        by.setdefault(b[0], set()).add(b)
    return {(h, _MIN, _MIN) for h in by} | {b for bs in by.values() if len(bs) > 1 for b in bs}


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("h"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_MIN)).alias("k"),
    )


def _whole_starts(bounds: list[Bound]) -> list[Bound]:
    """A text that is cut inside is cut before its group too."""
    return sorted({*bounds, *((h, _MIN, _MIN) for h, *inside in bounds if inside != [_MIN, _MIN])})


def ranges_of(rows: DataFrame, ranges: int, mean: float, mean_rows: float, seed: int) -> tuple[list[Bound], dict[int, tuple[int, int]]]:
    """Bounds, and (bytes, rows) of each range: at most twice the mean of each, or a single row."""
    rows = rows.withColumn("load", F.col("size") / F.lit(mean) + F.lit(1.0 / mean_rows))
    unit = 2 / SAMPLES_PER_RANGE  # the mean load of a range is 2
    bounds = _whole_starts(list(_snapped(set(_quantiles(_sample(rows, unit, seed), ranges, 2)))))
    for again in count(1):
        ranged = rows.withColumn("r", range_of(bounds))
        sums = {r["r"]: (r["b"], r["n"]) for r in ranged.groupBy("r").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
        over = sorted(r for r, (b, c) in sums.items() if (b > 2 * mean or c > 2 * mean_rows) and c > 1)
        if not over:
            return bounds, sums
        drawn = _sample(ranged.filter(F.col("r").isin(over)), unit, seed + again)
        keys = [d[0] for d in drawn]
        more: set[Bound] = set()
        for r in over:
            i = bisect.bisect_left(keys, bounds[r - 1]) if r else 0
            j = bisect.bisect_left(keys, bounds[r]) if r < len(bounds) else len(keys)
            b, c = sums[r]
            more |= set(_quantiles(drawn[i:j], max(2, math.ceil(2 * b / mean), math.ceil(2 * c / mean_rows)), 2))
        bounds = _whole_starts([*bounds, *(_snapped(more) if again == 1 else more)])


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard (null)."""
    slim = stage(keyed(docs, id_col, text_col).withColumn("u", F.monotonically_increasing_id()), "shard-rows")
    n, total = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(shards * 8, -(-n // ROWS_PER_RANGE))
    bounds, sums = ranges_of(slim, ranges, max(1.0, total / ranges), max(1.0, n / ranges), seed) if n else ([], {})
    ranged = slim.withColumn("r", range_of(bounds))
    spark = docs.sparkSession
    offsets, at_b, at_n = [], 0, 0
    for r in sorted(sums):
        offsets.append((r, at_b, at_n))
        at_b, at_n = at_b + sums[r][0], at_n + sums[r][1]
    # both bounded by the number of ranges, as checked above
    starts = F.broadcast(spark.createDataFrame(offsets, "r int, from_b bigint, from_n bigint"))
    cut = {h for h, *inside in bounds if inside != [_MIN, _MIN]}
    first = {h: r + 1 for r, (h, *inside) in enumerate(bounds) if h in cut and inside == [_MIN, _MIN]}
    at = {r: b for r, b, _ in offsets}
    begun = F.broadcast(spark.createDataFrame([(h, at.get(r, 0)) for h, r in first.items()], "h bigint, cut_at bigint"))
    groups = F.broadcast(slim.join(begun, "h").groupBy("h", "cut_at").agg(F.sum("size").alias("cut_b")))
    by_range = Window.partitionBy("r").orderBy(*_KEYS)
    group = Window.partitionBy("r", "h")
    before = F.sum("size").over(by_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = (
        ranged.withColumn("before", before)
        .withColumn("rn", F.row_number().over(by_range) - 1)
        .withColumn("group_b", F.sum("size").over(group))
        .withColumn("group_at", F.min("before").over(group))
        .join(starts, "r")
        .join(groups, "h", "left")
    )
    group_b = F.coalesce("cut_b", "group_b")
    group_at = F.coalesce(F.col("cut_at"), F.col("from_b") + F.col("group_at"))
    whole = group_b * shards * WHOLE_GROUP <= total
    twice = F.when(whole, 2 * group_at + group_b).otherwise(2 * (F.col("from_b") + F.col("before")) + F.col("size"))
    share = (twice.cast("decimal(38,0)") * shards / (2 * max(total, 1))).cast("decimal(38,6)")
    placed = stage(
        placed.select("id", "size", "crc", F.least(F.lit(shards - 1), F.floor(share).cast("int")).alias("shard"), (F.col("from_n") + F.col("rn")).alias("g")),
        "shard-placed",
    )
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("g").alias("first")))  # one row per shard
    return placed.join(firsts, "shard").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("g") - F.col("first")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
