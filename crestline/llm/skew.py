"""Joining rows to their groups when one group may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join on ``keys`` (unique in ``groups``; ``size`` = rows of the key).

    Groups over total/1000 rows number at most 1000, which bounds what is
    broadcast; the rows they match get a key of their own in the second join,
    so they spread evenly, and all other groups are small.
    """
    values = [c for c in groups.columns if c not in keys]
    big = F.col(size) * HOT_SHARE > F.lit(total)
    hot = groups.filter(big).select(*keys, F.struct(*values).alias("_hot"))
    # the mixed key is no constant on either side: a plain 0 would be moved out of the join's keys
    cold = groups.filter(~big).select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*values).alias("_cold"), F.xxhash64(*keys, F.lit(0).cast("bigint")).alias("_to"))
    own = F.when(F.col("_hot").isNotNull(), F.monotonically_increasing_id() + 1).otherwise(0)
    spread = rows.join(F.broadcast(hot), keys, "left").withColumn("_own", own).withColumn("_from", F.xxhash64(*keys, "_own"))
    out = spread.join(cold, [spread[k] == cold[f"_{k}"] for k in keys] + [F.col("_from") == F.col("_to")], "left")
    both = F.coalesce("_hot", "_cold")
    return out.select(*rows.columns, *[both[v].alias(v) for v in values])
