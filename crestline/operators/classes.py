"""Classes of entries as a column: summaries, comparison, splitting, editing, picking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _percent(part: str, whole: str):
    return F.when(F.col(whole) > 0, F.round(F.col(part) * F.lit(100.0) / F.col(whole), 2))


def summary(labels: DataFrame, column: str = "class") -> DataFrame:
    """One row: a (class 0), b (any other), n and their percentages with two decimals."""
    c = F.col(column)
    out = labels.agg(F.count_if(c == 0).alias("a"), F.count_if(c != 0).alias("b"), F.count(c).alias("n"))
    return out.withColumns({"a_percent": _percent("a", "n"), "b_percent": _percent("b", "n")})


def difference(data: DataFrame, reference: DataFrame, column: str = "class") -> DataFrame:
    """One row: a_to_b (b where the reference has a), b_to_a, n and percentages.

    Raises when the two do not label the same entries.
    """
    x = data.select("entry_id", F.col(column).alias("x"))
    y = reference.select("entry_id", F.col(column).alias("y"))
    both = x.join(y, "entry_id", "full")
    out = both.agg(
        F.count_if((F.col("x") != 0) & (F.col("y") == 0)).alias("a_to_b"),
        F.count_if((F.col("x") == 0) & (F.col("y") != 0)).alias("b_to_a"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("unmatched"),
    )
    checked = F.when(F.col("unmatched") > 0, F.raise_error(F.lit("the classifications differ in size")).cast("bigint")).otherwise(F.col("n"))
    return out.withColumn("n", checked).withColumns({"a_to_b_percent": _percent("a_to_b", "n"), "b_to_a_percent": _percent("b_to_a", "n")}).drop("unmatched")


def dump(labels: DataFrame, column: str = "class", likelihood: str | None = None) -> DataFrame:
    """entry_id, line: the class, then a tab and the likelihood in C's %e form if there is one."""
    text = F.col(column).cast("string")
    if likelihood:
        text = F.concat_ws("\t", text, F.format_string("%e", F.col(likelihood).cast("double")))
    return labels.select("entry_id", text.alias("line")).orderBy("entry_id")


def validated(entries: DataFrame, column: str = "class") -> DataFrame:
    """Raises on an entry without a class or outside a byte."""
    c = F.col(column)
    ok = c.isNotNull() & c.between(0, 255)
    return entries.withColumn(column, F.when(ok, c).otherwise(F.raise_error(F.lit("an entry has no valid class")).cast("smallint")))


def split(entries: DataFrame, column: str = "class") -> tuple[DataFrame, DataFrame]:
    """(class 0, any other class)."""
    return entries.filter(F.col(column) == 0), entries.filter(F.col(column) != 0)


def extended(entries: DataFrame, labels: DataFrame, column: str = "class") -> DataFrame:
    """Every entry with its class, 0 where it has none."""
    out = entries.join(labels.select("entry_id", F.col(column).alias("_c")), "entry_id", "left")
    return out.withColumn(column, F.coalesce("_c", F.lit(0)).cast("smallint")).drop("_c")


def toggled(labels: DataFrame, entry_id: int, column: str = "class") -> DataFrame:
    flip = F.when(F.col(column) == 0, 1).otherwise(0)
    return labels.withColumn(column, F.when(F.col("entry_id") == entry_id, flip).otherwise(F.col(column)).cast("smallint"))


def pixel_index(lines: DataFrame) -> DataFrame:
    """image_id, row, col, entry_id: the pixel of each pair of consecutive points; the last line wins.

    Pairs are made inside each line's array, so only pixels are shuffled.
    """
    near = F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("a"), F.slice("points", 2, F.size("points") - 1).alias("b"))
    pair = lines.select("image_id", "entry_id", F.explode(near).alias("z"))
    at = lambda f: F.shiftright(F.col(f"z.a.{f}") + F.col(f"z.b.{f}"), 8).cast("int")
    return pair.select("image_id", at("row_fx").alias("row"), at("col_fx").alias("col"), "entry_id").groupBy("image_id", "row", "col").agg(F.max("entry_id").alias("entry_id"))


def pick(index: DataFrame, image_id: str, x: float, y: float) -> DataFrame:
    """The entry at the pixel nearest (x = column, y = row); no row where there is none."""
    return index.filter((F.col("image_id") == image_id) & (F.col("row") == round(y)) & (F.col("col") == round(x))).select("entry_id")
