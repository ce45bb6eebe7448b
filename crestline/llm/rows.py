"""Tables whose rows are decided one by one: a key per row, and columns out of the way.

Columns are renamed c0, c1, ... while an operator works, so that no name of the table
clashes with one of the operator's, and get their names back at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .screen import with_hit

_LAST = 2**63 - 1


@dataclass(frozen=True)
class Rows:
    """``df`` has c0.., key (bigint, one per row) and text (null as empty).

    Where ids are not null and tell rows apart the key is the id; elsewhere the table is
    staged with a number per row, and id (null last) and print of the text stand beside it.
    """

    df: DataFrame
    names: list[str]
    clear: bool

    @classmethod
    def of(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Rows:
        names = docs.columns
        docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # by position: names may differ in case only, or hold a backtick
        id_, text = f"c{names.index(id_col)}", F.coalesce(F.col(f"c{names.index(text_col)}"), F.lit(""))
        ids = docs.select(F.col(id_).cast("bigint").alias("id"))
        unclear = ids.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("id is null or rows > 1")
        if not unclear.head(1):
            return cls(docs.withColumns({"key": F.col(id_).cast("bigint"), "text": text}), names, True)
        df = stage(docs.select("*", F.monotonically_increasing_id().alias("key")), "keyed-rows")
        return cls(df.withColumns({"id": F.coalesce(F.col(id_).cast("bigint"), F.lit(_LAST)), "print": F.xxhash64(text), "text": text}), names, False)

    @property
    def slim(self) -> list[str]:
        """What identifies and orders a row."""
        return ["key"] if self.clear else ["key", "id", "print"]

    @property
    def order(self) -> Column:
        """Rows by id (null last), then by a print of the text, then by number."""
        return F.col("key") if self.clear else F.struct("id", "print", "key")

    def restored(self, df: DataFrame, *more: Column, **changed: Column) -> DataFrame:
        """The table's own columns (those in ``changed`` with a new value) and ``more``."""
        return df.select(*[changed.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(self.names)], *more)


def split_by_keys(df: DataFrame, keys: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` is surely none of ``keys``, the rest): only the rest needs a join."""
    flagged = with_hit(df, F.xxhash64("key"), keys.select(F.xxhash64("key").alias("k")), "k", count, "_hit")
    return flagged.filter("not _hit").drop("_hit"), flagged.filter("_hit").drop("_hit")


def free_name(names: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front as long as the table has such a column."""
    while wanted.lower() in {n.lower() for n in names}:
        wanted = "_" + wanted
    return wanted
