"""Entries with an appendable log of edits, merged when read.

A store holds a base of numbered entries with their classes, entries appended since, and a
log of edits in batches: removals, toggles and classes set.  An edit is a row of the log,
whatever the size of the base.  Reading turns removals into bitmaps (a bit per entry in
blocks of BLOCK, one small row a block) and class edits into one delta per entry, and merges
both with the base.  ``compacted`` writes the merged entries as a new base, numbered on
without gaps.

Edits name entries by id, or by place: the k-th entry that is left, found by rank and
select over the blocks' counts of bits, so no task ranks all entries.  Later batches win;
inside a batch, edits apply in their order.  Edits of an entry that is gone or was never
there do nothing.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.staging import stage

BLOCK = 1 << 15  # of bitmap_construct_agg
REMOVE, TOGGLE, SET = "remove", "toggle", "set"
_EDIT = "batch bigint, step bigint, op string, image_id string, entry_id bigint, class smallint"


def _block(c: str) -> Column:
    return F.floor(F.col(c) / BLOCK).cast("bigint")


def _bit(c: str) -> Column:
    return F.col(c) % BLOCK


@dataclass(frozen=True)
class EditLog:
    spark: SparkSession
    path: str

    @classmethod
    def create(cls, entries: DataFrame, path: str) -> EditLog:
        """A store at a new path; ``entries`` have image_id, entry_id from 0 on without gaps, and perhaps a class."""
        classed = F.col("class").cast("smallint") if "class" in entries.columns else F.lit(0).cast("smallint")
        entries.withColumn("class", F.coalesce(classed, F.lit(0).cast("smallint"))).write.parquet(f"{path}/entries/batch=0")
        return cls(entries.sparkSession, path)

    def _all(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "false").parquet(f"{self.path}/entries").drop("batch")

    def _edits(self) -> DataFrame | None:
        """The log, without edits of entries that were not there yet; none where nothing was edited."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/edits")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return None
        edits = self.spark.read.schema(_EDIT).parquet(f"{self.path}/edits")
        written = self.spark.read.option("mergeSchema", "false").parquet(f"{self.path}/entries")
        known = written.groupBy("image_id", F.col("batch").cast("bigint").alias("_since")).agg(F.max("entry_id").alias("_upto"))  # a row for each append and image
        there = (edits["image_id"] == known["image_id"]) & (known["_since"] <= edits["batch"]) & (known["_upto"] >= edits["entry_id"])
        return edits.join(known, there, "left_semi")

    @staticmethod
    def _batch() -> int:
        return time.time_ns()

    def edit(self, edits: DataFrame) -> None:
        """Append a batch: step, op, image_id, entry_id and, for ``set``, class."""
        known = F.col("op").isin(REMOVE, TOGGLE, SET)
        op = F.when(known, F.col("op")).otherwise(F.raise_error(F.lit("an edit is remove, toggle or set")))
        value = F.col("class").cast("smallint") if "class" in edits.columns else F.lit(None).cast("smallint")
        rows = edits.select(F.lit(self._batch()).alias("batch"), F.col("step").cast("bigint").alias("step"), op.alias("op"), "image_id", F.col("entry_id").cast("bigint").alias("entry_id"), value.alias("class"))
        rows.write.mode("append").parquet(f"{self.path}/edits")

    def append(self, entries: DataFrame) -> None:
        """Entries behind those that were ever there: their own numbers, counted on from the last."""
        last = self._all().groupBy("image_id").agg((F.max("entry_id") + 1).alias("_next"))
        moved = entries.join(last, "image_id", "left").withColumn("entry_id", F.col("entry_id") + F.coalesce("_next", F.lit(0)))
        classed = F.coalesce(F.col("class").cast("smallint"), F.lit(0).cast("smallint")) if "class" in entries.columns else F.lit(0).cast("smallint")
        held = stage(moved.withColumn("class", classed).select(self._all().columns), "appended")
        held.write.parquet(f"{self.path}/entries/batch={self._batch()}")

    def tombstones(self) -> DataFrame:
        """(image_id, block, gone): a bitmap for each block that lost an entry."""
        edits = self._edits()
        if edits is None:
            return self.spark.createDataFrame([], "image_id string, block bigint, gone binary")
        removed = edits.filter(F.col("op") == REMOVE)
        return removed.groupBy("image_id", _block("entry_id").alias("block")).agg(F.bitmap_construct_agg(_bit("entry_id")).alias("gone"))

    def _deltas(self) -> DataFrame:
        """(image_id, entry_id, set_to, flips): the last class set, if any, and how many toggles followed."""
        edits = self._edits()
        if edits is None:
            return self.spark.createDataFrame([], "image_id string, entry_id bigint, set_to smallint, flips int")
        at = F.struct("batch", "step")
        some = edits.filter(F.col("op") != REMOVE).withColumn("at", at)
        sets = some.groupBy("image_id", "entry_id").agg(F.max(F.when(F.col("op") == SET, F.struct("at", "class"))).alias("last"), F.array_sort(F.collect_list(F.when(F.col("op") == TOGGLE, F.col("at")))).alias("toggles"))
        after = F.size(F.filter("toggles", lambda t: F.col("last").isNull() | (t > F.col("last.at"))))
        return sets.select("image_id", "entry_id", F.col("last.class").alias("set_to"), after.alias("flips"))

    def live(self) -> DataFrame:
        """The entries that are left, as they were written."""
        stones = self.tombstones()
        marked = self._all().withColumn("_block", _block("entry_id")).join(stones.withColumnRenamed("block", "_block"), ["image_id", "_block"], "left")
        byte = F.conv(F.hex(F.substring(F.col("gone"), (F.floor(_bit("entry_id") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
        dead = F.coalesce(F.getbit(byte, (_bit("entry_id") % 8).cast("int")) == 1, F.lit(False))
        return marked.filter(~dead).drop("_block", "gone")

    def read(self) -> DataFrame:
        """The entries that are left, with their classes after all edits."""
        merged = self.live().join(self._deltas(), ["image_id", "entry_id"], "left")
        base = F.coalesce("set_to", "class")
        odd = F.col("flips") % 2  # toggled twice, any class but 0 is 1
        flipped = F.when(F.coalesce("flips", F.lit(0)) == 0, base).when(base == 0, odd).otherwise(1 - odd)
        return merged.withColumn("class", flipped.cast("smallint")).select(self._all().columns)

    def _counts(self) -> DataFrame:
        """(image_id, block, before): entries left in the blocks before; a row for each block."""
        lost = self.tombstones().withColumn("lost", F.bitmap_count("gone")).drop("gone")
        sizes = self._all().groupBy("image_id", _block("entry_id").alias("block")).agg(F.count(F.lit(1)).alias("n"))
        left = sizes.join(lost, ["image_id", "block"], "left").withColumn("n", F.col("n") - F.coalesce("lost", F.lit(0)))
        above = Window.partitionBy("image_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        return left.select("image_id", "block", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"), "n")

    def placed(self) -> DataFrame:
        """(image_id, entry_id, place): rank inside a block, after the blocks before."""
        slim = self.live().select("image_id", "entry_id", _block("entry_id").alias("block"))
        rank = F.row_number().over(Window.partitionBy("image_id", "block").orderBy("entry_id")) - 1
        return slim.withColumn("rank", rank).join(self._counts(), ["image_id", "block"]).select("image_id", "entry_id", (F.col("before") + F.col("rank")).alias("place"))

    def at_places(self, places: DataFrame) -> DataFrame:
        """``places`` (image_id, place, ...) with the entry_id that stands there; places past the end go.

        Only blocks that hold a place asked for are ranked.
        """
        where = (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n"))
        blocks = stage(places.withColumnRenamed("image_id", "_im").join(self._counts(), (F.col("_im") == F.col("image_id")) & where).drop("_im"), "places")
        slim = self.live().select("image_id", "entry_id", _block("entry_id").alias("block")).join(blocks.select("image_id", "block").distinct(), ["image_id", "block"], "left_semi")
        rank = F.row_number().over(Window.partitionBy("image_id", "block").orderBy("entry_id")) - 1
        ranked = slim.withColumn("rank", rank)
        out = blocks.withColumn("rank", F.col("place") - F.col("before")).join(ranked, ["image_id", "block", "rank"])
        return out.select(*places.columns, "entry_id")

    def compacted(self, path: str | None = None) -> EditLog:
        """A new store of the merged entries, numbered by place, without a log."""
        target = path or f"{self.path}-{uuid.uuid4().hex}"
        numbered = self.read().join(self.placed(), ["image_id", "entry_id"]).withColumn("entry_id", F.col("place")).drop("place")
        return EditLog.create(numbered, target)
