"""Ridge lines: ordered paths through two-sided cells, by a tree of blocks.

Each two-sided cell gives two arcs, one per direction (enter by one side, leave by
the other).  An arc's successor is the arc that enters the neighbour by the shared
edge.  A task takes the arcs of a block of cells, follows them in numpy and keeps what
leaves the block; the next level takes those of FAN x FAN blocks as one, and so on until
nothing leaves.  On the way down every arc gets from its block's exit what that exit found
above.  So there is a grouping and a join for each level up and a join for each level down,
over exits whose number falls with the perimeter of the blocks; no task walks a line.

Open lines start at the row-major smaller end cell (a single cell at its first
side).  Closed ones start at their smallest cell, first step preferring N, S, W, E.
Points: the first cell's entry, then every cell's exit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import drop, stage
from .detect import numbered, two_sided

BLOCK = 256  # cells a side
FAN = 8  # blocks a side that the next level takes as one
_STEP = "CASE {bit} WHEN 1 THEN 0 WHEN 4 THEN 1 WHEN 2 THEN 2 ELSE 3 END"


def arcs(edges: DataFrame, dims: DataFrame) -> DataFrame:
    """arc, twin (the other direction), cell, bits and edges entered and left, their points."""
    c = two_sided(edges, dims).join(dims, "image_id")
    cell = F.col("row").cast("bigint") * F.col("cols") + F.col("col")
    way = F.struct(F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.lit(1).alias("i"), F.lit(0).alias("o"))
    c = c.select("image_id", "row", "col", "cols", cell.alias("cell"), "sides", F.explode(F.array(*way)).alias("way"))
    side = lambda k: F.col("sides")[F.col(f"way.{k}")]
    edge = lambda s: (s["er"].cast("bigint") * F.col("cols") + s["ec"]) * 2 + F.when(s["ed"] == "N", 0).otherwise(1)
    return c.select(
        "image_id", "row", "col", "cell", (F.col("cell") * 2 + F.col("way.i")).alias("arc"), (F.col("cell") * 2 + F.col("way.o")).alias("twin"),
        side("i")["bit"].alias("in_bit"), side("o")["bit"].alias("out_bit"), edge(side("i")).alias("in_edge"), edge(side("o")).alias("out_edge"), side("i")["point"].alias("in_point"), side("o")["point"].alias("out_point"),
    )


def block_of(row: Column, col: Column) -> Column:
    """Row of the block and its column in one number."""
    return F.shiftleft(F.floor(row / BLOCK).cast("bigint"), 32) + F.floor(col / BLOCK).cast("bigint")


def _above(block: Column) -> Column:
    """The block of the next level."""
    return F.shiftleft(F.floor(F.shiftright(block, 32) / FAN).cast("bigint"), 32) + F.floor(block.bitwiseAND(F.lit(2**32 - 1)) / FAN).cast("bigint")


def _walked(last: np.ndarray, steps: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Successors, steps and minima on the way, as far ahead as there are arcs at least."""
    for _ in range(len(last).bit_length()):
        steps, low, last = steps + steps[last], np.minimum(low, low[last]), last[last]
    return last, steps, low


_NONE = np.iinfo(np.int64).max
_LINK = "image_id string, arc bigint, nxt bigint, dist bigint, low bigint, last bigint, block bigint, next_block bigint"
_FOLLOWED = "image_id string, arc bigint, up bigint, last bigint, dist bigint, low bigint, open boolean"


def _follow(first_level: bool):
    """Every arc of a block to where its path leaves the block (``up``) or ends (``last``).

    ``low`` is the least of the arcs passed, the one that leaves not among them.  Rings have
    neither: on the first level dist is the place from the arc that has the ring's low,
    which no other arc of the image shares; above, only the low is told, and last is the arc.
    """

    def run(links: pa.Table) -> pa.Table:
        links = links.combine_chunks()
        numbers = lambda c, null=0: links[c].fill_null(null).to_numpy()
        arc, nxt, own, dist, end = numbers("arc"), numbers("nxt", -1), numbers("low"), numbers("dist"), numbers("last", -1)
        order = np.argsort(arc)
        at = order[np.minimum(np.searchsorted(arc, nxt, sorter=order), len(arc) - 1)]
        goes = arc[at] == nxt
        last = np.where(goes, at, np.arange(len(arc)))
        last, steps, low = _walked(last, np.where(goes, dist, 0), np.where(goes, own, _NONE))
        ring = goes[last]  # still under way after as many steps as there are arcs
        if first_level and ring.any():
            start = ring & (own == low)
            on = ring & ~start[at]
            _, left, _ = _walked(np.where(on, at, np.arange(len(arc))), on.astype(np.int64), low)
            first = np.nonzero(start)[0]
            first = first[np.argsort(low[first])]
            steps[ring] = left[first[np.searchsorted(low[first], low[ring])]] - left[ring]
        ended = (end[last] >= 0) & ~ring
        steps = np.where(ended, steps + dist[last], steps)
        low = np.where(ended, np.minimum(low, own[last]), low)
        ends = np.where(ring, arc, end[last])
        columns = {
            "image_id": pa.array([links["image_id"][0].as_py()] * len(arc), pa.string()),
            "arc": pa.array(arc),
            "up": pa.array(arc[last], mask=ring | ended),
            "last": pa.array(ends, mask=~ended & ~(ring & (not first_level))),
            "dist": pa.array(steps),
            "low": pa.array(low, mask=low == _NONE),
            "open": pa.array(~ring),
        }
        return pa.table(columns)

    return run


def _level(links: DataFrame, first: bool) -> DataFrame:
    return stage(links.drop("next_block").groupBy("image_id", "block").applyInArrow(_follow(first), _FOLLOWED), "line-level")


def ranked(links: DataFrame) -> DataFrame:
    """(image_id, arc, last, dist, low, open) from (image_id, arc, nxt, low, block, next_block).

    last: the arc where the path ends, dist: steps to it, low: least ``low`` on the way;
    open is false on cycles, where low is the whole cycle's.  On cycles inside a block last
    is null and dist is the place from the arc with the least ``low``.
    """
    ends = F.col("nxt").isNull()
    now = links.select("image_id", "arc", "nxt", F.when(ends, 0).otherwise(1).cast("bigint").alias("dist"), "low", F.when(ends, F.col("arc")).alias("last"), "block", "next_block")
    levels = [_level(now, True)]
    while True:
        away = now.filter("nxt is not null and block <> next_block")
        there = levels[-1].select("image_id", F.col("arc").alias("nxt"), F.col("up").alias("nxt2"), F.col("last").alias("last2"), F.col("dist").alias("dist2"), F.col("low").alias("low2"))
        far = away.drop("last").join(there, ["image_id", "nxt"])
        before, now = now, stage(
            far.select(
                "image_id", "arc", F.col("nxt2").alias("nxt"), (F.col("dist") + F.col("dist2")).alias("dist"), F.least("low", "low2").alias("low"), F.col("last2").alias("last"),
                _above(F.col("block")).alias("block"), _above(F.col("next_block")).alias("next_block"),
            ),
            "line-exits",
        )
        if len(levels) > 1:
            drop(before)
        if not now.head(1):
            break
        levels.append(_level(now, False))
    found = levels.pop()
    while levels:
        below = levels.pop()
        over = found.select("image_id", F.col("arc").alias("up"), F.col("last").alias("last2"), F.col("dist").alias("dist2"), F.col("low").alias("low2"), F.col("open").alias("open2"))
        joined = below.filter("up is not null").drop("last", "open").join(over, ["image_id", "up"])
        through = joined.select("image_id", "arc", F.col("last2").alias("last"), (F.col("dist") + F.col("dist2")).alias("dist"), F.least("low", "low2").alias("low"), F.col("open2").alias("open"))
        found = below.filter("up is null").drop("up").unionByName(through)
    return stage(found.select("image_id", "arc", "last", "dist", "low", "open"), "line-ranks")


def line_points(edges: DataFrame, dims: DataFrame) -> DataFrame:
    """image_id, line_cell, pos, row_fx, col_fx, brightness, strength; one row per point."""
    a = stage(arcs(edges, dims), "line-arcs")
    block = block_of(F.col("row"), F.col("col"))
    enter = a.select(F.col("image_id").alias("image2"), F.col("in_edge").alias("edge2"), F.col("arc").alias("nxt"), F.col("cell").alias("c2"), block.alias("next_block"))
    key = F.col("cell") * 4 + F.expr(_STEP.format(bit="out_bit"))
    out = a.select("image_id", "out_edge", "arc", "cell", key.alias("low"), block.alias("block"))
    met = out.join(enter, (F.col("image_id") == F.col("image2")) & (F.col("out_edge") == F.col("edge2")) & (F.col("c2") != F.col("cell")), "left")
    links = stage(met.select("image_id", "arc", "nxt", "low", "block", "next_block"), "line-links")
    ranks = ranked(links)

    # the ranks of a cell's two arcs as one row
    half = lambda k: F.max(F.when(F.col("arc") % 2 == k, F.struct("last", "dist", "low", "open"))).alias(f"r{k}")
    pairs = ranks.groupBy("image_id", F.expr("arc div 2").alias("cell")).agg(half(0), half(1))
    mine, other = (F.when(F.col("arc") % 2 == k, F.col("r0")).otherwise(F.col("r1")) for k in (0, 1))
    both = a.join(pairs, ["image_id", "cell"]).withColumns({"mine": mine, "other": other}).drop("r0", "r1")
    both = both.select("*", "mine.*", *[F.col(f"other.{c}").alias(f"t_{c}") for c in ("last", "dist", "low")]).drop("mine", "other")
    first, final = F.expr("t_last div 2"), F.expr("last div 2")
    forward = (first < final) | ((first == final) & (F.col("in_bit") < F.col("out_bit")))
    opened = both.filter(F.col("open") & forward).withColumns({"line_cell": first, "pos": F.col("t_dist")})

    keep = ["image_id", "line_cell", "pos", "in_point", "out_point"]
    path = opened.select(keep)
    closed = both.filter(~F.col("open") & (F.col("low") < F.col("t_low"))).withColumn("line_cell", F.expr("low div 4"))
    path = path.unionByName(closed.filter("last is null").withColumn("pos", F.col("dist")).select(keep))
    if ranks.filter("not open and last is not null").head(1):
        path = path.unionByName(_across(closed.filter("last is not null"), links).select(keep))
    at = F.when(F.col("pos") == 0, F.array(F.struct(F.lit(0).cast("bigint").alias("pos"), F.col("in_point").alias("p")), F.struct(F.lit(1).cast("bigint").alias("pos"), F.col("out_point").alias("p"))))
    at = at.otherwise(F.array(F.struct((F.col("pos") + 1).alias("pos"), F.col("out_point").alias("p"))))
    out = path.select("image_id", "line_cell", F.explode(at).alias("x"))
    return out.select("image_id", "line_cell", F.col("x.pos").alias("pos"), "x.p.row_fx", "x.p.col_fx", "x.p.brightness", "x.p.strength")


def _across(closed: DataFrame, links: DataFrame) -> DataFrame:
    """Arcs of cycles through several blocks, in their canonical direction, with their pos from line_cell."""
    cut = closed.filter("cell = line_cell").select("image_id", F.col("arc").alias("nxt"), F.lit(True).alias("start"))
    ring = closed.select("image_id", "arc").join(links.drop("low"), ["image_id", "arc"]).join(cut, ["image_id", "nxt"], "left")
    ring = ring.select("image_id", "arc", F.when(F.col("start").isNull(), F.col("nxt")).alias("nxt"), F.lit(0).cast("bigint").alias("low"), "block", "next_block")
    steps = ranked(stage(ring, "line-rings")).select("image_id", "arc", F.col("last").alias("stop"), F.col("dist").alias("left"))
    lengths = steps.groupBy("image_id", "stop").agg(F.max("left").alias("most"))
    return closed.join(steps.join(lengths, ["image_id", "stop"]), ["image_id", "arc"]).withColumn("pos", F.col("most") - F.col("left"))


def lines(edges: DataFrame, dims: DataFrame) -> DataFrame:
    """image_id, entry_id, points: row-major by start cell, points in order.

    A line's points are one value by the data model; everything before and most of
    what follows works on ``line_points``.
    """
    pts = line_points(edges, dims)
    one = F.struct("pos", F.struct("row_fx", "col_fx", "brightness", "strength").alias("p"))
    by = pts.groupBy("image_id", "line_cell").agg(F.array_sort(F.collect_list(one)).alias("ps")).join(dims, "image_id")
    by = by.withColumns({"row": F.expr("cast(line_cell div cols as int)"), "col": F.expr("cast(line_cell % cols as int)")})
    return numbered(by, "col").select("image_id", "entry_id", F.transform("ps", lambda x: x["p"]).alias("points"))
