"""Hard negatives: every anchor's scores against all rows, sorted, in blocks.

Scores are integer inner products of floor(256 x).  Rows and anchors are dealt into
blocks by a hash; each pair of blocks meets in one task, which scores its anchors against
its rows, sorts each anchor's scores (highest first, ties by id) and reads from the order:

1. first, the anchor's best rows of its own label.  The best of all blocks are its positives;
2. then, for each positive, a binary search finds where its upper limit falls among the
   different-label rows, and the next k from there on that reach its lower limit are read.
   The best k of all blocks are its negatives.

A block returns as many rows per anchor as the answer holds at most, and a limit by rank
stands before and after the shuffle, so nothing grows with the size of a label.  Rows
number ROWS_PER_BLOCK a block whatever their vectors, labels or ids, so copies are no hot
group; scores are held for a few anchors at a time (SCORES of them).

Rows with a null label or vector, or with a null, NaN or infinite component, take no part.
Vectors of different lengths have no inner product and never meet.  Null ids sort last and
are no anchors.  Each row counts, also where ids repeat: "other" rows are all but the
anchor's own row.  Scores beyond 64 bits are clamped to its ends.  An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import drop, stage
from .vectors import finite, ids_of, matrix, taken

ROWS_PER_BLOCK = 4096
ANCHORS_PER_BLOCK = 2048
SCORES = 1 << 20
_EXACT = 2.0**53
_ENDS = -(2**63), 2**63 - 1


def _whole(m: np.ndarray) -> np.ndarray:
    """floor(256 x): float64 where that is exact with room for sums, else Python's integers."""
    if np.abs(m).max(initial=0.0) < 2.0**40:
        return np.floor(256.0 * m)
    return np.array([[math.floor(256.0 * x) if abs(x) < 2.0**52 else 256 * int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``a`` with all of ``b`` (results of _whole)."""
    if a.dtype != object and b.dtype != object:
        most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(1, a.shape[1])
        if most < _EXACT:
            return (a @ b.T).astype(np.int64)
    a, b = (x if x.dtype == object else np.vectorize(int, otypes=[object])(x).reshape(x.shape) for x in (a, b))
    return np.array([[min(max(int(sum(x * y)), _ENDS[0]), _ENDS[1]) for y in b] for x in a], np.int64).reshape(len(a), len(b))


class _Block:
    """One block's rows in order of id, scored against anchors a few at a time."""

    def __init__(self, rows: pa.Table):
        ids, keys = ids_of(rows["id"]), rows["key"].to_numpy()
        order = np.lexsort((keys, ids))  # ties of score fall to smaller ids in a stable sort
        self.ids, self.keys, self.labels = ids[order], keys[order], rows["label"].to_numpy()[order]
        self.values = _whole(matrix(rows["vec"])[order])

    def sorted_for(self, anchors: pa.Table):
        """(number of the anchor, its scores highest first, the places of their rows)."""
        values = _whole(matrix(anchors["vec"]))
        step = max(1, SCORES // len(self.ids))
        for at in range(0, len(values), step):
            s = inner(values[at : at + step], self.values)
            order = np.argsort(~s, axis=1, kind="stable")  # ~s falls as s grows, and never overflows
            s = np.take_along_axis(s, order, 1)
            for i in range(len(s)):
                yield at + i, s[i], order[i]


_POSITIVE = "anchor bigint, key bigint, id bigint, score bigint"
_NEGATIVE = "anchor bigint, positive bigint, key bigint, id bigint, score bigint"


def _positives(k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {n: [] for n in ("anchor", "key", "id", "score")}
        if rows.num_rows and anchors.num_rows:
            block, own, labels = _Block(rows), anchors["key"].to_numpy(), anchors["label"].to_numpy()
            for i, s, order in block.sorted_for(anchors):
                fits = np.nonzero((block.labels[order] == labels[i]) & (block.keys[order] != own[i]))[0][:k]
                found = order[fits]
                for name, x in (("anchor", np.full(len(found), own[i])), ("key", block.keys[found]), ("id", block.ids[found]), ("score", s[fits])):
                    out[name].append(x)
        return _table(out)

    return run


def _negatives(k: int, low: int, high: int):
    """Between low and high percent of a positive's score."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {n: [] for n in ("anchor", "positive", "key", "id", "score")}
        if rows.num_rows and anchors.num_rows:
            block, own, labels, positives = _Block(rows), anchors["key"].to_numpy(), anchors["label"].to_numpy(), anchors["positives"].to_pylist()
            for i, s, order in block.sorted_for(anchors):
                other = block.labels[order] != labels[i]
                s, order = s[other], order[other]
                for p in positives[i]:
                    most, least = p["score"] * high // 100, -(-p["score"] * low // 100)
                    a = np.searchsorted(~s, ~np.int64(most))
                    b = min(a + k, int(np.searchsorted(~s, ~np.int64(least), "right")))
                    if a < b:
                        found = order[a:b]
                        for name, x in (("anchor", np.full(b - a, own[i])), ("positive", np.full(b - a, p["key"])), ("key", block.keys[found]), ("id", block.ids[found]), ("score", s[a:b])):
                            out[name].append(x)
        return _table(out)

    return run


def _table(out: dict[str, list[np.ndarray]]) -> pa.Table:
    whole = {n: np.concatenate(x) if x else np.zeros(0, np.int64) for n, x in out.items()}
    return pa.table({n: pa.array(x, mask=x == 2**63 - 1) if n == "id" else pa.array(x) for n, x in whole.items()})


def _dealt(df: DataFrame, blocks: int, name: str) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))


def _against(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, run, schema: str) -> DataFrame:
    """Every block of anchors against every block of rows of its length."""
    rb, ab = -(-n_rows // ROWS_PER_BLOCK), -(-n_anchors // ANCHORS_PER_BLOCK)
    left = _dealt(rows, rb, "rb").withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(ab - 1))))
    right = _dealt(anchors, ab, "ab").withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(rb - 1))))
    keys = ["dim", "rb", "ab"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _first(df: DataFrame, k: int, *of: str) -> DataFrame:
    order = Window.partitionBy(*of).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "key")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    asked: Column,
    positives: int = 5,
    k: int = 10,
    low: int = 30,
    high: int = 90,
    label: Column | None = None,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose ``id`` satisfies ``asked``; positives are their best rows of
    the same label, and negatives the first k of other labels whose scores lie between
    ``low`` and ``high`` percent of the positive's.  ``label`` may replace the label, as an
    expression over ``id`` and ``label``.
    """
    rows = taken(vectors, id=id_col, vec=vec_col, label=label_col).filter(finite(F.col("vec")) & F.col("label").isNotNull())
    named = (F.col("label") if label is None else label).cast("bigint")
    rows = rows.select(F.col("id").cast("bigint").alias("id"), named.alias("label"), "vec", F.size("vec").alias("dim"), F.monotonically_increasing_id().alias("key"))
    rows = stage(rows, "negatives-rows")
    mine = F.coalesce(asked, F.lit(False))
    n_rows, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if(mine)).first()
    anchors = rows.filter(mine)
    found = _against(rows, anchors.select("key", "label", "vec", "dim"), max(1, n_rows), max(1, n_anchors), _positives(positives), _POSITIVE)
    best = _first(found, positives, "anchor").groupBy("anchor").agg(F.collect_list(F.struct("key", "id", "score")).alias("positives"))  # as many as asked for
    anchors = stage(anchors.join(best, anchors["key"] == best["anchor"]).select(rows.columns + ["positives"]), "negatives-anchors")
    found = _against(rows, anchors.select("key", "label", "vec", "dim", "positives"), max(1, n_rows), max(1, n_anchors), _negatives(k, low, high), _NEGATIVE)
    best = stage(_first(found, k, "anchor", "positive"), "negatives-found")
    drop(rows)
    pairs = anchors.select(F.col("key").alias("anchor"), F.col("id").alias("anchor_id"), F.explode("positives").alias("p"))
    pairs = pairs.select("anchor", "anchor_id", F.col("p.key").alias("positive"), F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return pairs.join(best, ["anchor", "positive"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
