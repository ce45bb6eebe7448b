"""Nearest neighbours by cosine: vantage-point trees per shard, pruned by the triangle inequality.

The angle between vectors is a metric.  If all rows of a node lie between lo and hi from
its vantage point and a query lies at a, no row of it is nearer than max(lo - a, a - hi).
A node is passed over where ``factor`` times that bound exceeds the angle of the query's
last neighbour so far: factor 1 is exact, larger ones see fewer rows and may lose some.

1. Of rows with equal vectors only the k+1 smallest ids can be in an answer, so only they
   are indexed (a limit inside each map task, then one per vector); the answer counts all.
2. A top tree, fitted on SAMPLE rows drawn by hash, deals every row to a cell; the angles of
   a cell's rows from the vantage points above it are kept as exact intervals over all rows.
   A cell of more than ROWS_PER_TREE rows is several parts, dealt by hash.
3. Each (cell, part) becomes one tree: a row of the staged index with vectors in leaf order.
4. Distinct query vectors search their own cell first.  With the angle that this gives them
   they go to the other cells which the bound does not exclude.  Trees and blocks of queries
   meet by an equi-join on (cell, part, block); every tree answers with at most k+1 rows.
5. Scores are computed per pair from the original vectors, in one order of summing, so
   equal vectors score equally.

The driver holds the sample (16 MB at 64 dimensions) and one row of intervals per cell
(MOST_CELLS of them).  Vectors that are null, empty or zero or hold null, NaN or infinity
take no part.  Vectors of different lengths are never compared.  Null ids sort last and
are no queries; rows equal in id and vector are told apart by count.  Ties go to smaller
ids.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import drop, stage
from .skew import join_groups
from .vectors import finite, floats, ids_of, lengths_of, matrix, scaled, taken

ROWS_PER_TREE = 4096
QUERIES_PER_BLOCK = 2048
SAMPLE = 16384
MOST_CELLS = SAMPLE // 8
LEAF = 64
FACTOR = 2.0  # finds 0.93 and more of the true neighbours of normal noise in 2 to 64 dimensions, 0.999 in 64
_SLACK = 1e-6  # of angles, for rounding near 0
_TRIES = 5  # vantage points looked at for one
_FOUND = "qn bigint, id bigint, score double, same boolean"
_TREE = "cell int, part int, dim int, ids array<bigint>, vecs binary, starts array<int>, points array<int>, above binary, lo binary, hi binary"
_NULL_ID = 2**63 - 1


def _units(m: np.ndarray) -> np.ndarray:
    m = scaled(m)
    return m / lengths_of(m)[:, None]


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows of two scaled matrices."""
    return (a * b).sum(axis=1) / (lengths_of(a) * lengths_of(b))


def _vantage(units: np.ndarray, rng: np.random.Generator) -> int:
    """Of a few rows the one that spreads the others most."""
    tried = rng.choice(len(units), min(_TRIES, len(units)), replace=False)
    seen = units[rng.choice(len(units), min(256, len(units)), replace=False)]
    return int(tried[np.argmax(_angle(seen @ units[tried].T).std(axis=0))])


@dataclass(frozen=True)
class TopTree:
    """A complete binary tree over sampled vantage points of one length; its leaves are cells."""

    points: np.ndarray
    middle: np.ndarray
    depth: int

    @classmethod
    def fitted(cls, units: np.ndarray, depth: int) -> TopTree:
        rng = np.random.default_rng(17)
        points, middle = np.zeros(((1 << depth) - 1, units.shape[1])), np.full((1 << depth) - 1, np.inf)
        held = {0: np.arange(len(units))}
        for node in range((1 << depth) - 1):
            rows = held.pop(node, np.zeros(0, np.int64))
            if len(rows):
                points[node] = units[rows[_vantage(units[rows], rng)]]
                a = _angle(units[rows] @ points[node])
                if a.min() < np.median(a) or a.max() > np.median(a):  # else all rows stay on one side
                    middle[node] = np.median(a)
                held |= {2 * node + 1: rows[a <= middle[node]], 2 * node + 2: rows[a > middle[node]]}
        return cls(points, middle, depth)

    def dealt(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row, and its angles from the vantage points passed."""
        node, passed = np.zeros(len(units), np.int64), np.zeros((len(units), self.depth))
        for level in range(self.depth):
            a = passed[:, level] = _angle((units * self.points[node]).sum(axis=1))
            node = 2 * node + 1 + (a > self.middle[node])
        return node - ((1 << self.depth) - 1), passed

    def bounds(self, units: np.ndarray, cells: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """(query, cell): no row of the cell is nearer than this."""
        if not self.depth:
            return np.zeros((len(units), len(cells)))
        a = _angle(units @ self.points.T)
        out = np.zeros((len(units), len(cells)))
        for level in range(self.depth):
            passed = a[:, ((cells + (1 << self.depth)) >> (self.depth - level)) - 1]
            out = np.maximum(out, np.maximum(lo[:, level] - passed, passed - hi[:, level]))
        return out


@dataclass(frozen=True)
class Cells:
    """Top trees by length of vector.  Cells of one length are numbered on from ``first``; lengths outside the sample have cell -length."""

    trees: dict[int, TopTree]
    first: dict[int, int]
    bounds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def dealt(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        dim = m.shape[1]
        if dim not in self.trees:
            return np.full(len(m), -dim), None
        cell, passed = self.trees[dim].dealt(_units(m))
        return cell + self.first[dim], passed

    def others(self, m: np.ndarray, home: np.ndarray, reach: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) to visit: every cell but its own within ``reach``, an angle, of a query."""
        dim = m.shape[1]
        if dim not in self.trees:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cells, lo, hi = self.bounds[dim]
        near = factor * (self.trees[dim].bounds(_units(m), cells - self.first[dim], lo, hi) - _SLACK) <= reach[:, None]
        q, c = np.nonzero(near & (cells[None, :] != home[:, None]))
        return q, cells[c]


def _grown(units: np.ndarray, rows: np.ndarray, above: list[int], rng: np.random.Generator) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Leaves of a tree as (rows, vantage points above); halves by rank, so equal angles part too."""
    if len(rows) <= LEAF:
        yield rows, above
        return
    point = rows[_vantage(units[rows], rng)]
    order = np.argsort(_angle(units[rows] @ units[point]), kind="stable")
    half = len(rows) // 2
    for side in (order[:half], order[half:]):
        yield from _grown(units, rows[side], [*above, int(point)], rng)


def _tree(table: pa.Table) -> pa.Table:
    """A part's rows as one row of the index."""
    vecs, ids = matrix(table["vec"]), ids_of(table["id"])
    start = np.lexsort((ids, *vecs.T[::-1]))  # the same tree whatever the order of arrival
    vecs, ids = vecs[start], ids[start]
    units = _units(vecs)
    leaves = list(_grown(units, np.arange(len(vecs)), [], np.random.default_rng(11)))
    order = np.concatenate([rows for rows, _ in leaves])
    place = np.argsort(order)
    depth = max(len(above) for _, above in leaves)
    above, lo, hi = np.zeros((len(leaves), depth), np.int32), np.full((len(leaves), depth), -np.inf), np.full((len(leaves), depth), np.inf)
    points: dict[int, int] = {}
    for i, (rows, path) in enumerate(leaves):
        if path:
            a = _angle(units[rows] @ units[path].T)
            n = len(path)
            above[i, :n], lo[i, :n], hi[i, :n] = [points.setdefault(p, len(points)) for p in path], a.min(axis=0), a.max(axis=0)
    return pa.table(
        {
            "cell": pa.array([table["cell"][0].as_py()], pa.int32()),
            "part": pa.array([table["part"][0].as_py()], pa.int32()),
            "dim": pa.array([vecs.shape[1]], pa.int32()),
            "ids": pa.array([ids[order]], pa.list_(pa.int64())),
            "vecs": pa.array([vecs[order].tobytes()], pa.binary()),
            "starts": pa.array([np.cumsum([0, *(len(rows) for rows, _ in leaves)])], pa.list_(pa.int32())),
            "points": pa.array([place[list(points)] if points else []], pa.list_(pa.int32())),
            "above": pa.array([above.tobytes()], pa.binary()),
            "lo": pa.array([lo.tobytes()], pa.binary()),
            "hi": pa.array([hi.tobytes()], pa.binary()),
        }
    )


@dataclass(frozen=True)
class Tree:
    """A row of the index, opened."""

    vecs: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    points: np.ndarray
    above: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    @classmethod
    def opened(cls, row: dict) -> Tree:
        leaves = len(row["starts"]) - 1
        part = lambda name, kind: np.frombuffer(row[name], kind).reshape(leaves, -1)
        vecs = np.frombuffer(row["vecs"], np.float64).reshape(len(row["ids"]), row["dim"])
        return cls(vecs, np.array(row["ids"], np.int64), np.array(row["starts"]), np.array(row["points"], np.int64), part("above", np.int32), part("lo", np.float64), part("hi", np.float64))

    def bounds(self, units: np.ndarray, mine: np.ndarray) -> np.ndarray:
        out = np.zeros((len(units), len(self.starts) - 1))
        if self.above.shape[1]:
            a = _angle(units @ mine[self.points].T)
            for level in range(self.above.shape[1]):
                passed = a[:, self.above[:, level]]
                out = np.maximum(out, np.maximum(self.lo[:, level] - passed, passed - self.hi[:, level]))
        return out

    def search(self, queries: np.ndarray, least: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, row, score) of the best k rows scoring ``least`` or more, and how many rows were looked at.

        Each query opens its leaves from the nearest bound on, until a bound is too far.
        """
        held, asked = scaled(self.vecs), scaled(queries)
        mine, units = _units(self.vecs), _units(queries)
        bound = self.bounds(units, mine)
        order = np.argsort(bound, axis=1, kind="stable")
        last, looked = least.copy(), 0
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for turn in range(order.shape[1]):
            leaf = order[:, turn]
            open_ = np.nonzero(factor * (bound[np.arange(len(queries)), leaf] - _SLACK) <= _angle(last))[0]
            if not len(open_):
                break
            by = open_[np.argsort(leaf[open_], kind="stable")]
            found = [best]
            for group in np.split(by, np.nonzero(np.diff(leaf[by]))[0] + 1):
                a, b = self.starts[leaf[group[0]]], self.starts[leaf[group[0]] + 1]
                looked += len(group) * (b - a)
                q, r = np.nonzero(units[group] @ mine[a:b].T >= last[group][:, None] - _SLACK * _SLACK)
                q, r = group[q], r + a
                found.append((q, r, scores(asked[q], held[r])))
            q, r, s = (np.concatenate(x) for x in zip(*found))
            keep = np.lexsort((self.ids[r], -s, q))
            q, r, s = q[keep], r[keep], s[keep]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            best = q[rank < k], r[rank < k], s[rank < k]
            full = rank == k - 1
            last[q[full]] = np.maximum(last[q[full]], s[full])
        return *best, looked


def _searching(k: int, factor: float):
    def run(trees: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows:
            queries, numbers = matrix(asked["vec"]), asked["qn"].to_numpy()
            for row in trees.to_pylist():
                tree = Tree.opened(row)
                q, r, s, _ = tree.search(queries, asked["least"].to_numpy(), k, factor)
                out.append((numbers[q], tree.ids[r], s, (queries[q] == tree.vecs[r]).all(axis=1)))
        qn, ids, s, same = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
        return pa.table({"qn": pa.array(qn), "id": pa.array(ids, mask=ids == _NULL_ID), "score": pa.array(s), "same": pa.array(same)})

    return run


def _numbers(of: dict[int, int], key: Column) -> Column:
    """A small map of the driver's as a lookup; absent keys are null."""
    text = ",".join(f"{a}:{b}" for a, b in of.items())
    return F.try_element_at(F.str_to_map(F.lit(text), F.lit(","), F.lit(":")), key.cast("string")).cast("int")


@dataclass(frozen=True)
class Index:
    trees: DataFrame
    cells: Cells
    parts: dict[int, int]


def index(rows: DataFrame, copies: int, rows_per_tree: int = ROWS_PER_TREE) -> Index:
    """The trees of all rows (id, vec); of equal vectors the ``copies`` smallest ids stand for all."""
    same = Window.partitionBy("_h", "vec").orderBy(F.col("id").asc_nulls_last())
    slim = rows.withColumn("_h", F.xxhash64("vec")).withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= copies).select("id", "vec", "_h")
    slim = stage(slim, "vantage-rows")
    total = slim.count()
    drawn = slim.orderBy(F.xxhash64("_h", "id"), "_h", "id").limit(SAMPLE).select("vec").toArrow()["vec"]
    trees, first, at = {}, {}, 0
    for places, m in floats(drawn):
        share = total * len(places) / max(1, len(drawn))
        depth = int(min(MOST_CELLS * len(places) // max(1, len(drawn)), -(-share // rows_per_tree)) - 1).bit_length() if share > rows_per_tree else 0
        trees[m.shape[1]], first[m.shape[1]] = TopTree.fitted(_units(m), depth), at
        at += 1 << depth
    cells = Cells(trees, first)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, m in floats(batch["vec"]):
                cell, angles = cells.dealt(m)
                depth = 0 if angles is None else angles.shape[1]
                passed = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * depth), pa.array(angles.ravel() if depth else np.zeros(0)))
                some = batch.select(["id", "vec"]).take(pa.array(places))
                yield pa.RecordBatch.from_pydict({"id": some["id"], "vec": some["vec"], "cell": pa.array(cell.astype(np.int32)), "passed": passed})

    kind = slim.schema["vec"].dataType.simpleString()
    dealt = stage(slim.select("id", "vec").mapInArrow(deal, f"id bigint, vec {kind}, cell int, passed array<double>"), "vantage-dealt")
    drop(slim)
    deepest = max((t.depth for t in trees.values()), default=0)
    ends = [f(F.get("passed", F.lit(i))).alias(f"{n}{i}") for i in range(deepest) for n, f in (("lo", F.min), ("hi", F.max))]
    stats = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends).collect()  # MOST_CELLS rows, and one per length outside the sample
    for dim, tree in trees.items():
        own = [r for r in stats if first[dim] <= r["cell"] < first[dim] + (1 << tree.depth)]
        limits = [np.array([[r[f"{n}{i}"] for i in range(tree.depth)] for r in own]).reshape(len(own), tree.depth) for n in ("lo", "hi")]
        cells.bounds[dim] = (np.array([r["cell"] for r in own], np.int64), *limits)
    parts = {r["cell"]: -(-r["n"] // rows_per_tree) for r in stats}
    many = {c: p for c, p in parts.items() if p > 1}
    part = F.pmod(F.xxhash64("id", "vec"), F.coalesce(_numbers(many, F.col("cell")), F.lit(1))).cast("int")
    built = stage(dealt.select("cell", part.alias("part"), "id", "vec").groupBy("cell", "part").applyInArrow(_tree, _TREE), "vantage-trees")
    drop(dealt)
    return Index(built, cells, parts)


def _asked(found: Index, queries: DataFrame, k: int, factor: float) -> DataFrame:
    """``_FOUND`` rows of queries (qn, vec, least, cell), each of which sees all parts of its cell."""
    counts = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per cell
    blocks = {c: b for c, n in counts.items() if (b := -(-n // QUERIES_PER_BLOCK)) > 1}
    spread = F.coalesce(_numbers(blocks, F.col("cell")), F.lit(1))
    many = F.coalesce(_numbers({c: p for c, p in found.parts.items() if p > 1}, F.col("cell")), F.lit(1))
    right = queries.withColumn("block", F.pmod(F.xxhash64("qn"), spread).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), many - 1)))
    left = found.trees.filter(F.col("cell").isin(*counts)) if len(counts) < 200 else found.trees
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), spread - 1)))
    keys = ["cell", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_searching(k, factor), _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qn").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= k)


def nearest(vectors: DataFrame, asked: Column, k: int = 5, factor: float = FACTOR, id_col: str = "vec_id", vec_col: str = "embedding", rows_per_tree: int = ROWS_PER_TREE) -> DataFrame:
    """query_id, rank (from 1), id, score: the k nearest other rows of every row whose id satisfies ``asked``.

    ``asked`` is a condition on the column ``id``.
    """
    if factor < 1:
        raise ValueError("factor must be 1 or more")
    rows = taken(vectors, id=id_col, vec=vec_col).withColumn("id", F.col("id").cast("bigint"))
    rows = rows.filter(finite(F.col("vec")) & F.exists("vec", lambda x: x != 0))
    found = index(rows, k + 1, rows_per_tree)
    cells = found.cells
    wanted = rows.filter(F.coalesce(asked, F.lit(False))).withColumn("h", F.xxhash64("vec"))
    kind = rows.schema["vec"].dataType.simpleString()

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            for places, m in floats(batch["vec"]):
                cell[places] = cells.dealt(m)[0]
            yield pa.RecordBatch.from_pydict({n: batch[n] for n in ("h", "vec", "size")} | {"cell": pa.array(cell)})

    distinct = wanted.groupBy("h", "vec").agg(F.count(F.lit(1)).alias("size"))
    queries = stage(distinct.mapInArrow(home, f"h bigint, vec {kind}, size bigint, cell int").withColumn("qn", F.monotonically_increasing_id()), "vantage-queries")
    near = stage(_best(_asked(found, queries.select("qn", "vec", F.lit(-1.0).alias("least"), "cell"), k + 1, factor), k + 1), "vantage-near")
    if sum(len(b[0]) for b in cells.bounds.values()) > 1:

        def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for places, m in floats(batch["vec"]):
                    own, least = (batch[n].to_numpy()[places] for n in ("cell", "least"))
                    q, c = cells.others(m, own, _angle(least), factor)
                    some = batch.select(["qn", "vec", "least"]).take(pa.array(places[q]))
                    yield pa.RecordBatch.from_pydict({n: some[n] for n in ("qn", "vec", "least")} | {"cell": pa.array(c.astype(np.int32))})

        last = near.filter(F.col("at") == k + 1).select("qn", F.col("score").alias("least"))
        going = queries.select("qn", "vec", "cell").join(last, "qn", "left").fillna(-1.0, ["least"])
        going = stage(going.mapInArrow(far, f"qn bigint, vec {kind}, least double, cell int"), "vantage-going")
        near = near.drop("at").unionByName(_asked(found, going, k + 1, factor))
        near = _best(near, k + 1)
    lists = near.groupBy("qn").agg(F.sort_array(F.collect_list(F.struct("at", "id", "score", "same"))).alias("found"))  # k + 1 at most
    answers = stage(queries.select("qn", "h", "vec", "size").join(lists, "qn"), "vantage-answers")
    total = answers.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    each = join_groups(wanted.select("id", "h", "vec"), answers.select("h", "vec", "size", "found"), ["h", "vec"], "size", total)
    mine = F.array_position(F.transform("found", lambda x: x["same"] & F.coalesce(x["id"] == F.col("id"), F.lit(False))), F.lit(True))
    kept = F.slice(F.filter("found", lambda x, i: i + 1 != F.col("mine")), 1, k)
    out = each.withColumn("mine", mine).select(F.col("id").alias("query_id"), F.posexplode(kept).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))
