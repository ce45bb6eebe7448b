"""A Merkle manifest of a table: a leaf per row, a tree per group, a root over groups.

1. One scan hashes every row (and, where asked, a tampered form of it) to a slim leaf.
2. Leaves get their place inside their group: rows are dealt by ranges of (group, id, leaf,
   number) and sorted there; a range's rows of a group start after those of the ranges
   before it.  No task sorts a whole group, however large it is.
3. BUCKET consecutive places are one aligned subtree.  Executors hand whole buckets, a few
   at a time as Arrow tables, to DuckDB, whose level queries (ordered string_agg and sha256)
   give the bucket's root, every leaf's siblings up to it, and the leaf folded along them.
4. Spark combines the roots of buckets the same way, BUCKET at a time, until each group has
   one node, and then the groups' nodes in order of the group.  Paths from a bucket to the
   root are joined to its rows and finish proofs and folds.

A node without a sibling is hashed alone.  A group of one leaf has that leaf as its node.

Cases: a null group comes first, groups are ordered by their UTF-8 bytes; null ids come
last in their group; rows that are equal in id are ordered by leaf, equal leaves are
interchangeable.  Null values are written "-".  An empty table gives an empty result.
Texts are hashed whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import drop, stage
from .vectors import taken

LEVELS = 12
BUCKET = 1 << LEVELS
ROWS_PER_TASK = 2 * BUCKET
ROWS_PER_RANGE = 1 << 20
_INNER = "tree string, bucket bigint, id bigint, leaf binary, siblings binary, fold binary, root binary"


def _hex(column: str) -> Column:
    return F.lower(F.hex(column))


def field(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def placed(rows: DataFrame, tree: str, order: list[str], ranges: int) -> DataFrame:
    """``rows`` with ``at`` (place inside the tree, from 0) and ``total`` (the tree's rows).

    Staged: a row's number holds its range and its place there.
    """
    by = [tree, *[F.col(c).asc_nulls_last() for c in order]]
    dealt = stage(rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_no", F.monotonically_increasing_id()), "merkle-placed")
    dealt = dealt.withColumn("_range", F.shiftright("_no", 33))
    runs = dealt.groupBy("_range", tree).agg(F.count(F.lit(1)).alias("_n"), F.min("_no").alias("_first"))  # a row per range and tree in it
    before = Window.partitionBy(tree).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_range", tree, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(tree)).alias("total"))
    out = dealt.join(runs, ["_range", tree]).withColumn("at", F.col("_before") + F.col("_no") - F.col("_first"))
    return out.drop("_range", "_no", "_first", "_before")


def _levels(total: Column) -> Column:
    """Levels from so many nodes up to one."""
    return F.length(F.bin(total - 1)) * F.when(total > 1, 1).otherwise(0)


def _folded(table: pa.Table) -> pa.Table:
    """Whole buckets (tree, bucket, i, id, leaf, tampered, levels), folded level by level in DuckDB."""
    import duckdb

    with duckdb.connect(config={"threads": 1}) as db:
        db.execute("SET TimeZone = 'UTC'")
        db.register("given", table)
        db.execute("CREATE TABLE node AS SELECT dense_rank() OVER (ORDER BY tree, bucket) AS b, i, levels, lower(hex(leaf)) AS h FROM given")
        db.execute("""CREATE TABLE path AS SELECT dense_rank() OVER (ORDER BY tree, bucket) AS b, tree, bucket, i, id, leaf, levels, i AS node,
            '' AS siblings, lower(hex(tampered)) AS f FROM given""")
        most = db.execute("SELECT coalesce(max(levels), 0) FROM node").fetchall()[0][0]
        for level in range(most):
            db.execute(f"""CREATE OR REPLACE TABLE path AS
                SELECT p.* REPLACE (
                  CASE WHEN p.levels <= {level} THEN node ELSE node >> 1 END AS node,
                  siblings || coalesce(s.h, '') AS siblings,
                  CASE WHEN p.levels <= {level} THEN f
                       WHEN node % 2 = 1 THEN sha256(s.h || f)
                       ELSE sha256(f || coalesce(s.h, '')) END AS f)
                FROM path p LEFT JOIN node s ON s.b = p.b AND s.i = xor(p.node, 1) AND p.levels > {level}""")
            db.execute(f"""CREATE OR REPLACE TABLE node AS
                SELECT b, i >> 1 AS i, levels, sha256(string_agg(h, '' ORDER BY i)) AS h FROM node WHERE levels > {level} GROUP BY b, i >> 1, levels
                UNION ALL SELECT b, i, levels, h FROM node WHERE levels <= {level}""")
        return db.sql("""SELECT tree, bucket, id, leaf, unhex(siblings) AS siblings, unhex(f) AS fold, CASE WHEN p.i = 0 THEN unhex(n.h) END AS root
            FROM path p JOIN node n ON n.b = p.b""").to_arrow_table()


def _above(nodes: Column) -> Column:
    """The next level of an array of nodes."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: F.sha2(F.concat(F.get(nodes, i * 2), F.coalesce(F.get(nodes, i * 2 + 1), F.lit(""))), 256))


def _climbed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, at, path) of nodes (tree, at, h), and (tree, h) of every tree's last node.

    A path is an array of (right: the sibling stands right, h: the sibling, null where
    there is none), from the node up.  BUCKET nodes at a time are combined as one array.
    """
    nodes = stage(nodes.select("tree", "at", "h"), "merkle-nodes")
    paths = nodes.select("tree", "at", F.col("at").alias("up"), F.array().cast("array<struct<right:boolean,h:string>>").alias("path"))
    while (nodes.agg(F.max("at")).first()[0] or 0) > 0:
        total = F.max("at").over(Window.partitionBy("tree")) + 1
        sized = nodes.groupBy("tree", F.expr(f"at div {BUCKET}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("x"), F.max("at").alias("at"))
        sized = sized.select("tree", "block", F.transform("x", lambda x: x["h"]).alias("l0"), F.least(F.lit(LEVELS), _levels(total)).alias("levels"))
        for j in range(LEVELS):  # l<j+1>: the nodes above, the same where the tree is done
            sized = sized.withColumn(f"l{j + 1}", F.when(F.col("levels") > j, _above(F.col(f"l{j}"))).otherwise(F.col(f"l{j}")))
        sized = stage(sized, "merkle-levels")

        def step(j: int) -> Column:
            node = F.shiftright("i", j).cast("int")
            one = F.struct((node % 2 == 0).alias("right"), F.get(f"l{j}", node.bitwiseXOR(F.lit(1))).alias("h"))
            return F.when(F.col("levels") > j, F.array(one)).otherwise(F.array().cast("array<struct<right:boolean,h:string>>"))

        each = sized.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("l0") - 1)))
        each = each.select("tree", (F.col("block") * BUCKET + F.col("i")).alias("up"), "block", F.concat(*[step(j) for j in range(LEVELS)]).alias("more"))
        paths = stage(paths.join(each, ["tree", "up"]).select("tree", "at", F.col("block").alias("up"), F.concat("path", "more").alias("path")), "merkle-paths")
        nodes = sized.select("tree", F.col("block").alias("at"), F.get(f"l{LEVELS}", F.lit(0)).alias("h"))
    return paths.select("tree", "at", "path"), nodes.select("tree", "h")


Tamper = Callable[[dict[str, Column]], tuple[Column, dict[str, Column]]]
"""From a row's columns by name to (whether the row is tampered with, columns changed then)."""


def manifest(docs: DataFrame, columns: list[str], id_col: str, group_col: str, tamper: Tamper | None = None) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    A leaf is made of ``columns`` in their order.  ``verified`` tells whether a row's leaf,
    tampered with where ``tamper`` says so, folded along its siblings gives the root.
    """
    rows = taken(docs, **{f"v{i}": c for i, c in enumerate(columns)}, id=id_col, grp=group_col)
    own = {c: F.col(f"v{i}") for i, c in enumerate(columns)}
    leaf = other = leaf_of(*own.values())
    if tamper:
        where, changed = tamper(own)
        other = F.when(where, leaf_of(*(own | changed).values())).otherwise(leaf)
    tree = F.coalesce(F.concat(F.lit("="), F.col("grp").cast("string")), F.lit(""))
    slim = rows.select(tree.alias("tree"), F.col("id").cast("bigint").alias("id"), F.unhex(leaf).alias("leaf"), F.unhex(other).alias("tampered"), F.monotonically_increasing_id().alias("no"))
    leaves = stage(slim, "merkle-leaves")
    count = leaves.count()
    ordered = placed(leaves, "tree", ["id", "leaf", "no"], max(1, -(-count // ROWS_PER_RANGE), min(64, -(-count // BUCKET))))
    buckets = ordered.select("tree", F.shiftright("at", LEVELS).alias("bucket"), F.col("at").bitwiseAND(F.lit(BUCKET - 1)).alias("i"), "id", "leaf", "tampered", F.least(F.lit(LEVELS), _levels(F.col("total"))).alias("levels"))
    task = F.pmod(F.xxhash64("tree", "bucket"), F.lit(max(1, -(-count // ROWS_PER_TASK))))
    inner = stage(buckets.groupBy(task.alias("task")).applyInArrow(_folded, _INNER), "merkle-inner")
    drop(leaves)
    paths, subroots = _climbed(inner.filter("root is not null").select("tree", F.col("bucket").alias("at"), _hex("root").alias("h")))
    groups = placed(subroots.select(F.lit("").alias("all"), "tree", F.col("h").alias("subroot")), "all", ["tree"], max(1, -(-subroots.count() // ROWS_PER_RANGE)))
    over, top = _climbed(groups.select(F.lit("").alias("tree"), "at", F.col("subroot").alias("h")))
    ends = groups.select("tree", "at", "subroot").join(over.select("at", F.col("path").alias("over")), "at").drop("at")
    outer = paths.join(ends, "tree").select("tree", F.col("at").alias("bucket"), "subroot", F.concat("path", "over").alias("path"))
    root = F.lit((top.first() or [None, None])[1])
    siblings = F.array_join(F.transform(F.filter("path", lambda p: p["h"].isNotNull()), lambda p: p["h"]), "")
    up = lambda node, p: F.sha2(F.when(p["h"].isNull(), node).when(p["right"], F.concat(node, p["h"])).otherwise(F.concat(p["h"], node)), 256)
    out = inner.join(outer, ["tree", "bucket"]).withColumn("folded_root", F.aggregate("path", _hex("fold"), up))
    return out.select(
        F.col("id").alias(id_col), _hex("leaf").alias("leaf"), "subroot", root.alias("root"),
        F.sha2(F.concat(_hex("siblings"), siblings), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"),
    )
