"""Near-duplicate documents: banded MinHash candidates screened by odd sketches.

1. One scan turns each text into its shingle set and keeps a slim sketch: set size,
   128-bit hash of the set (the node; equal sets are one class), bands of five
   MinHash samples, and an odd sketch: 120 samples folded into a 256-bit parity
   bitmap.  Two sets' bitmaps differ in few bits iff few samples differ, so the
   popcount of their XOR estimates a high similarity closely.
2. Nodes sharing a band are candidates.  In each bucket every member is compared
   with one hub, not with every other; pairs whose XOR popcount is beyond what a
   linked pair reaches (risk 1e-9) are dropped, the rest are confirmed on
   full sets, fetched once for candidate classes only.
3. Links give components.  A bucket may still span several.  The nodes of such buckets
   are joined by prefixes: with shingles ordered from rare to frequent, two sets of
   the wanted similarity share one of their first n - ceil(t n) + 1.  So nodes of
   different components meet only on a rare shingle in common, not in their bucket;
   sets that look alike but share frequent shingles only never meet.  The order comes from
   counts in a table of fixed size; any order gives the same links.  A first round compares
   the nodes of a shingle with one of them, a hub of its own, so groups whose members are
   all alike become one component by as many comparisons as they have members.  The
   second compares what is still apart; groups of many nodes are cut into blocks there.

The number of bands follows the threshold: a pair at it misses all bands with
probability 8e-7 at most (24 bands of 5 at 0.85, 36 at 0.8), and a component needs
only one path.

Cases: null or blank texts have the empty set and stay alone; texts with fewer
words than a shingle are one shingle; rows with null ids take part and sort
last; rows repeating an id share its class; extra columns are ignored; an empty
table gives an empty result.  ``kept`` speaks of ids; ``drop_near_copies`` decides
row by row.  Sets compare by 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import drop, stage
from . import rolling as R
from .components import components
from .rows import Rows, split_by_keys
from .screen import bits_for, hits, key_bitmap
from .skew import join_groups

U = R.U
SAMPLES, PER_BAND, BITS, SET_BITS, MISS = 120, 5, 256, 1024, 8e-7
COUNTERS, BLOCK = 20, 1000  # 2^20 counts order the shingles; nodes of a shingle are cut into blocks
SKETCH = "id bigint, n bigint, node binary, odd array<bigint>, bands array<bigint>, par array<bigint>"


@lru_cache
def bands_for(percent: int) -> int:
    """Least number of bands that a pair at the threshold misses with at most ``MISS``."""
    one = (percent / 100) ** PER_BAND
    return 1 if one >= 1 else int(np.ceil(np.log(MISS) / np.log1p(-one)))


@lru_cache
def _factors(samples: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, samples + 1, dtype=U)
    return R.mix(k * U(0xD1342543DE82EF95)) | U(1), R.mix(k * U(0x2545F4914F6CDD1D))


@lru_cache
def odd_limit(percent: int, risk: float = 1e-9) -> int:
    """Largest XOR popcount kept: pairs at the threshold exceed it with at most ``risk``."""
    j, k = percent / 100, SAMPLES
    differ = np.zeros(k + 1)
    differ[0] = 1.0  # binomial: samples that differ
    for _ in range(k):
        differ = differ * j + np.concatenate([[0], differ[:-1]]) * (1 - j)
    odd = np.zeros(BITS + 1)
    odd[0] = 1.0  # odd bits after so many flips
    total = differ[0] * odd
    at = np.arange(BITS + 1)
    for d in range(1, k + 1):
        for _ in range(2):
            odd = np.concatenate([[0], (odd * (BITS - at) / BITS)[:-1]]) + np.concatenate([(odd * at / BITS)[1:], [0]])
        total = total + differ[d] * odd
    tail = np.cumsum(total[::-1])[::-1]
    return int(np.flatnonzero(tail <= risk)[0]) if (tail <= risk).any() else BITS


def shingle_hashes(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle, and where each text's begin (and the end)."""
    data = R.LOWER[data]
    starts, ends, first = R.tokens(data, offs)
    pre = R.prefixes(data)
    w = R.mix(R.stretches(pre, starts, ends) + (ends - starts).astype(U) * U(0x8CB92BA72F3D8DD7))
    count = np.diff(first)
    n = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    pick = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], n)
    h = np.zeros(at[-1], U)
    have = np.repeat(np.minimum(count, words), n)
    for k in range(words):
        part = w[np.minimum(pick + k, max(len(w) - 1, 0))] if len(w) else np.zeros(0, U)
        h = h * U(0xA0761D6478BD642F) + np.where(k < have, part, U(k + 1))
    return R.mix(h + have.astype(U)), at


def distinct(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Each text's set, sorted."""
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:])]


def set_node(s: np.ndarray) -> bytes:
    return b"" if not len(s) else np.array([s.sum(dtype=U) + U(len(s)), np.bitwise_xor.reduce(R.mix(s + U(1)))], U).tobytes()


def sketches(sets: list[np.ndarray], n_bands: int = SAMPLES // PER_BAND) -> tuple[np.ndarray, np.ndarray]:
    """Bands (n, n_bands) and odd sketches (n, 4) of the non-empty sets, as int64."""
    if not sets:
        return np.zeros((0, n_bands), np.int64), np.zeros((0, BITS // 64), np.int64)
    h = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    samples = max(SAMPLES, n_bands * PER_BAND)
    mul, add = _factors(samples)
    low = np.empty((len(sets), samples), U)
    for k in range(samples):
        low[:, k] = np.minimum.reduceat(h * mul[k] + add[k], at)
    bands = np.zeros((len(sets), n_bands), U)
    for k in range(PER_BAND):
        bands = bands * U(0xA0761D6478BD642F) + R.mix(low[:, k : n_bands * PER_BAND : PER_BAND])
    bands = R.mix(bands + np.arange(1, n_bands + 1, dtype=U))
    bit = (R.mix(low[:, :SAMPLES] + add[:SAMPLES]) % U(BITS)).astype(np.int64)
    flips = np.zeros((len(sets), BITS), np.uint8)
    rows = np.repeat(np.arange(len(sets)), SAMPLES)
    np.add.at(flips, (rows, bit.ravel()), 1)
    odd = np.packbits(flips & 1, axis=1).view(np.int64)
    return bands.view(np.int64), odd


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmap of each whole set, (n, SET_BITS / 64) as int64."""
    out = np.zeros((len(sets), SET_BITS // 8), np.uint8)
    for i, s in enumerate(sets):
        out[i] = np.packbits(np.bincount((R.mix(s + U(3)) % U(SET_BITS)).astype(np.int64), minlength=SET_BITS).astype(np.uint8) & 1)
    return out.view(np.int64)


def _lists(x: np.ndarray) -> pa.Array:
    n, k = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(x).ravel()))


def _sketch_batches(words: int, n_bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in R.slices(b.column(1)):
                sets = distinct(*shingle_hashes(data, offs, words))
                full = [i for i, s in enumerate(sets) if len(s)]
                bands, odd = np.zeros((hi - lo, n_bands), np.int64), np.zeros((hi - lo, BITS // 64), np.int64)
                bands[full], odd[full] = sketches([sets[i] for i in full], n_bands)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_node(s) for s in sets], pa.binary()), _lists(odd), _lists(bands), _lists(parities(sets))],
                    names=["id", "n", "node", "odd", "bands", "par"],
                )

    return run


def _set_batches(words: int, bitmap, bits: int):
    """Sets of the rows whose id may be a candidate's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(hits(bitmap.value, bits, b.column(2).to_numpy(zero_copy_only=False))))
            for _, _, data, offs in R.slices(b.column(1)):
                sets = distinct(*shingle_hashes(data, offs, words))
                offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([set_node(s) for s in sets], pa.binary()), items], names=["node", "items"])

    return run


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(counter, n): how often shingles fall on each counter."""
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            items = b.column(0).slice(lo, 500).flatten().to_numpy().view(U)
            at, n = np.unique((items >> U(64 - COUNTERS)).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["counter", "n"])


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _prefixes(percent: int, counts):
    """Rows of (nid, items): one for each shingle of the set's prefix with its place there, rare ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            picked = []
            for x in b.column(1):
                s = x.values.to_numpy().view(U)
                p = prefix_length(len(s), percent)
                often = counts.value[(s >> U(64 - COUNTERS)).astype(np.int64)]
                picked.append(s[np.lexsort((s, often))[:p]])
            size = np.array([len(x) for x in picked], np.int64)
            row = np.repeat(np.arange(len(picked)), size)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            token = np.concatenate(picked or [np.zeros(0, U)])
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), b.column(0).take(pa.array(row)), pa.array(pos.astype(np.int32))], names=["token", "nid", "pos"])

    return run


def _slim(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= percent * |A or B| over their sets
    of ``words``-word shingles; component_id is the smallest id reachable.
    """
    return _grouped(docs, words, percent, id_col, text_col)[0]


def _grouped(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """The result of ``near_dedup``, and the staged tables that it reads."""
    rows = stage(_slim(docs, id_col, text_col).mapInArrow(_sketch_batches(words, bands_for(percent)), SKETCH), "near-sketch")
    filled = rows.filter("n > 0")
    grouped = filled.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "n", "odd", "bands", "par")).alias("r"), F.count(F.lit(1)).alias("rows"))
    nodes = stage(grouped.select(F.monotonically_increasing_id().alias("nid"), "node", "r.id", "r.n", "r.odd", "r.bands", "r.par", "rows"), "near-nodes")
    total, = rows.agg(F.count(F.lit(1))).first()
    count, = nodes.agg(F.count(F.lit(1))).first()
    spread = nodes.select("nid", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("nid").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stage(join_groups(spread, shared, ["bucket"], "size", count * bands_for(percent)).filter("hub is not null"), "near-buckets")
    comp = _linked(docs, nodes, members, count, words, percent, id_col, text_col)
    at = comp.select(F.col("node").alias("at"), "comp")
    by_node = nodes.select("nid", "node", "id", "rows").join(at, F.col("nid") == F.col("at"), "left").withColumn("comp", F.coalesce("comp", "nid")).select("node", "id", "rows", "comp")
    sizes = by_node.groupBy("comp").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    labels = stage(join_groups(by_node, sizes, ["comp"], "nodes", count).select("node", "component_id", "rows"), "near-labels")
    drop(nodes, members, comp)
    out = join_groups(rows.select("id", "n", "node"), labels, ["node"], "rows", total)
    low = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), low.alias("component_id"), F.col("id").eqNullSafe(low).alias("kept")), [rows, labels]


def _linked(docs: DataFrame, nodes: DataFrame, members: DataFrame, count: int, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(node, comp), staged, of the nodes that have links."""
    spark = docs.sparkSession
    bits = bits_for(count)
    wanted = members.select("nid").distinct().join(nodes.select("nid", "id"), "nid").select(F.xxhash64("id").alias("key"))
    bitmap = spark.sparkContext.broadcast(key_bitmap(wanted, "key", bits))
    sets = (
        _slim(docs, id_col, text_col, F.xxhash64(F.col(id_col).cast("bigint")).alias("p"))
        .mapInArrow(_set_batches(words, bitmap, bits), "node binary, items array<bigint>")
        .groupBy("node").agg(F.first("items").alias("items"))
    )
    sets = stage(sets.join(nodes.select("nid", "node"), "node").select("nid", "items"), "near-sets")
    near = _near(percent)
    print_ = nodes.select("nid", "n", "odd", "par")

    def of(x: str) -> DataFrame:
        return print_.select(F.col("nid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "odd", "par")])

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that neither parity bitmap rules out and whose sets agree.

        Sets of an a with very many b's go to as many blocks of them; nothing of a size
        that texts decide is broadcast.
        """
        pairs = stage(pairs.distinct(), "near-pairs")
        n, = pairs.agg(F.count(F.lit(1))).first()
        often = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
        close = join_groups(pairs, often.join(of("a"), "a"), ["a"], "c", n).drop("c").join(of("b"), "b").filter(near)
        close = stage(close.select("a", "b"), "near-close")
        n, = close.agg(F.count(F.lit(1))).first()
        blocks = close.groupBy("a").agg(F.count(F.lit(1)).alias("c")).withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
        own = blocks.join(sets, F.col("a") == F.col("nid")).select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("items").alias("items_a"))
        placed = join_groups(close, blocks, ["a"], "c", n).select("a", "b", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"))
        full = placed.join(sets.select(F.col("nid").alias("b"), F.col("items").alias("items_b")), "b").join(own, ["a", "block"])
        both = F.size(F.array_intersect("items_a", "items_b"))
        out = stage(full.filter(100 * both >= percent * (F.size("items_a") + F.size("items_b") - both)).select("a", "b"), "near-links")
        drop(pairs, close)
        return out

    links = confirmed(members.filter("hub <> nid").select(F.col("hub").alias("a"), F.col("nid").alias("b")))
    comp = components(links)
    drop(links)
    at = lambda: comp.select(F.col("node").alias("at"), "comp")

    placed = members.filter("size > 2").join(at(), F.col("nid") == F.col("at"), "left").select("bucket", "nid", "size", F.coalesce("comp", "nid").alias("comp"))
    split = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("size").alias("c")).filter("low < high").select("bucket", "c", F.lit(True).alias("open"))
    open_ = join_groups(placed, split, ["bucket"], "c", count * bands_for(percent)).filter("open").select("nid").distinct()
    open_ = stage(open_.select("nid").join(sets, "nid").select("nid", "items"), "near-open")
    if open_.head(1):
        prefixes = stage(_prefix_rows(open_, percent), "near-prefixes")
        for meet in (_with_hubs, _with_all):
            placed = prefixes.join(at(), F.col("nid") == F.col("at"), "left").select("token", "nid", "pos", F.coalesce("comp", "nid").alias("comp"))
            more = confirmed(meet(placed, print_, percent))
            if more.head(1):  # what is known joins them as stars
                before, comp = comp, components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))
                drop(before)
            drop(more)
        drop(prefixes)
    drop(open_, sets)
    return comp


def _near(percent: int) -> Column:
    """Of pairs with n, odd and par of a and b: neither parity bitmap rules the pair out."""

    def differ(c: str, words: int) -> Column:
        return sum((F.bit_count(F.col(f"{c}_a")[k].bitwiseXOR(F.col(f"{c}_b")[k])) for k in range(words)), F.lit(0))

    whole = differ("par", SET_BITS // 64) * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    return (differ("odd", BITS // 64) < odd_limit(percent)) & whole


def _prefix_rows(sets: DataFrame, percent: int) -> DataFrame:
    """(token, nid, pos) of the prefixes of (nid, items)."""
    got = sets.select("items").mapInArrow(_tally, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # 2^20 rows at most
    counts = np.zeros(1 << COUNTERS, np.int64)
    counts[got["counter"].to_numpy()] = got["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    return sets.mapInArrow(_prefixes(percent, shared), "token bigint, nid bigint, pos int")


_SIDE = ("nid", "comp", "pos", "n", "odd", "par")


def _side(x: str) -> list[Column]:
    return [F.col(c).alias(x if c == "nid" else f"{c}_{x}") for c in _SIDE]


def _alike(percent: int) -> Column:
    """What is left of both sets from a shingle on can reach the overlap, and no bitmap rules the pair out."""
    left = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    return ((100 + percent) * left >= percent * (F.col("n_a") + F.col("n_b"))) & _near(percent)


def _with_hubs(placed: DataFrame, print_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): each node with one hub of each of its shingles, where both are in different components."""
    total, = placed.agg(F.count(F.lit(1))).first()
    wide = F.struct(*_SIDE)
    rows = stage(placed.join(print_, "nid"), "near-placed")
    hubs = rows.groupBy("token").agg(F.min_by(wide, F.xxhash64("nid", "token")).alias("hub"), F.count(F.lit(1)).alias("f"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("token", "hub", "f")
    met = join_groups(rows, hubs, ["token"], "f", total).filter("hub is not null and comp <> hub.comp")
    return met.select(*_side("a"), *[F.col(f"hub.{c}").alias("b" if c == "nid" else f"{c}_b") for c in _SIDE]).filter(_alike(percent)).select("a", "b")


def _with_all(placed: DataFrame, print_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle of their prefixes and pass the screens."""
    total, = placed.agg(F.count(F.lit(1))).first()
    parts = placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    met = parts.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("f"), F.count(F.lit(1)).alias("comps")).filter("comps > 1").select("token", "f", F.col("top.comp").alias("top"))
    rows = join_groups(placed, met, ["token"], "f", total).filter("top is not null").withColumn("blocks", F.ceil(F.col("f") / BLOCK).cast("int"))
    rows = rows.join(print_, "nid")
    a = rows.filter("comp <> top").select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *_side("a"))
    b = rows.select("token", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int").alias("block"), *_side("b"), (F.col("comp") == F.col("top")).alias("main"))
    on = (a["token"] == b["token"]) & (a["block"] == b["block"])
    apart = (F.col("comp_a") != F.col("comp_b")) & (F.col("main") | (F.col("a") < F.col("b")))
    return a.join(b, on & apart & _alike(percent)).select("a", "b")


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which each group keeps one: the smallest id, nulls last.

    Where ids are null or repeated they do not tell rows apart: such rows are numbered,
    and of those with the smallest id of a group one stays, by a print of the text, then
    by number.  So of equal rows one stays, unless they have no words.
    """
    rows = Rows.of(docs, id_col, text_col)
    same, other, gone = _split_copies(rows, words, percent)
    return rows.restored(same.unionByName(other.join(gone, "key", "left_anti")))


def mark_near_copies(docs: DataFrame, name: str, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs``, with a boolean ``name`` that is true for those that ``drop_near_copies`` drops."""
    rows = Rows.of(docs, id_col, text_col)
    same, other, gone = _split_copies(rows, words, percent)
    told = other.join(gone.withColumn("copy", F.lit(True)), "key", "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    return rows.restored(same.withColumn("copy", F.lit(False)).unionByName(told), F.col("copy").alias(name))


def _split_copies(rows: Rows, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that are surely no near copies, the rest, (key) of the near copies)."""
    groups, read = _grouped(rows.df.select("key", "text"), words, percent, "key", "text")
    if rows.clear:
        gone = stage(groups.filter("not kept").select("key"), "near-gone")
    else:
        groups = stage(groups.filter("n_shingles > 0").select("key", "component_id").join(rows.df.select("key", rows.order.alias("place")), "key"), "near-order")
        first = groups.groupBy("component_id").agg(F.min("place").alias("place")).select("place.key")
        gone = stage(groups.join(first, "key", "left_anti").select("key"), "near-gone")
        drop(groups)
    drop(*read)
    n_gone, = gone.agg(F.count(F.lit(1))).first()
    return *split_by_keys(rows.df, gone, n_gone), gone
