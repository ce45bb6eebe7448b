"""Removal of byte strings that occur more than once: hash-compared suffix sorting.

A window is a stretch of 200 bytes inside one text.  Two windows are equal only
if they agree on their anchor, the 64-byte gram in them with the smallest hash
(leftmost on ties), and on its offset.  So suffixes need comparing only with
suffixes in the same cell (anchor, offset):

1. A scan cuts each text into runs of windows with one anchor occurrence and
   counts runs per anchor hash (map-side combined).  Anchors seen once are done.
2. A second scan, screened by bitmaps of fixed size, takes runs whose anchor is always
   seen in the same surroundings as one piece and cuts the others into pieces of up
   to 60 windows at fixed offsets.  Pieces are grouped by their bytes into classes;
   what a class of two or more covers is repeated throughout.
3. Classes that share an anchor and the bytes common to a piece's windows but
   differ around them are sorted: a mergesort of suffixes per cell, where two
   suffixes are compared by binary search for their common extension over prefix
   polynomial hashes.  Neighbours that extend over 200 bytes repeat; their bytes
   are compared, and a cell with a hash collision is redone on bytes alone.
   Groups of over ``CELL`` classes are recut into windows, dealt into cells by a hash of
   their bytes and sorted likewise.  A cell still larger (many copies of a window) is sorted
   in parts; each part marks its repeats and sends one window of each kind on to a
   next round, dealt anew, so no group is gathered in one task.
4. Masks of repeated windows return to their texts, where covered bytes go.

Every decision rests on bytes: pieces meet by bytes, sorted windows are compared on
bytes.  Hashes only bring candidates together and carry results back; should two
different pieces share the 128 bits that carry results, or an anchor's surroundings
the 64 that call them equal, it is found out and everything is done again with other bases.

Cases: null is empty; texts under 200 bytes stay as they are; rows with null ids
are documents of their own; rows repeating id and text are separate places, so
they repeat each other; extra columns are ignored; an empty table gives an empty
result.  Long texts are worked on in overlapping parts of 1 MB.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import drop, stage
from . import rolling as R
from .rows import Rows, split_by_keys
from .screen import bits_for, hits, key_bitmap
from .skew import join_groups

U = R.U
GRAM, BLOCK, CELL = 64, 60, 1000
_PLACE = U((1 << 22) - 1)  # parts of texts are shorter
_C = [U(c) for c in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407)]
WHOLE = -1  # mask of a piece that repeats throughout
RUN = -1  # offset of a piece that is a run
CHUNK = 2 << 20  # bytes of class bodies sorted at once


class Runs:
    """Runs of windows with one anchor in a part of the texts; ``seed`` picks the bases."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, width: int, seed: int):
        self.data, self.width, self.seed = data, width, seed
        self.pre = R.prefixes(data, 2 * seed)
        n = len(data) - width + 1
        if n <= 0:
            self.first = self.count = self.at = np.zeros(0, np.int64)
            self.key = np.zeros(0, U)
            return
        gram = R.mix(R.windows(self.pre, GRAM, 2 * seed))
        low = (gram & ~_PLACE) | np.arange(len(gram), dtype=U)
        span, most = 1, width - GRAM + 1
        while 2 * span <= most:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < most:
            low = np.minimum(low[:n], low[most - span : most - span + n])
        place = (low & _PLACE).astype(np.int64)
        edge = np.zeros(n + 1, np.int32)  # windows that would leave their text
        np.add.at(edge, np.minimum(np.maximum(offs[1:] - width + 1, offs[:-1]), n), 1)
        np.add.at(edge, np.minimum(offs[1:], n), -1)
        bad = np.cumsum(edge[:-1]) > 0
        turn = np.ones(n + 1, bool)
        turn[1:-1] = (place[1:] != place[:-1]) | (bad[1:] != bad[:-1])
        cut = np.flatnonzero(turn)
        first, count = cut[:-1], np.diff(cut)
        keep = ~bad[first]
        self.first, self.count = first[keep], count[keep]
        self.at = place[self.first]
        # least hashes crowd near 0; mixed again they spread over the screen's bits
        self.key = R.mix(gram[self.at] + _C[1])

    def prints(self) -> np.ndarray:
        """64 bits of each run's bytes and of its anchor's place in them."""
        tag = (self.at - self.first).astype(U) * _C[0] + self.count.astype(U) * _C[1]
        return R.mix(R.stretches(self.pre, self.first, self.first + self.count - 1 + self.width, 2 * self.seed) + tag)

    def pieces(self, whole: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, ...]:
        """(p0, end, offset, windows, core, u1, u2) of runs taken whole and of runs cut at multiples of BLOCK from the anchor."""
        count, at, first, key = self.count[cut], self.at[cut], self.first[cut], self.key[cut]
        high = at - first  # offset of the anchor in the first window
        low = high - count + 1
        n = high // BLOCK - low // BLOCK + 1
        run = np.repeat(np.arange(len(n)), n)
        blk = high[run] // BLOCK - (np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n))
        q = at[run]
        off = np.minimum(high[run], blk * BLOCK + BLOCK - 1)
        cnt = off - np.maximum(low[run], blk * BLOCK) + 1
        core = R.mix(R.stretches(self.pre, q - blk * BLOCK, q - blk * BLOCK - BLOCK + 1 + self.width, 2 * self.seed) + blk.astype(U) * _C[2] + key[run])
        p0, cnt = np.concatenate([self.first[whole], q - off]), np.concatenate([self.count[whole], cnt])
        core, off = np.concatenate([self.key[whole], core]), np.concatenate([np.full(whole.sum(), RUN), off])
        end = p0 + cnt - 1 + self.width
        tag = off.astype(U) * _C[0] + cnt.astype(U) * _C[1]
        u1 = R.mix(R.stretches(self.pre, p0, end, 2 * self.seed) + tag)
        other = R.prefixes(self.data ^ np.uint8(0x5A), 2 * self.seed + 1)
        return p0, end, off, cnt, core, u1, R.mix(R.stretches(other, p0, end, 2 * self.seed + 1) + tag)


def _anchor_batches(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offs, _ in R.chunks(b.column(0), width):
                r = Runs(data, offs, width, seed)
                yield pa.RecordBatch.from_arrays([pa.array(r.key.view(np.int64)), pa.array(r.prints().view(np.int64))], names=["key", "whole"])

    return run


def _class_batches(width: int, seed: int, bits: int, shared):
    """Pieces of the runs whose anchor is seen again, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, mixed = shared.value
        for b in batches:
            for _, _, data, offs, _ in R.chunks(b.column(0), width):
                r = Runs(data, offs, width, seed)
                p0, end, off, cnt, core, u1, u2 = r.pieces(hits(again, bits, r.key), hits(mixed, bits, r.key))
                raw = data.tobytes()
                body = [raw[i:j] for i, j in zip(p0.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.view(np.int64)) for x in (core, u1, u2)), pa.array(off.astype(np.int32)), pa.array(cnt.astype(np.int32)), pa.array(body, pa.binary())],
                    names=["core", "u1", "u2", "off", "cnt", "body"],
                )

    return run


def _place_batches(width: int, seed: int, bits: int, shared, mask_bits: int, found):
    """Places of the pieces that may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, mixed = shared.value
        for b in batches:
            for lo, _, data, offs, start in R.chunks(b.column(1), width):
                r = Runs(data, offs, width, seed)
                p0, _, _, cnt, _, u1, u2 = r.pieces(hits(again, bits, r.key), hits(mixed, bits, r.key))
                sel = hits(found.value, mask_bits, u1)
                p0, cnt, u1, u2 = p0[sel], cnt[sel], u1[sel], u2[sel]
                doc = np.searchsorted(offs, p0, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(lo + doc)), pa.array(p0 - offs[doc] + start), pa.array(cnt.astype(np.int32)), pa.array(u1.view(np.int64)), pa.array(u2.view(np.int64))],
                    names=["key", "p0", "cnt", "u1", "u2"],
                )

    return run


class SuffixSorter:
    """Mergesort of suffixes inside cells, compared by common extension up to ``width``."""

    def __init__(self, data: np.ndarray, width: int):
        self.data, self.width = data, width
        self.pre = R.prefixes(data)
        _, self.inv = R.powers(len(self.pre))

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search over prefix hashes."""
        low, high = np.zeros(len(i), np.int64), np.full(len(i), self.width, np.int64)
        pi, pj, vi, vj = self.pre[i], self.pre[j], self.inv[i], self.inv[j]
        mid = high  # the whole width first: most neighbours are equal
        while (low < high).any():
            same = (self.pre[i + mid] - pi) * vi == (self.pre[j + mid] - pj) * vj
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
            mid = (low + high + 1) // 2
        return low

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: bool) -> np.ndarray:
        e = self.extension(i, j)
        at = np.minimum(e, self.width - 1)
        a, b = self.data[i + at], self.data[j + at]
        return np.where(e >= self.width, or_equal, a < b)

    def sort(self, suffix: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Order (indices) that sorts suffixes inside each cell; cells are contiguous."""
        n = len(suffix)
        order = np.arange(n)
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        ends = np.concatenate([starts[1:], [n]])
        size = np.repeat(ends - starts, ends - starts)
        base, stop = np.repeat(starts, ends - starts), np.repeat(ends, ends - starts)
        at = np.arange(n) - base
        half = 1
        while n and half < size.max():
            live = np.flatnonzero(size > half)
            pair = base[live] + at[live] // (2 * half) * (2 * half)
            mid = np.minimum(pair + half, stop[live])
            left = live < mid
            low = np.where(left, mid, pair)
            high = np.where(left, np.minimum(pair + 2 * half, stop[live]), mid)
            from_ = low.copy()
            mine = suffix[order[live]]
            while (open_ := np.flatnonzero(low < high)).size:  # rank among the other half
                m = (low[open_] + high[open_]) // 2
                theirs = suffix[order[m]]
                before = np.empty(len(open_), bool)
                l = left[open_]
                before[l] = self.less(theirs[l], mine[open_][l], False)
                before[~l] = self.less(theirs[~l], mine[open_][~l], True)
                low[open_] = np.where(before, m + 1, low[open_])
                high[open_] = np.where(before, high[open_], m)
            to = np.where(left, live, live - mid + pair) + low - from_
            merged = order.copy()
            merged[to] = order[live]
            order = merged
            half *= 2
        return order


def window_kinds(data: np.ndarray, suffix: np.ndarray, cell: np.ndarray, width: int) -> np.ndarray:
    """A number for each window: equal windows of a cell, and only those, share it.  Cells are contiguous."""
    n = len(suffix)
    sorter = SuffixSorter(data, width)
    order = sorter.sort(suffix, cell)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(cell[a] == cell[b])
    near = near[sorter.extension(suffix[a[near]], suffix[b[near]]) >= width]
    a, b = a[near], b[near]
    true = np.ones(len(a), bool)
    for lo in range(0, len(a), 20_000):  # collision check on the bytes
        s, t = (suffix[x[lo : lo + 20_000], None] + np.arange(width) for x in (a, b))
        true[lo : lo + 20_000] = (data[s] == data[t]).all(axis=1)
    fresh = np.ones(n, bool)
    fresh[near + 1] = False
    kind = np.empty(n, np.int64)
    kind[order] = np.cumsum(fresh)
    for c in np.unique(cell[a[~true]]):
        seen: dict[bytes, int] = {}
        for k in np.flatnonzero(cell == c).tolist():
            kind[k] = seen.setdefault(data[suffix[k] : suffix[k] + width].tobytes(), n + 1 + k)
    return kind


def _again(kind: np.ndarray) -> np.ndarray:
    _, of, n = np.unique(kind, return_inverse=True, return_counts=True)
    return n[of] > 1


def repeated_windows(bodies: list[bytes], group: np.ndarray, off: np.ndarray, cnt: np.ndarray, width: int) -> np.ndarray:
    """Mask (bit i = window i) of each class's windows that another class of its group has too."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    base = np.cumsum([0] + [len(b) for b in bodies[:-1]])
    cls = np.repeat(np.arange(len(cnt)), cnt)
    i = np.arange(len(cls)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
    suffix, offset = base[cls] + i, off[cls] - i
    by = np.lexsort((offset, group[cls]))
    cls, i, suffix, offset = cls[by], i[by], suffix[by], offset[by]
    fresh = np.concatenate([[True], (group[cls][1:] != group[cls][:-1]) | (offset[1:] != offset[:-1])])
    hit = _again(window_kinds(data, suffix, np.cumsum(fresh), width))
    out = np.zeros(len(cnt), np.int64)
    np.bitwise_or.at(out, cls[hit], np.int64(1) << i[hit])
    return out


def _whole_groups(column: str, solve):
    """Batches of rows sorted by ``column`` as tables of whole groups and of bounded size, each through ``solve``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                held.append(b.slice(lo, 2000))
                size += held[-1].nbytes
                if size < CHUNK:
                    continue
                t = pa.Table.from_batches(held)
                key = t[column].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
                if cut:
                    yield solve(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
                size = sum(h.nbytes for h in held)
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield solve(t)

    return run


def _sorted_classes(width: int):
    def solve(part: pa.Table) -> pa.RecordBatch:
        core = part["core"].to_numpy()
        alone = np.ones(len(core), bool)  # a class without company repeats nothing
        alone[1:] &= core[1:] != core[:-1]
        alone[:-1] &= core[1:] != core[:-1]
        part = part.filter(pa.array(~alone))
        off, cnt = (part[c].to_numpy().astype(np.int64) for c in ("off", "cnt"))
        mask = repeated_windows(part["body"].to_pylist(), part["core"].to_numpy(), off, cnt, width)
        some = pa.array(mask != 0)
        return pa.RecordBatch.from_arrays([*(part[c].combine_chunks().filter(some) for c in ("u1", "u2", "n")), pa.array(mask).filter(some)], names=["u1", "u2", "n", "mask"])

    return _whole_groups("core", solve)


_WINDOW = "cell bigint, u1 bigint, u2 bigint, n bigint, i int, body binary"


def _windows_of(width: int):
    """Classes (u1, u2, n, cnt, off, body, core, parts) recut into windows, dealt by their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                cnt, off, core, parts = (part.column(k).to_numpy().astype(np.int64) for k in (3, 4, 6, 7))
                bodies = part.column(5).to_pylist()
                data = np.frombuffer(b"".join(bodies), np.uint8)
                base = np.cumsum([0] + [len(x) for x in bodies[:-1]])
                cls = np.repeat(np.arange(len(cnt)), cnt)
                i = np.arange(len(cls)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
                at = base[cls] + i
                h = R.mix(R.stretches(R.prefixes(data), at, at + width)) % parts[cls].astype(U)
                cell = R.mix(core[cls].view(U) + (off[cls] - i).astype(U) * _C[0] + h * _C[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.view(np.int64)), *(part.column(k).take(pa.array(cls)) for k in range(3)), pa.array(i.astype(np.int32)), pa.array([bodies[c][k : k + width] for c, k in zip(cls.tolist(), i.tolist())], pa.binary())],
                    names=["cell", "u1", "u2", "n", "i", "body"],
                )

    return run


def _sorted_cells(width: int):
    """Windows of (part of) a cell: all with whether they repeat, and the first of each kind as ``lead``."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        place = t["place"].to_numpy()
        data = np.frombuffer(b"".join(t["body"].to_pylist()), np.uint8)
        kind = window_kinds(data, np.arange(len(place)) * width, np.unique(place, return_inverse=True)[1], width)
        lead = np.zeros(len(place), bool)
        lead[np.unique(kind, return_index=True)[1]] = True
        lead &= t["open"].to_numpy(zero_copy_only=False)
        hit = _again(kind)
        some = pa.array(hit | lead)
        body = pa.array([x if y else None for x, y in zip(t["body"].to_pylist(), lead)], pa.binary())
        cols = [t[c].combine_chunks() for c in ("cell", "u1", "u2", "n", "i")]
        more = (pa.array(hit), t["share"].combine_chunks())
        return pa.RecordBatch.from_arrays([x.filter(some) for x in (*cols, body, *more)], names=["cell", "u1", "u2", "n", "i", "body", "hit", "share"])

    return _whole_groups("place", solve)


def _crowded(classes: DataFrame, sizes: DataFrame, width: int) -> DataFrame:
    """(u1, u2, n, mask) of the groups of over CELL classes; ``sizes`` (core, size) names them."""
    total, = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()
    marks: list[DataFrame] = []
    dealt = join_groups(classes, sizes.withColumn("parts", F.ceil(F.col("size") / CELL).cast("bigint")), ["core"], "size", max(total, 1)).filter("parts is not null")
    rows = stage(dealt.select("u1", "u2", "n", "cnt", "off", "body", "core", "parts").mapInArrow(_windows_of(width), _WINDOW), "repeat-windows")
    for again in count(1):
        if not rows.head(1):
            break
        held, = rows.agg(F.count(F.lit(1))).first()
        full = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > CELL)
        split = join_groups(rows, full, ["cell"], "c", held).withColumn("open", F.col("c").isNotNull()).withColumn("share", F.coalesce(F.ceil(F.col("c") / CELL), F.lit(1)))
        placed = split.withColumn("place", F.xxhash64("cell", F.pmod(F.xxhash64("u1", "u2", "i"), "share"))).drop("c").repartition("place").sortWithinPartitions("place")
        done = stage(placed.mapInArrow(_sorted_cells(width), f"{_WINDOW}, hit boolean, share bigint"), "repeat-cells")
        marks.append(done.filter("hit").select("u1", "u2", "n", F.expr("shiftleft(1L, i)").alias("mask")))
        # equal windows stay together, different ones part
        cell = F.xxhash64("cell", F.pmod(F.xxhash64("body", F.lit(again)), 4 * F.col("share")))
        after = stage(done.filter("body is not null").select(cell.alias("cell"), "u1", "u2", "n", "i", "body"), "repeat-windows")
        drop(rows)
        rows = after
    out = classes.select("u1", "u2", "n", F.lit(0).cast("bigint").alias("mask")).limit(0)
    for m in marks:
        out = out.unionByName(m)
    return out


def _cover_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n, gone, spans = [], [], [], []
            k = b.num_columns - 4
            for text, ps, ns, ms in zip(*(b.column(k + i) for i in range(4))):
                raw = text.as_buffer().to_pybytes()
                p, c, m = (x.values.to_numpy().astype(np.int64) if x.is_valid else np.zeros(0, np.int64) for x in (ps, ns, ms))
                full = m == WHOLE
                which, bit = np.nonzero((m[~full, None] >> np.arange(BLOCK)) & 1)
                start = np.concatenate([p[full], p[~full][which] + bit])
                end = np.concatenate([p[full] + c[full] - 1, p[~full][which] + bit]) + width
                by = np.argsort(start, kind="stable")
                start, reach = start[by], np.maximum.accumulate(end[by]) if len(by) else end
                first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]])) if len(by) else np.zeros(0, int)
                start, end = start[first].tolist(), reach[np.append(first[1:], len(by)) - 1].tolist() if len(by) else []
                kept.append(b"".join(raw[i:j] for i, j in zip([0, *end], [*start, len(raw)])))
                n.append(len(raw))
                gone.append(len(raw) - len(kept[-1]))
                spans.append([{"start": i, "end": j} for i, j in zip(start, end)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:k], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=[*b.schema.names[:k], "n_bytes", "n_removed", "spans", "kept"]
            )

    return run


class _Collision(Exception):
    """Different bytes behind one hash."""


def _spans(rows: Rows, width: int, seed: int) -> DataFrame:
    """(key, ps, ns, ms): repeated pieces of the rows that have some."""
    long_ = rows.df.filter(F.octet_length("text") >= width)
    sc = rows.df.sparkSession.sparkContext
    anchors = long_.select("text").mapInArrow(_anchor_batches(width, seed), "key bigint, whole bigint")
    seen = anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("lo"), F.max("whole").alias("hi")).filter("n > 1")
    again = stage(seen.select("key", (F.col("lo") != F.col("hi")).alias("mixed")), "repeat-anchors")
    bits = bits_for(again.agg(F.count(F.lit(1))).first()[0])
    shared = sc.broadcast((key_bitmap(again.filter("not mixed"), "key", bits), key_bitmap(again.filter("mixed"), "key", bits)))

    pieces = long_.select("text").mapInArrow(_class_batches(width, seed, bits, shared), "core bigint, u1 bigint, u2 bigint, off int, cnt int, body binary")
    classes = stage(pieces.groupBy("core", "u1", "u2", "off", "cnt", "body").agg(F.count(F.lit(1)).alias("n")), "repeat-classes")
    runs = classes.filter(F.col("off") == RUN)
    torn = runs.groupBy("core").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").join(again.filter("not mixed"), F.col("core") == F.col("key"))
    if classes.groupBy("u1", "u2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").head(1) or torn.head(1):
        raise _Collision
    cut = classes.filter(F.col("off") != RUN)
    sizes = cut.groupBy("core").agg(F.count(F.lit(1)).alias("size"))
    crowds = stage(sizes.filter(F.col("size") > CELL), "repeat-crowds")
    small = cut.join(sizes.filter(F.col("size").between(2, CELL)).select("core"), "core", "left_semi")
    parts = classes.filter("n > 1").select("u1", "u2", "n", F.lit(WHOLE).cast("bigint").alias("mask"))
    ordered = small.select("core", "u1", "u2", "n", "cnt", "off", "body").repartition("core").sortWithinPartitions("core")
    parts = parts.unionByName(ordered.mapInArrow(_sorted_classes(width), "u1 bigint, u2 bigint, n bigint, mask bigint"))
    if crowds.head(1):
        parts = parts.unionByName(_crowded(cut, crowds, width))
    masks = stage(parts.groupBy("u1", "u2").agg(F.bit_or("mask").alias("mask"), F.max("n").alias("n")), "repeat-masks")
    n_masks, total = masks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    drop(classes, crowds)
    mask_bits = bits_for(n_masks)
    found = sc.broadcast(key_bitmap(masks, "u1", mask_bits))
    places = long_.select("key", "text").mapInArrow(_place_batches(width, seed, bits, shared, mask_bits, found), "key bigint, p0 bigint, cnt int, u1 bigint, u2 bigint")
    placed = join_groups(places, masks, ["u1", "u2"], "n", total).filter("mask is not null")
    out = stage(placed.groupBy("key").agg(F.collect_list("p0").alias("ps"), F.collect_list("cnt").alias("ns"), F.collect_list("mask").alias("ms")), "repeat-spans")
    drop(again, masks)
    return out


def remove_repeats(docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, spans (start, end), kept (binary).

    ``width`` is at least 128, so that an anchor and a piece's common bytes fit.
    """
    if width < 2 * GRAM:
        raise ValueError("width is too small for the anchors")
    rows = Rows.of(docs, id_col, text_col)
    for seed in range(8):
        try:
            spans = _spans(rows, width, seed)
            break
        except _Collision:
            continue
    else:
        raise RuntimeError("hashes of eight bases collide")
    n_spans, = spans.agg(F.count(F.lit(1))).first()
    same, other = split_by_keys(rows.df, spans, n_spans)
    ident = F.col(f"c{docs.columns.index(id_col)}").alias("id")
    raw = F.col("text").cast("binary").alias("text")
    kind = docs.schema[id_col].dataType.simpleString()
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    clean = same.select(ident, F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), none.alias("spans"), raw.alias("kept"))
    ready = other.join(spans, "key", "left").select(ident, raw, "ps", "ns", "ms")
    out = ready.mapInArrow(_cover_batches(width), f"id {kind}, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return clean.unionByName(out).withColumnRenamed("id", id_col)
