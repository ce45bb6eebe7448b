"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Text and items are compared with A-Z lowered and blank runs as one blank, in
UTF-8 bytes.  An item of length m may be matched with k = floor(0.06 m) edits.
Such a match shares at least m - q + 1 - kq of the item's q-grams (q = 12), and
their diagonals lie within k of each other, hence in one of the overlapping
diagonal bands of width 2(k + 1).  Bands that reach the count are retained and
verified by an alignment restricted to the band.

An item must have ``least`` bytes to be evidence (12; a parameter, since a word or two
are in any text).  Items shorter than a q-gram, where ``least`` admits them, are
their own q-gram and matched without edits.

The index takes 16 bytes per item byte and 4 MB; it is broadcast in blocks of at most
``block_bytes`` of items (8 MB, so 132 MB) and one item.  Documents are scanned once: a
worker gathers HELD_BYTES of texts, opens one block after the other for them and lets go of
each, so its memory does not depend on the number of blocks.  The driver builds one block at a time.

Cases: null text or item matches nothing; k is lowered where the lemma would ask for
no gram; null ids, of documents and of items, are kept as null; repeated rows each
give their rows; overlapping passages of one item in one text are one, the cheapest
(then the first); extra columns are ignored by ``leaks`` and kept by ``drop_leaking``,
whatever their names; empty tables give an empty result; very long texts are whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R

U = R.U
GRAM, EDITS_PERCENT = 12, 6
_SIEVE = 22
BLOCK_BYTES = 8 << 20
HELD_BYTES = 32 << 20
SCHEMA = "item_id bigint, start bigint, end bigint, edits int"


def normalised(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, original place of each byte); blanks between texts never merge."""
    blank = R.BLANK[data]
    again = np.zeros(len(data), bool)
    again[1:] = blank[1:] & blank[:-1]
    again[offs[:-1][offs[:-1] < len(data)]] = False
    where = np.flatnonzero(~again)
    out = R.LOWER[data[where]]
    out[blank[where]] = 32
    return out, np.searchsorted(where, offs), where


def budget(m: int) -> tuple[int, int]:
    """(edits allowed, q-grams a band must share) for an item of the length."""
    if m < GRAM:
        return 0, 1
    k = min(m * EDITS_PERCENT // 100, (m - GRAM) // GRAM)
    return k, m - GRAM + 1 - k * GRAM


@dataclass(frozen=True)
class Grams:
    """Grams of one width: sorted distinct hashes, and their places in the joined items."""

    width: int
    hashes: np.ndarray
    begin: np.ndarray  # where each hash's places begin
    places: np.ndarray
    sieve: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, width: int) -> Grams:
        n = np.maximum(lens - width + 1, 0)
        places = (np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())).astype(np.int32)
        own = R.mix(R.windows(R.prefixes(flat), width))[places] if len(places) else np.zeros(0, U)
        by = np.argsort(own, kind="stable")
        hashes, begin = np.unique(own[by], return_index=True)
        sieve = np.zeros(1 << _SIEVE, bool)
        sieve[(hashes >> U(64 - _SIEVE)).astype(np.int64)] = True
        return cls(width, hashes, np.append(begin, len(by)).astype(np.int32), places[by], sieve)

    def met(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in the text, place in the items) of every gram in common."""
        none = (np.zeros(0, np.int64),) * 3
        if len(data) < self.width or not len(self.hashes):
            return none
        h = R.mix(R.windows(R.prefixes(data), self.width))
        pos = np.flatnonzero(self.sieve[(h >> U(64 - _SIEVE)).astype(np.int64)])
        g = np.minimum(np.searchsorted(self.hashes, h[pos]), len(self.hashes) - 1)
        real = self.hashes[g] == h[pos]
        pos, g = pos[real], g[real]
        text = np.searchsorted(offs, pos, "right") - 1
        whole = pos + self.width <= offs[text + 1]
        pos, g, text = pos[whole], g[whole], text[whole]
        n = self.begin[g + 1] - self.begin[g]
        k = np.repeat(self.begin[g], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(text, n), np.repeat(pos - offs[text], n), self.places[k].astype(np.int64)


@dataclass(frozen=True)
class Index:
    ids: list[int | None]
    items: list[bytes]
    starts: np.ndarray
    edits: np.ndarray
    need: np.ndarray
    grams: list[Grams]

    @classmethod
    def build(cls, rows: list[tuple[int | None, str | None]], least: int = GRAM) -> Index:
        ids, items = [], []
        for i, t in rows:
            raw = np.frombuffer((t or "").encode(), np.uint8)
            body = normalised(raw, np.array([0, len(raw)]))[0].tobytes().strip()
            if len(body) >= max(least, 1):
                ids.append(i)
                items.append(body)
        lens = np.array([len(x) for x in items], np.int64)
        bound = [budget(int(m)) for m in lens]
        flat = np.frombuffer(b"".join(items), np.uint8)
        starts = np.cumsum(lens) - lens
        widths = sorted({min(int(m), GRAM) for m in lens})
        # a shorter item is its only gram; items of the full width and more share one index
        parts = [(lens == w) if w < GRAM else (lens >= GRAM) for w in widths]
        grams = [Grams.of(flat, starts[p], lens[p], w) for w, p in zip(widths, parts)]
        return cls(ids, items, starts, np.array([b[0] for b in bound], np.int64), np.array([b[1] for b in bound], np.int64), grams)

    def bands(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, first diagonal) of the retained bands; diagonals count from the text's start."""
        for grams in self.grams:
            text, at, place = grams.met(data, offs)
            item = np.searchsorted(self.starts, place, "right") - 1
            diag = at - (place - self.starts[item])
            cell = diag // (self.edits[item] + 1)
            keys = np.stack([np.concatenate([text, text]), np.concatenate([item, item]), np.concatenate([cell, cell - 1])])
            by = np.lexsort(keys[::-1])
            keys = keys[:, by]
            cut = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if len(by) else np.zeros(0, int)
            count = np.diff(np.append(cut, len(by)))
            keys = keys[:, cut]
            for t, i, c in keys[:, count >= self.need[keys[1]]].T.tolist():
                yield t, i, c * (int(self.edits[i]) + 1)


def aligned(item: bytes, region: bytes, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of item in region, or None beyond ``edits``.

    The region is the band: the item's i-th byte is met within ``len(region) -
    len(item)`` places of i, so rows of that width suffice.
    """
    at = region.find(item)
    if at >= 0:
        return 0, at, at + len(item)

    def best_end(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        slack = edits + 1  # places before the first byte, for deletions there
        wide = max(0, len(b) - len(a)) + 2 * slack
        step = np.arange(wide + 1)
        base = -slack  # row[j]: cost of ending before b[base + j]
        row = np.where(step >= slack, 0, 1 << 30)
        padded = np.concatenate([np.full(slack, -1), b, np.full(wide + len(a) + 2, -1)])
        for i in range(len(a)):
            match = row + (padded[i : i + wide + 1] != a[i])  # moves the base by one
            up = np.append(row[1:], 1 << 30) + 1
            row = np.minimum(match, up)
            row = np.minimum.accumulate(row - step) + step
            base += 1
        ends = base + step
        row = np.where((ends >= 0) & (ends <= len(b)), row, 1 << 30)
        j = int(np.argmin(row))
        return int(row[j]), int(ends[j])

    a, b = np.frombuffer(item, np.uint8).astype(np.int64), np.frombuffer(region, np.uint8).astype(np.int64)
    if len(b) + edits < len(a):
        return None
    cost, end = best_end(a, b)
    if cost > edits:
        return None
    _, back = best_end(a[::-1], b[:end][::-1])
    return cost, end - back, end


def _passages(index: Index, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) in bytes of the original text, overlapping ones merged."""
    norm, at, where = normalised(data, offs)
    best: dict[tuple[int, int, int], tuple[int, int]] = {}
    for t, i, diag in index.bands(norm, at):
        k, m = int(index.edits[i]), len(index.items[i])
        text0 = int(at[t])
        first = text0 + max(0, diag - k)
        last = text0 + min(int(at[t + 1]) - text0, diag + 2 * (k + 1) + m + k)
        if got := aligned(index.items[i], norm[first:last].tobytes(), k):
            cost, s, e = got
            key = (t, i, int(where[first + s] - offs[t]))
            end = int(where[first + e - 1] + 1 - offs[t])
            if key not in best or (cost, -end) < (best[key][1], -best[key][0]):
                best[key] = (end, cost)
    rows: list[tuple[int, int, int, int, int]] = []
    taken: dict[tuple[int, int], list[tuple[int, int]]] = {}  # disjoint stretches, sorted
    for (t, i, s), (e, c) in sorted(best.items(), key=lambda x: (x[0][:2], x[1][1], x[0][2])):
        held = taken.setdefault((t, i), [])
        k = bisect_left(held, (s, e))
        if (k and held[k - 1][1] > s) or (k < len(held) and held[k][0] < e):
            continue  # the cheapest of overlapping ones is there already
        held.insert(k, (s, e))
        rows.append((t, i, s, e, c))
    return rows


def _gathered(batches: Iterator[pa.RecordBatch], bytes_: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= bytes_:
            yield held
            held, size = [], 0
    if held:
        yield held


def _opened(shared: list) -> Iterator[Index]:
    """One index after the other; with several, the value that a broadcast keeps is let go of after its turn."""
    for x in shared:
        yield x.value
        if len(shared) > 1:
            x.__dict__.pop("_value", None)


def _match_batches(shared: list):
    def found(index: Index, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, _, data, offs in R.slices(b.column(1)):
            cols = list(zip(*_passages(index, data, offs))) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array([lo + t for t in cols[0]], pa.int64())),
                    pa.array([index.ids[i] for i in cols[1]], pa.int64()),
                    *(pa.array(c, pa.int64()) for c in cols[2:4]),
                    pa.array(cols[4], pa.int32()),
                ],
                names=["id", "item_id", "start", "end", "edits"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, HELD_BYTES if len(shared) > 1 else 0):
            for index in _opened(shared):
                for b in held:
                    yield from found(index, b)

    return run


def _clean_batches(shared: list):
    """Rows whose text (last column) holds no passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, HELD_BYTES if len(shared) > 1 else 0):
            for index in _opened(shared):
                for k, b in enumerate(held):
                    keep = np.ones(b.num_rows, bool)
                    for lo, _, data, offs in R.slices(b.column(b.num_columns - 1)):
                        keep[[lo + r[0] for r in _passages(index, data, offs)]] = False
                    held[k] = b.filter(pa.array(keep))
            yield from held

    return run


def _indexes(benchmark: DataFrame, item_col: str, item_text: str, block_bytes: int, least: int) -> Iterator:
    """Broadcast indexes of the items, each over at most ``block_bytes`` of them and one item."""
    sc = benchmark.sparkSession.sparkContext
    held, size, any_ = [], 0, False
    for r in benchmark.select(F.col(item_col).cast("bigint"), item_text).orderBy(item_col, item_text).toLocalIterator():
        held.append((r[0], r[1]))
        size += len((r[1] or "").encode())
        if size >= block_bytes:
            yield sc.broadcast(Index.build(held, least))
            held, size, any_ = [], 0, True
    if held or not any_:
        yield sc.broadcast(Index.build(held, least))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, least: int = GRAM) -> DataFrame:
    """One row per passage: id, item_id, start, end (bytes of the text), edits."""
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    shared = list(_indexes(benchmark, item_col, item_text, block_bytes, least))
    return slim.mapInArrow(_match_batches(shared), f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, least: int = GRAM) -> DataFrame:
    """The rows of ``docs`` without a passage of any item, all columns as they are."""
    # numbered names cannot clash with those of the table; the compared text is the last
    wide = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    wide = wide.withColumn("compared", F.coalesce(F.col(f"c{docs.columns.index(text_col)}"), F.lit("")))
    shared = list(_indexes(benchmark, item_col, item_text, block_bytes, least))
    wide = wide.mapInArrow(_clean_batches(shared), wide.schema)
    return wide.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
