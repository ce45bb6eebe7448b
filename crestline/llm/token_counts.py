"""Token counts by heap-and-linked-list byte-pair merging.

Symbols start as characters in a linked list; a heap holds adjacent pairs that
form a piece, lowest rank first and leftmost on ties.  Each pop merges one pair.
The count is the initial symbols less the merges; a symbol left over that is no
piece counts its UTF-8 bytes (byte fallback).  No identifiers are made.

Cases: null counts as empty (0 bytes, 0 tokens); a null id is kept as null;
texts of any length are whole (work per text is linear in its units, and one unit
of n characters costs n log n); repeated rows are counted each; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces as P

MEMO_UNITS = 1_000_000  # memo entries per Python worker; then it starts anew
_MEMO_LENGTH = 64  # longer units are not memoised


class PairMerger(dict):
    """unit -> token count; missing units are merged and remembered."""

    def __init__(self, vocab: P.Vocabulary):
        super().__init__()
        self.rank = {vocab.pieces[i].replace(P.MARK, " "): -vocab.scores[i] for i in vocab.normal}
        self.bytes = any(b >= 0 for b in vocab.byte_ids)
        self.units = vocab.unit_pattern.findall

    def __missing__(self, unit: str) -> int:
        n = self.merge(unit)
        if len(unit) <= _MEMO_LENGTH:
            if len(self) >= MEMO_UNITS:
                self.clear()
            self[unit] = n
        return n

    def merge(self, unit: str) -> int:
        rank, n = self.rank, len(unit)
        sym: list[str | None] = list(unit)
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, unit[i : i + 2]) for i in range(n - 1) if (r := rank.get(unit[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] is None or j >= n or sym[i] + sym[j] != joined:
                continue  # one side was merged meanwhile
            merges += 1
            sym[i], sym[j] = joined, None
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                if (r := rank.get(pair := joined + sym[k])) is not None:
                    heapq.heappush(heap, (r, i, pair))
            h = prev[i]
            if h >= 0 and (r := rank.get(pair := sym[h] + joined)) is not None:
                heapq.heappush(heap, (r, h, pair))
        count = n - merges
        if self.bytes:  # leftovers that are no piece fall back to bytes
            count += sum(len(s.encode()) - 1 for s in sym if s is not None and s not in rank)
        return count

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.units(P.marked(text))))


_MERGERS: dict[str, PairMerger] = {}


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    shared = docs.sparkSession.sparkContext.broadcast(P.load(model_path))  # bounded by the vocabulary

    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("n_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _MERGERS:
            _MERGERS[model_path] = PairMerger(shared.value)
        count = _MERGERS[model_path].count
        for b in batches:
            n = [count(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
