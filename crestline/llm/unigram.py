"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The trie holds the pieces as UTF-8 bytes (blank marker as a blank) in two
integer arrays, base and check.  Viterbi walks it from every character start;
a character that no piece covers costs an unknown penalty and is written as
byte pieces.  Decoding concatenates piece bytes, turns markers into blanks,
byte pieces into bytes, and drops the blank put in front.

Log scores: a file of type unigram has its own.  One of type BPE has merge ranks
instead, so ``zipf_scores`` takes log probabilities by Zipf's law over the rank
order; nothing is trained.

Cases: null and empty texts give no ids and decode to the empty text; a text's own
U+2581 decodes as a blank (as in the library); null ids of documents are kept;
very long texts are whole (units are segmented one by one); repeated rows are
encoded each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces as P

MEMO_UNITS = 600_000
_MEMO_LENGTH = 64
_SLICE = 1 << 21  # characters handled at once inside a batch
UNKNOWN_PENALTY = 10.0


def zipf_scores(vocab: P.Vocabulary, shift: float = 2.7) -> list[float]:
    """log p of a piece by its place among the normal pieces, in file order."""
    place = {i: r for r, i in enumerate(sorted(vocab.normal))}
    norm = math.log(sum(1 / (r + 1 + shift) for r in range(len(place)))) if place else 0.0
    return [float(np.float32(-math.log(place[i] + 1 + shift) - norm)) if i in place else 0.0 for i in range(len(vocab.pieces))]


@dataclass(frozen=True)
class DoubleArray:
    """State s has a child by byte b iff check[base[s] + b] == s; value[s] is a piece id or -1."""

    base: list[int]
    check: list[int]
    value: list[int]

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        tree: dict = {}
        for key, val in keys.items():
            node = tree
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = val
        size = 1 << 12
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        todo, free = [(0, tree)], 1
        for state, node in todo:  # grows while it runs: breadth first
            value[state] = node.get(-1, -1)
            kids = sorted(k for k in node if k >= 0)
            if not kids:
                continue
            at, full, first = max(free, kids[0] + 1) - kids[0], 0, True
            while True:
                while at + 256 >= size:
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                    size *= 2
                if check[at + kids[0]] >= 0:
                    full += 1
                else:
                    if first:
                        free, first = at + kids[0], False
                    if all(check[at + k] < 0 for k in kids):
                        break
                at += 1
            if full >= 0.95 * (at + kids[0] - free + 1):
                free = at + kids[0]  # too dense to search again
            base[state] = at
            for k in kids:
                check[at + k] = state
                todo.append((at + k, node[k]))
        return cls(base, check, value)


@dataclass(frozen=True)
class Model:
    vocab: P.Vocabulary
    scores: list[float]
    trie: DoubleArray


def load(path: str) -> Model:
    """Built once, on the driver; a few MB for 32,000 pieces."""
    vocab = P.load(path)
    unigram = any(math.isfinite(vocab.scores[i]) and vocab.scores[i] != round(vocab.scores[i]) for i in vocab.normal)
    scores = list(vocab.scores) if unigram else zipf_scores(vocab)
    keys = {vocab.pieces[i].replace(P.MARK, " ").encode(): i for i in vocab.normal}
    return Model(vocab, scores, DoubleArray.build(keys))


class Segmenter(dict):
    """unit -> tuple of ids; missing units are decoded by Viterbi and remembered."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.units = model.vocab.unit_pattern.findall
        self.worst = min((model.scores[i] for i in model.vocab.normal), default=0.0) - UNKNOWN_PENALTY
        parts = [p.replace(P.MARK, " ").encode() if i in model.vocab.normal else b"" for i, p in enumerate(model.vocab.pieces)]
        for b, i in enumerate(model.vocab.byte_ids):
            if i >= 0:
                parts[i] = bytes([b])
        if model.vocab.unknown >= 0:
            parts[model.vocab.unknown] = " ⁇ ".encode()
        self.lens = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    def __missing__(self, unit: str) -> tuple[int, ...]:
        ids = self.viterbi(unit.encode())
        if len(unit) <= _MEMO_LENGTH:
            if len(self) >= MEMO_UNITS:
                self.clear()
            self[unit] = ids
        return ids

    def viterbi(self, raw: bytes) -> tuple[int, ...]:
        base, check, value = self.model.trie.base, self.model.trie.check, self.model.trie.value
        scores, n, size = self.model.scores, len(raw), len(self.model.trie.check)
        best, came, by = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            lead = raw[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, state, covered = best[i], 0, False
            for j in range(i, n):
                nxt = base[state] + raw[j]
                if nxt >= size or check[nxt] != state:
                    break
                state = nxt
                if (piece := value[state]) >= 0:
                    if (s := here + scores[piece]) > best[j + 1]:
                        best[j + 1], came[j + 1], by[j + 1] = s, i, piece
                    covered = covered or j + 1 == i + width
            if not covered and (s := here + self.worst) > best[i + width]:
                best[i + width], came[i + width], by[i + width] = s, i, -1
            i += width
        out: list[int] = []
        at, spelled, unknown = n, self.model.vocab.byte_ids, self.model.vocab.unknown
        while at > 0:
            if by[at] >= 0:
                out.append(by[at])
            else:
                char = [spelled[b] for b in raw[came[at] : at]]
                out.extend(reversed(char) if min(char) >= 0 else [unknown])
            at = came[at]
        return tuple(reversed(out))

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.__getitem__, self.units(P.marked(text)))), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - ends + lens, lens)
        raw = self.flat[at].tobytes()
        return raw[1:] if raw[:1] == b" " else raw


_SEGMENTERS: dict[str, Segmenter] = {}


def _segmenter(path: str, shared) -> Segmenter:
    if path not in _SEGMENTERS:
        _SEGMENTERS[path] = Segmenter(shared.value)
    return _SEGMENTERS[path]


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of some 2 MB of text, or one text."""
    cuts, run = [0], 0
    for i, size in enumerate(pc.binary_length(b.column(1)).to_pylist()):
        if run and run + size > _SLICE:
            cuts.append(i)
            run = 0
        run += size
    cuts.append(b.num_rows)
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield b.slice(lo, hi - lo)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, decoded string, exact boolean (the decoded text is the given one)."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = _segmenter(model_path, shared)
        for whole in batches:
            for b in _slices(whole):
                texts = b.column(1).to_pylist()
                ids = [seg.encode(t) for t in texts]
                back = [seg.decode(x) for x in ids]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                decoded = [x.decode("utf-8", "replace") for x in back]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), lists, pa.array(decoded, pa.string()), pa.array([x == t for x, t in zip(decoded, texts)], pa.bool_())],
                    names=["id", "ids", "decoded", "exact"],
                )

    slim = _slim(docs, id_col, text_col)
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, ids array<int>, decoded string, exact boolean").withColumnRenamed("id", id_col)
