"""Line dedup by a log-template tree of fixed depth.

A line goes down the tree by its token count, its two leading tokens and a block of its
other tokens; tokens with a digit are one variable token throughout.

* Lines that recur as they are (masked so) in ``min_docs`` documents or more are
  templates by themselves.  Lines of eight tokens and more that are equal as a whole,
  digits included, are repeats from two documents on.
* The rest is generalised: a template may have one variable field in five tokens, four
  at most (``fields``).  Its other tokens are cut into one block more than that, so
  one block is without variable fields and its lines meet in that block's leaf.
  There a token is constant if it recurs at its place in ``min_docs`` documents
  (counting a document once per masked line), else a variable field.  A template found
  in ``min_docs`` documents is recurring.
* A template needs constants that are no numbers in at least half of its tokens.

``Rules`` holds these numbers as parameters.  A line is known by two hashes, 123 bits
together; a collision of the first alone (``key_bits`` may shorten it) changes nothing.

Leaves are hashes of the path, so the tree is a chain of grouped counts with map-side
sums, not a structure in one task; it does not depend on the order of lines or on their
number.  Only lines with a recurring block, which do not recur as they are, are cut
into tokens, once per masked line.

Recurring lines stay in the document with the smallest id and are dropped elsewhere.

Cases: null text counts as empty; blank lines stay; null ids sort last; where ids
are null or repeated every row counts, and of those with the smallest id the one with
the smallest print of the text keeps the lines (one of them where texts are equal too);
extra columns pass through untouched, whatever their names; an empty table gives an
empty result; long lines and texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import drop, stage
from . import rolling as R
from .rows import Rows, free_name, split_by_keys
from .screen import bits_for, hits, key_bitmap
from .skew import join_groups

U = R.U
MASKED, WHOLE, BLOCK_ = 0, 1, 2  # last two bits of a key: a masked line, a line as it is, a block; a block's number precedes them
_C = [U(c) for c in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407)]
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_NUMBER = U(42)


LINE = ["sig", "print"]  # the two hashes
_INNER = {"print": "text_print"}  # a row's own print, out of the way


@dataclass(frozen=True)
class Rules:
    """``lead`` tokens begin the path; one variable field in ``per_field`` tokens, ``most_fields`` (7 or fewer) at most;
    lines of ``whole_from`` tokens that are equal as a whole recur from two documents on."""

    lead: int = 2
    per_field: int = 5
    most_fields: int = 4
    whole_from: int = 8
    key_bits: int = 59

    def __post_init__(self):
        if not (self.lead >= 0 and self.per_field >= 1 and 0 <= self.most_fields <= 7 and self.whole_from >= 1 and 0 <= self.key_bits <= 59):
            raise ValueError("rules out of range")

    def fields(self, count):
        """Variable fields that a template of so many tokens may have."""
        return np.minimum(count // self.per_field, self.most_fields)

    def tagged(self, h: np.ndarray, tag) -> np.ndarray:
        return R.mix(h) & U(2**64 - 2 ** (64 - self.key_bits)) | np.asarray(tag).astype(U)


class Lines:
    """Lines with tokens of a slice of texts, and their keys."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, rules: Rules):
        self.rules = rules
        starts, ends, _ = R.tokens(data, offs)
        breaks = np.flatnonzero(data == 10)
        cuts = np.sort(np.concatenate([breaks + 1, offs[:-1]]), kind="stable")  # where lines begin
        line_of = np.searchsorted(cuts, starts, "right") - 1
        pre = R.prefixes(data)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        exact = R.mix(R.stretches(pre, starts, ends) + (ends - starts).astype(U) * _C[2])
        numbers = digits[ends] > digits[starts]
        self.tokens = np.where(numbers, _NUMBER, exact)
        self.first = np.flatnonzero(np.concatenate([[True], line_of[1:] != line_of[:-1]])) if len(starts) else np.zeros(0, np.int64)
        self.count = np.diff(np.concatenate([self.first, [len(starts)]])).astype(np.int64)
        self.place = np.arange(len(starts)) - np.repeat(self.first, self.count)
        self.text = np.searchsorted(offs, starts[self.first], "right") - 1
        # a break that ends its text begins the next text's place; it belongs to its own
        self.line = np.searchsorted(breaks, starts[self.first]) - np.searchsorted(breaks, offs[:-1])[self.text]
        self.sums, whole = self._sums(self.tokens), self._sums(exact)
        twin, whole2 = self._sums(self.tokens ^ _C[2]), self._sums(exact ^ _C[2])
        tag = self.count.astype(U) * _C[1]
        last = self.first + self.count
        digital = np.add.reduceat(numbers, self.first, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        self.worded = 2 * digital <= self.count
        asis = (self.count >= rules.whole_from) & (digital == 0)  # such a masked line is the line itself
        self.masked = rules.tagged(self.sums[last] - self.sums[self.first] + tag, asis)
        self.masked2 = R.mix(twin[last] - twin[self.first] + tag)
        self.long = (self.count >= rules.whole_from) & (digital > 0)
        self.exact = rules.tagged(whole[last] - whole[self.first] + tag + _C[2], WHOLE)
        self.exact2 = R.mix(whole2[last] - whole2[self.first] + tag)
        lead = self.sums[np.minimum(self.first + rules.lead, last)] - self.sums[self.first]
        self._leaf = R.mix(lead + tag)
        self.fields = np.where(self.worded & (self.count > rules.lead), rules.fields(self.count), 0)

    def _sums(self, tokens: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, U), np.cumsum(R.mix(tokens + (self.place + 1).astype(U) * _C[0]))])

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, key, second hash) of every block of the lines that may have variable fields."""
        at = np.flatnonzero(self.fields)
        n = self.fields[at] + 1
        row = np.repeat(at, n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        lead = self.rules.lead
        tail, n = self.count[row] - lead, np.repeat(n, n)
        lo, hi = (self.first[row] + lead + tail * x // n for x in (k, k + 1))
        path = self.sums[hi] - self.sums[lo] + self._leaf[row] + k.astype(U) * _C[2]
        return row, self.rules.tagged(path, 4 * k + BLOCK_), R.mix(path ^ _C[0])


def _taken(b: pa.RecordBatch, row: np.ndarray) -> list[pa.Array]:
    """What identifies the rows: all columns but the text."""
    at = pa.array(row)
    return [c.take(at) for c in b.columns[:-1]]


def _count_batches(rules: Rules):
    """Keys of every text, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, offs in R.slices(b.column(b.num_columns - 1)):
                x = Lines(data, offs, rules)
                row, block, block2 = x.blocks()
                text = np.concatenate([x.text[x.worded], x.text[x.long], x.text[row]])
                sig = np.concatenate([x.masked[x.worded], x.exact[x.long], block])
                print_ = np.concatenate([x.masked2[x.worded], x.exact2[x.long], block2])
                by = np.lexsort((print_, sig, text))
                text, sig, print_ = text[by], sig[by], print_[by]
                new = np.ones(len(sig), bool)
                new[1:] = (sig[1:] != sig[:-1]) | (print_[1:] != print_[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(sig[new].view(np.int64)), pa.array(print_[new].view(np.int64)), *_taken(b, lo + text[new])], names=[*LINE, *b.schema.names[:-1]])

    return run


def _lists(values: np.ndarray, begin: np.ndarray, size: np.ndarray, some: np.ndarray) -> pa.Array:
    """Stretches of ``values`` as lists, null where not ``some``."""
    size = np.where(some, size, 0)
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values[at].view(np.int64)), mask=pa.array(~some))


def _found_batches(bits: int, shared, rules: Rules):
    """Lines that may recur as they are, and those with a block that may recur.

    ``blocks`` is null for lines without such a block; it and ``toks`` are filled for the
    first line of its masked form in a slice, else empty and null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, offs in R.slices(b.column(b.num_columns - 1)):
                x = Lines(data, offs, rules)
                row, block, block2 = x.blocks()
                hit = hits(shared.value, bits, block)
                row, block, block2 = row[hit], block[hit], block2[hit]
                of = np.bincount(row, minlength=len(x.count))  # blocks of each line, which are neighbours
                mine = np.flatnonzero(x.worded & (hits(shared.value, bits, x.masked) | (of > 0)))
                long_ = np.flatnonzero(x.long & hits(shared.value, bits, x.exact))
                by = np.lexsort((x.masked2[mine], x.masked[mine]))
                one, two = x.masked[mine][by], x.masked2[mine][by]
                fresh = np.zeros(len(mine), bool)
                fresh[by] = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])[: len(by)]
                fresh &= of[mine] > 0
                begin = np.cumsum(of) - of
                none = np.zeros(len(long_), bool)
                line = np.concatenate([mine, long_])
                size = np.where(np.concatenate([fresh, none]), of[line], 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([x.masked[mine], x.exact[long_]]).view(np.int64)),
                        pa.array(np.concatenate([x.masked2[mine], x.exact2[long_]]).view(np.int64)),
                        *_taken(b, lo + x.text[line]),
                        pa.array(x.line[line].astype(np.int32)),
                        _lists(block, begin[line], size, np.concatenate([of[mine] > 0, none])),
                        _lists(block2, begin[line], size, np.concatenate([of[mine] > 0, none])),
                        _lists(x.tokens, x.first[line], x.count[line], np.concatenate([fresh, none])),
                    ],
                    names=[*LINE, *b.schema.names[:-1], "line", "blocks", "blocks2", "toks"],
                )

    return run


def _rewrite_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns are text and dropped line numbers; they become text and count."""
    for b in batches:
        texts, n = [], []
        k = b.num_columns - 2
        for t, gone in zip(b.column(k), b.column(k + 1)):
            drop_ = set(gone.as_py() or ())
            texts.append("\n".join(x for i, x in enumerate(t.as_py().split("\n")) if i not in drop_) if drop_ else t.as_py())
            n.append(len(drop_))
        yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(texts, pa.string()), pa.array(n, pa.int64())], names=[*b.schema.names[:k], "text", "n_dropped"])


def _generalised(rare: DataFrame, min_docs: int, rules: Rules) -> DataFrame:
    """(sig, print, tpl, tpl2): the templates of masked lines that do not recur as they are."""
    docs = rare.select(*LINE, "key").distinct().groupBy(*LINE).agg(F.count(F.lit(1)).alias("w"))
    forms = rare.filter("toks is not null").groupBy(*LINE).agg(F.first(F.struct("blocks", "blocks2", "toks")).alias("x")).select(*LINE, "x.*").join(docs, LINE)
    forms = stage(forms, "line-rare-forms")
    places = forms.select(*LINE, "w", F.explode(F.arrays_zip("blocks", "blocks2")).alias("x")).select(*LINE, "w", F.col("x.blocks").alias("leaf"), F.col("x.blocks2").alias("leaf2"))
    total, = places.agg(F.count(F.lit(1))).first()
    leaf = ["leaf", "leaf2"]
    leaves = places.groupBy(*leaf).agg(F.sum("w").alias("docs"), F.count(F.lit(1)).alias("rows")).filter(F.col("docs") >= min_docs).select(*leaf, "rows")
    places = join_groups(places, leaves, leaf, "rows", total).filter("rows is not null").select(*LINE, *leaf, "w")
    # the leaf's own tokens (leading ones and block) are constant; the others are looked up
    spare = F.least(F.expr(f"n div {rules.per_field}"), F.lit(rules.most_fields)).cast("int")
    k = F.shiftright("leaf", 2).bitwiseAND(7).cast("int")
    edge = lambda x: F.lit(rules.lead) + F.expr(f"cast((n - {rules.lead}) * {x} div (spare + 1) as int)")
    toks = places.join(forms.select(*LINE, "toks"), LINE).withColumn("n", F.size("toks")).withColumn("spare", spare).withColumn("k", k)
    toks = toks.select(*LINE, *leaf, "w", "spare", edge("k").alias("lo"), edge("(k + 1)").alias("hi"), F.posexplode("toks").alias("pos", "tok"))
    toks = toks.filter((F.col("pos") >= rules.lead) & ~F.col("pos").between(F.col("lo"), F.col("hi") - 1))
    toks = stage(toks.select(*LINE, *leaf, "w", "spare", F.xxhash64("pos", "tok").alias("field")), "line-fields")
    total, = toks.agg(F.count(F.lit(1))).first()
    support = toks.groupBy(*leaf, "field").agg(F.sum("w").alias("docs"), F.count(F.lit(1)).alias("rows")).filter(F.col("docs") >= min_docs)
    known = join_groups(toks, support.select(*leaf, "field", "rows"), [*leaf, "field"], "rows", total)
    fixed = F.col("rows").isNotNull()
    kept = known.groupBy(*LINE, *leaf, "spare").agg(F.count_if(~fixed).alias("free"), F.coalesce(F.bit_xor(F.when(fixed, F.col("field"))), F.lit(0)).alias("x"))
    out = stage(kept.filter("free <= spare").select(*LINE, F.xxhash64("leaf", "x", "free").alias("tpl"), F.xxhash64("free", "leaf2", "x").alias("tpl2")), "line-forms")
    drop(forms)
    drop(toks)
    return out


def recurring_lines(rows: Rows, min_docs: int = 3, rules: Rules = Rules(), copies: Column | None = None) -> DataFrame:
    """(key, gone): numbers of the lines to drop, of the rows that have some.

    Rows for which ``copies`` holds count where lines recur, but keep none and are not in the result.
    """
    slim = rows.df.select(*rows.slim, *([] if copies is None else [copies.cast("bigint").alias("copy")]), "text")
    stays = F.lit(True) if copies is None else F.col("copy") == 0
    kinds = "sig bigint, `print` bigint, " + ", ".join(f"{_INNER.get(c, c)} bigint" for c in slim.columns[:-1])
    slim = slim.select(*[F.col(c).alias(_INNER.get(c, c)) for c in slim.columns])
    own, order = slim.columns[:-1], F.col("key") if rows.clear else F.struct("id", "text_print", "key")
    counted = slim.mapInArrow(_count_batches(rules), kinds)
    least = F.when(F.col("sig").bitwiseAND(3) == WHOLE, min(min_docs, 2)).otherwise(min_docs)
    table = stage(counted.groupBy(*LINE).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(stays, order)).alias("holder")).filter(F.col("n") >= least), "line-templates")
    count, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = bits_for(count)
    shared = slim.sparkSession.sparkContext.broadcast(key_bitmap(table, "sig", bits))
    found = slim.mapInArrow(_found_batches(bits, shared, rules), f"{kinds}, line int, blocks array<bigint>, blocks2 array<bigint>, toks array<bigint>")
    met = stage(join_groups(found, table.filter(F.col("sig").bitwiseAND(3) != BLOCK_), LINE, "n", total).filter((F.col("n").isNotNull() & stays) | F.expr("n is null and blocks is not null")), "line-found")
    gone = met.filter(F.col("n").isNotNull() & stays & (F.col("holder") != order)).select("key", "line")
    rare = met.filter("n is null")
    forms = _generalised(rare, min_docs, rules)
    lines = stage(rare.select(*LINE, *own, "line").join(forms, LINE).drop(*LINE), "line-rare")
    tpl = ["tpl", "tpl2"]
    by_row = lines.select(*tpl, *own).distinct()
    tpls = by_row.groupBy(*tpl).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(stays, order)).alias("holder")).filter(F.col("n") >= min_docs)
    rare_total, = by_row.agg(F.count(F.lit(1))).first()
    more = join_groups(lines, tpls, tpl, "n", rare_total).filter(stays & (F.col("holder") != order))
    out = stage(gone.unionByName(more.select("key", "line")).groupBy("key").agg(F.collect_set("line").alias("gone")), "line-gone")
    drop(table, met, forms, lines)
    return out


def drop_recurring_lines(docs: DataFrame, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", count_as: str | None = "n_dropped", keep_emptied: bool = True, rules: Rules = Rules(), copy_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` with recurring lines gone from the text, and how many went.

    The count's column is ``count_as`` (with underscores in front where the table has one
    of that name; None for none).  Without ``keep_emptied``, rows go that had words and are
    left without one.  ``copy_col`` names a boolean column of ``docs``: rows where it is true
    count where lines recur, hold no line for others, and go with that column.
    """
    rows = Rows.of(docs, id_col, text_col)
    copies = None if copy_col is None else F.col(f"c{docs.columns.index(copy_col)}")
    gone = recurring_lines(rows, min_docs, rules, copies)
    n_gone, = gone.agg(F.count(F.lit(1))).first()
    same, other = split_by_keys(rows.df if copies is None else rows.df.filter(~copies), gone, n_gone)
    others = [f"c{i}" for i in range(len(docs.columns))]
    # one plan at every size: where most texts lose lines, their list is too large to broadcast
    ready = other.join(gone.hint("merge"), "key", "left").select(*others, "text", "gone")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ready.select(*others).schema)
    changed = ready.mapInArrow(_rewrite_batches, f"{kinds}, text string, n_dropped bigint")
    if not keep_emptied:
        changed = changed.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    out = same.select(*others, "text", F.lit(0).cast("bigint").alias("n_dropped")).unionByName(changed)
    more: list[Column] = [F.col("n_dropped").alias(free_name(docs.columns, count_as))] if count_as else []
    out = rows.restored(out, *more, **{text_col: F.col("text")})
    return out if copy_col is None else out.drop(copy_col)
