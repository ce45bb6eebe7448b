"""One file from many tasks: pieces written at offsets that prefix sums of their sizes give.

Pieces (file, section, no, body) are staged; a file is its pieces in order of section and
number.  Where files can be written at a position, tasks put their pieces into one file
beside the target; elsewhere each piece is an object of its own, and the commit streams them
into the target one after the other.  The commit, a task for each file, checks the size and
gives the file its name, so a target is old or whole.  Writing a piece again changes nothing,
so tasks may be retried or run twice.  Nothing passes through the driver.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import drop, stage
from . import ranges

PIECE = "file string, section int, no bigint, body binary"
_COPY = 8 << 20


def u32(value: Column) -> Column:
    """Four bytes, high byte first."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 8, "0"))


def raw(value: bytes) -> Column:
    return F.lit(bytearray(value))


def pieces(df: DataFrame, section: int, body: Column, no: Column | None = None) -> DataFrame:
    return df.select("file", F.lit(section).alias("section"), (F.lit(0) if no is None else no).cast("bigint").alias("no"), body.alias("body"))


def placed(sized: DataFrame) -> DataFrame:
    """(file, section, no, at) of (file, section, no, n): sums in blocks of 1024 pieces, and over blocks."""
    block = F.shiftright("no", 10)
    before = lambda *by: Window.partitionBy(*by[:1]).orderBy(*by[1:]).rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy("file", "section", block.alias("block")).agg(F.sum("n").alias("n"))
    sums = sums.select("file", "section", "block", F.coalesce(F.sum("n").over(before("file", "section", "block")), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "section", "block").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    each = sized.withColumn("block", block).withColumn("in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return each.join(sums, ["file", "section", "block"]).select("file", "section", "no", (F.col("base") + F.col("in")).alias("at"))


def _beside(path: str, token: str) -> str:
    folder, _, name = path.rpartition("/")
    return f"{folder}/.{name}.{token}"


def _put(token: str, by_parts: bool | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at, body in zip(*(b.column(i).to_pylist() for i in range(3))):
                files, place = ranges.system(_beside(path, token))
                if by_parts or (by_parts is None and ranges.scheme(path) != "file"):
                    files.create_dir(place, recursive=True)
                    with files.open_output_stream(f"{place}/{at:020d}") as out:
                        out.write(body)
                else:
                    os.makedirs(os.path.dirname(place), exist_ok=True)
                    f = os.open(place, os.O_WRONLY | os.O_CREAT, 0o644)
                    try:
                        while body:
                            n = os.pwrite(f, body, at)
                            body, at = body[n:], at + n
                    finally:
                        os.close(f)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return run


def _commit(token: str, by_parts: bool | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path, size in zip(*(b.column(i).to_pylist() for i in range(2))):
                files, place = ranges.system(_beside(path, token))
                target = ranges.system(path)[1]
                if by_parts or (by_parts is None and ranges.scheme(path) != "file"):
                    if files.get_file_info(place).type != fs.FileType.NotFound:
                        parts = sorted(x.path for x in files.get_file_info(fs.FileSelector(place)))
                        with files.open_output_stream(target) as out:
                            for part in parts:
                                with files.open_input_stream(part) as f:
                                    while piece := f.read(_COPY):
                                        out.write(piece)
                elif os.path.exists(place) and os.path.getsize(place) == size:
                    os.replace(place, target)
                if files.get_file_info(target).size != size:
                    raise OSError(f"{path} is not whole")
                _gone(path, token)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return run


def _gone(path: str, token: str) -> None:
    from pyarrow import fs

    files, place = ranges.system(_beside(path, token))
    kind = files.get_file_info(place).type
    if kind == fs.FileType.Directory:
        files.delete_dir(place)
    elif kind == fs.FileType.File:
        files.delete_file(place)


def _clean(token: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                _gone(path, token)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return run


def write(parts: DataFrame, by_parts: bool | None = None) -> None:
    """The files of PIECE rows.  ``by_parts``: as objects that the commit joins (by default where a file cannot be written at a position)."""
    token = uuid.uuid4().hex
    held = stage(parts, "pieces")
    sized = held.select("file", "section", "no", F.octet_length("body").cast("bigint").alias("n"))
    totals = sized.groupBy("file").agg(F.sum("n").alias("n"))
    try:
        spread = held.filter(F.octet_length("body") > 0).join(placed(sized), ["file", "section", "no"])
        spread.select("file", "at", "body").mapInArrow(_put(token, by_parts), "n bigint").agg(F.sum("n")).collect()
        totals.mapInArrow(_commit(token, by_parts), "n bigint").agg(F.sum("n")).collect()
    except BaseException:
        totals.select("file").mapInArrow(_clean(token), "n bigint").agg(F.sum("n")).collect()
        raise
    finally:
        drop(held)


DEFLATE_HEAD = b"\x78\x9c"
BAND = "file string, no bigint, body binary, adler bigint, n bigint"
_PRIME = 65521  # of Adler-32


def deflated(body: bytes) -> bytes:
    """A part of a deflate stream that rests on nothing before it and ends on a whole byte."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packer.compress(body) + packer.flush(zlib.Z_FULL_FLUSH)


def deflate_tail(adler: int) -> bytes:
    """An empty last block, and the checksum of all that was packed."""
    return b"\x03\x00" + struct.pack(">I", adler)


def joined_adler(parts: Iterable[tuple[int, int]]) -> int:
    """Adler-32 of texts one after the other, from (Adler-32, length) of each."""
    a, b = 1, 0
    for adler, n in parts:
        b = (b + (adler >> 16) + (a - 1) * n) % _PRIME
        a = (a + (adler & 0xFFFF) - 1) % _PRIME
    return b << 16 | a


@contextmanager
def banded(bands: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
    """BAND rows, staged, and (file, adler, size) of each file: a file has one such row a megabyte."""
    done = stage(bands, "bands")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        adler = joined_adler(zip(table["adler"].to_pylist(), table["n"].to_pylist()))
        return pa.table({"file": table["file"].slice(0, 1), "adler": pa.array([adler], pa.int64()), "size": pa.array([sum(table["size"].to_pylist())], pa.int64())})

    slim = done.select("file", "no", "adler", "n", F.octet_length("body").cast("bigint").alias("size"))
    try:
        yield done, slim.groupBy("file").applyInArrow(run, "file string, adler bigint, size bigint")
    finally:
        drop(done)


def text_bands(lines: DataFrame) -> DataFrame:
    """BAND rows of (file, line) rows, in their order; every line begins with a newline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, part in by_file(b):
                told = "".join("\n" + x for x in part.column(1).to_pylist()).encode()
                columns = [pa.array([path]), pa.array([deflated(told)], pa.binary()), pa.array([zlib.adler32(told)], pa.int64()), pa.array([len(told)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "body", "adler", "n"])

    told = lines.select("file", "line").mapInArrow(run, "file string, body binary, adler bigint, n bigint")
    return told.select("file", F.monotonically_increasing_id().alias("no"), "body", "adler", "n")


def text_pieces(lines: DataFrame, section: int) -> DataFrame:
    """Pieces of (file, line) rows, in their order; every line ends with a newline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, body in by_file(b):
                told = "".join(x + "\n" for x in body.column(1).to_pylist()).encode()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([told], pa.binary())], names=["file", "body"])

    told = lines.select("file", "line").mapInArrow(run, "file string, body binary")
    return pieces(told, section, F.col("body"), F.monotonically_increasing_id())


def by_file(b: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Stretches of a batch, sorted by its first column, that belong to one file."""
    names = b.column(0).to_pylist()
    at = 0
    for i in range(1, len(names) + 1):
        if i == len(names) or names[i] != names[at]:
            yield names[at], b.slice(at, i - at)
            at = i
