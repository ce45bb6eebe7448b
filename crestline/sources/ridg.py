"""The RIDG container: points, segments or lines with metadata, all big-endian.

Fixed values of the format: magic "RIDG"; types 1 points, 2 segments, 3 lines; a
point is row, column (1/128 pixel, uint32), brightness, strength (float32); a line is
a count and its points; the trailer is a count of (key, length, bytes padded to 4).
Metadata keys: 0x10 image rows, 0x11 image columns (uint32 each), 0x80 one class byte
per entry, 0x81 one float32 likelihood per entry.

Reading runs where the files are: ``read`` maps binary file rows to entry rows in
Arrow batches, so many files decode in parallel; a file is read in parts by several tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import drop, stage
from . import ranges
from .ranges import Read

MAGIC = b"RIDG"
TYPES = {"points": 1, "segments": 2, "lines": 3}
ROWS, COLS, CLASSES, LIKELIHOODS = 0x10, 0x11, 0x80, 0x81
POINT = np.dtype([("row_fx", ">u4"), ("col_fx", ">u4"), ("brightness", ">f4"), ("strength", ">f4")])
POINT_SQL = "struct<row_fx:bigint,col_fx:bigint,brightness:float,strength:float>"
SCHEMAS = {
    "points": "image_id string, entry_id bigint, row_fx bigint, col_fx bigint, brightness float, strength float",
    "segments": f"image_id string, entry_id bigint, start {POINT_SQL}, end {POINT_SQL}",
    "lines": f"image_id string, entry_id bigint, points array<{POINT_SQL}>",
}
_ARROW_POINT = pa.struct([("row_fx", pa.int64()), ("col_fx", pa.int64()), ("brightness", pa.float32()), ("strength", pa.float32())])


class FormatError(ValueError):
    """Not a RIDG file, or a truncated one."""


@dataclass
class Dataset:
    """Entries as arrays: points (n,), segments (n, 2), lines a list of (k,) of POINT."""

    kind: str
    entries: np.ndarray | list[np.ndarray]
    metadata: dict[int, bytes] = field(default_factory=dict)

    def uint32(self, key: int) -> int | None:
        raw = self.metadata.get(key)
        return struct.unpack(">I", raw)[0] if raw is not None and len(raw) == 4 else None

    def set_uint32(self, key: int, value: int) -> None:
        self.metadata[key] = struct.pack(">I", value)

    def classes(self) -> np.ndarray | None:
        """One class per entry, or None; raises if their number differs from the entries'."""
        raw = self.metadata.get(CLASSES)
        if raw is None:
            return None
        if len(raw) != len(self.entries):
            raise FormatError("the classification does not have one byte per entry")
        return np.frombuffer(raw, np.uint8)

    def likelihoods(self) -> np.ndarray | None:
        raw = self.metadata.get(LIKELIHOODS)
        if raw is None:
            return None
        if len(raw) != 4 * len(self.entries):
            raise FormatError("the likelihoods do not have four bytes per entry")
        return np.frombuffer(raw, ">f4").astype(np.float32)


def encode(data: Dataset) -> bytes:
    out = [frame(data.kind, len(data.entries))]
    if data.kind == "lines":
        for line in data.entries:
            out += [struct.pack(">I", len(line)), np.asarray(line, POINT).tobytes()]
    else:
        out.append(np.asarray(data.entries, POINT).tobytes())
    return b"".join([*out, trailer(data.metadata)])


def decode(raw: bytes) -> Dataset:
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(raw):
            raise FormatError("the file ends early")
        at += n
        return raw[at - n : at]

    if take(4) != MAGIC:
        raise FormatError("the magic number is not RIDG")
    type_, _, count = struct.unpack(">III", take(12))
    kind = {v: k for k, v in TYPES.items()}.get(type_)
    if kind is None:
        raise FormatError(f"unknown entry type {type_}")
    if kind == "lines":
        entries: np.ndarray | list = [np.frombuffer(take(struct.unpack(">I", take(4))[0] * POINT.itemsize), POINT) for _ in range(count)]
    else:
        per = 1 if kind == "points" else 2
        flat = np.frombuffer(take(count * per * POINT.itemsize), POINT)
        entries = flat if per == 1 else flat.reshape(count, 2)
    meta: dict[int, bytes] = {}
    for _ in range(struct.unpack(">I", take(4))[0]):
        key, size = struct.unpack(">II", take(8))
        meta[key] = take(size)
        take(-size % 4)
    return Dataset(kind, entries, meta)


def _structs(points: np.ndarray) -> pa.StructArray:
    p = points.ravel()
    cols = [pa.array(p["row_fx"].astype(np.int64)), pa.array(p["col_fx"].astype(np.int64)), pa.array(p["brightness"].astype(np.float32)), pa.array(p["strength"].astype(np.float32))]
    return pa.StructArray.from_arrays(cols, fields=list(_ARROW_POINT))


def batch_of(image_id: str, data: Dataset, first: int = 0) -> pa.RecordBatch:
    n = len(data.entries)
    head = [pa.array([image_id] * n, pa.string()), pa.array(np.arange(first, first + n, dtype=np.int64))]
    if data.kind == "points":
        p = _structs(data.entries)
        return pa.RecordBatch.from_arrays([*head, *p.flatten()], names=["image_id", "entry_id", *_ARROW_POINT.names])
    if data.kind == "segments":
        return pa.RecordBatch.from_arrays([*head, _structs(data.entries[:, 0]), _structs(data.entries[:, 1])], names=["image_id", "entry_id", "start", "end"])
    flat = np.concatenate(data.entries) if n else np.zeros(0, POINT)
    offs = np.concatenate([[0], np.cumsum([len(x) for x in data.entries])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([*head, pa.ListArray.from_arrays(pa.array(offs), _structs(flat))], names=["image_id", "entry_id", "points"])


def exactly(read: Read, at: int, n: int) -> bytes:
    if len(raw := read(at, n)) < n:
        raise FormatError("the file ends early")
    return raw


PART_BYTES = PASS = 4 << 20


def _line_parts(read: Read, count: int, part_bytes: int) -> Iterator[tuple[int, int, int, int]]:
    """The parts of a file of lines, found by passing over their lengths."""
    held, base, at, first, begin = b"", 16, 16, 0, 16
    for i in range(count):
        if at + 4 > base + len(held):
            held, base = read(at, PASS), at
            if len(held) < 4:
                raise FormatError("the file ends early")
        at += 4 + POINT.itemsize * struct.unpack_from(">I", held, at - base)[0]
        if at - begin >= part_bytes or i == count - 1:
            yield first, i + 1 - first, begin, at - begin
            first, begin = i + 1, at


@dataclass
class Layout:
    """Where a file's parts lie: (first entry, entries, offset, bytes), and metadata as key to (offset, bytes)."""

    kind: str
    count: int
    parts: list[tuple[int, int, int, int]]
    metadata: dict[int, tuple[int, int]]


def layout(read: Read, part_bytes: int = PART_BYTES, asked: tuple[int, int] = (0, 2**62)) -> Layout:
    """Parts of about ``part_bytes``; entries of fixed size start at the first one ``asked`` for."""
    head = exactly(read, 0, 16)
    if head[:4] != MAGIC:
        raise FormatError("the magic number is not RIDG")
    type_, _, count = struct.unpack(">III", head[4:])
    kind = {v: k for k, v in TYPES.items()}.get(type_)
    if kind is None:
        raise FormatError(f"unknown entry type {type_}")
    if kind == "lines":
        parts = list(_line_parts(read, count, part_bytes))
    else:
        size = POINT.itemsize * TYPES[kind]
        many, end = max(1, part_bytes // size), min(count, asked[1])
        parts = [(i, min(many, end - i), 16 + i * size, min(many, end - i) * size) for i in range(asked[0], end, many)]
    at = 16 + count * size if kind != "lines" else parts[-1][2] + parts[-1][3] if parts else 16
    (n,) = struct.unpack(">I", exactly(read, at, 4))
    meta, at = {}, at + 4
    for _ in range(n):
        key, size = struct.unpack(">II", exactly(read, at, 8))
        meta[key] = at + 8, size
        at += 8 + size + -size % 4
        exactly(read, at - 1, 1)
    return Layout(kind, count, parts, meta)


def read(spark: SparkSession, path: str, kind: str, with_class: bool = False) -> DataFrame:
    """Entries of the files at ``path`` (image_id = file), optionally with class and likelihood.

    Parts are planned from the headers, and of a range of entries only its bytes are read;
    files on systems that tasks cannot open by range are read whole by Spark.
    """
    from . import planned

    files = ranges.listed(spark, path)
    if all(map(ranges.reachable, files)):
        return planned.scan(spark, planned.RidgSource, files, kind=kind, classes=with_class)
    return entries_of(spark.read.format("binaryFile").load(path).select("path", "content"), kind, with_class)


def entries_of(files: DataFrame, kind: str, with_class: bool = False) -> DataFrame:
    """Entries of (path, content) rows; a file of another kind raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = decode(content)
                if data.kind != kind:
                    raise FormatError(f"{name} holds {data.kind}, not {kind}")
                out = batch_of(name, data)
                if with_class:
                    n = len(data.entries)
                    c, lk = data.classes(), data.likelihoods()
                    out = out.append_column("class", pa.array(c.astype(np.int16) if c is not None else [None] * n, pa.int16()))
                    out = out.append_column("likelihood", pa.array(lk if lk is not None else [None] * n, pa.float32()))
                yield out

    return files.mapInArrow(run, SCHEMAS[kind] + (", class smallint, likelihood float" if with_class else ""))


def headers(files: DataFrame) -> DataFrame:
    """path, kind, entries, metadata (key to value, without values per entry) of (path, content) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [decode(c) for c in b.column(1).to_pylist()]
            meta = [[(k, v) for k, v in d.metadata.items() if k not in (CLASSES, LIKELIHOODS)] for d in data]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([d.kind for d in data]), pa.array([len(d.entries) for d in data], pa.int64()), pa.array(meta, pa.map_(pa.int64(), pa.binary()))],
                names=["path", "kind", "entries", "metadata"],
            )

    return files.select("path", "content").mapInArrow(run, _HEAD)


_HEAD = "path string, kind string, entries bigint, metadata map<bigint,binary>"


def headers_at(spark: SparkSession, path: str) -> DataFrame:
    """``headers`` of the files at ``path``; no value per entry is read."""
    files = ranges.listed(spark, path)
    if not all(map(ranges.reachable, files)):
        return headers(spark.read.format("binaryFile").load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                with ranges.opened(name) as at:
                    one = layout(at)
                    meta = [(k, exactly(at, *v)) for k, v in one.metadata.items() if k not in (CLASSES, LIKELIHOODS)]
                arrays = [pa.array([name]), pa.array([one.kind]), pa.array([one.count], pa.int64()), pa.array([meta], pa.map_(pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["path", "kind", "entries", "metadata"])

    return spark.createDataFrame([(f,) for f in files], "path string").mapInArrow(run, _HEAD)


def _filled(struct: dict[str, pa.Array], n: int) -> np.ndarray:
    out = np.empty(n, POINT)
    for name in POINT.names:
        out[name] = struct[name].to_numpy(zero_copy_only=False)
    return out


def _fields(column: pa.StructArray) -> dict[str, pa.Array]:
    return {column.type[i].name: x for i, x in enumerate(column.flatten())}


def encoded_entries(part: pa.Table, kind: str) -> bytes:
    """The entries of a table, in its order, as the format's bytes; columns are filled at once."""
    part = part.combine_chunks()
    one = lambda name: part[name].chunk(0) if part[name].num_chunks else pa.array([], part[name].type)
    n = part.num_rows
    if kind == "points":
        return _filled({x: one(x) for x in POINT.names}, n).tobytes()
    if kind == "segments":
        out = np.empty((n, 2), POINT)
        for k, side in enumerate(("start", "end")):
            out[:, k] = _filled(_fields(one(side)), n)
        return out.tobytes()
    lists = one("points")
    flat = lists.flatten()
    size = np.diff(lists.offsets.to_numpy()).astype(np.int64) if n else np.zeros(0, np.int64)
    words = np.empty(n + 4 * len(flat), ">u4")  # a count and four words a point
    head = np.cumsum(4 * size + 1) - (4 * size + 1)
    rest = np.ones(len(words), bool)
    rest[head] = False
    words[head] = size
    words[rest] = _filled(_fields(flat), len(flat)).view(">u4").ravel()
    return words.tobytes()


def frame(kind: str, count: int) -> bytes:
    """The header of a file."""
    return MAGIC + struct.pack(">III", TYPES[kind], 0, count)


def trailer(metadata: dict[int, bytes]) -> bytes:
    out = [struct.pack(">I", len(metadata))]
    for key, value in metadata.items():
        out += [struct.pack(">II", key, len(value)), value, b"\0" * (-len(value) % 4)]
    return b"".join(out)


def image_size(rows: int | None, cols: int | None) -> dict[int, bytes]:
    return {key: struct.pack(">I", value) for key, value in ((ROWS, rows), (COLS, cols)) if value is not None}


def _chunks(entries: DataFrame) -> DataFrame:
    """file, no, n, body, classes, likelihoods: parts of files in entry order, of entries with their ``file``."""
    from ..operators.entries import kind_of
    from .sink import by_file

    kind = kind_of(entries)
    per = [(c, code) for c, code in (("class", "u1"), ("likelihood", ">f4"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, part in by_file(b):
                t = pa.Table.from_batches([part])
                own = [t[c].to_numpy().astype(code).tobytes() if c in t.column_names and not t[c].null_count else None for c, code in per]
                columns = [pa.array([path]), pa.array([t.num_rows], pa.int64()), *(pa.array([x], pa.binary()) for x in (encoded_entries(t, kind), *own))]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "n", "body", "classes", "likelihoods"])

    kept = [c for c in entries.columns if c != "file"]
    done = entries.select("file", *kept).orderBy("file", "entry_id").mapInArrow(run, "file string, n bigint, body binary, classes binary, likelihoods binary")
    return done.withColumn("no", F.monotonically_increasing_id())


def write(entries: DataFrame, files: DataFrame, kind: str | None = None, by_parts: bool | None = None) -> None:
    """Container files from many tasks: ``entries`` carry their ``file``; ``files`` (file, metadata map<int,binary>) names all of them.

    Classes and likelihoods travel if every entry of a file has one.  Order within a file
    is that of entry_id.
    """
    from ..operators.entries import kind_of
    from . import sink

    kind = kind or kind_of(entries)
    chunks = stage(_chunks(entries), "container-chunks")
    all_there = lambda c: (F.count(F.lit(1)) == F.count(c)) & (F.count(F.lit(1)) > 0)
    sums = chunks.groupBy("file").agg(F.sum("n").alias("count"), all_there("classes").alias("classed"), all_there("likelihoods").alias("likely"))
    each = files.join(sums, "file", "left").withColumns({"count": F.coalesce("count", F.lit(0)), "classed": F.coalesce("classed", F.lit(False)), "likely": F.coalesce("likely", F.lit(False))})
    zero = lambda n: F.substring(sink.raw(bytes(4)), 1, n.cast("int"))
    pad = lambda n: zero((4 - n % 4) % 4)
    told = F.transform(F.map_entries("metadata"), lambda e: F.concat(sink.u32(e["key"]), sink.u32(F.octet_length(e["value"])), e["value"], pad(F.octet_length(e["value"]))))
    keys = F.size("metadata") + F.col("classed").cast("int") + F.col("likely").cast("int")
    none = sink.raw(b"")
    start = F.concat(sink.u32(keys), F.aggregate(told, none, lambda a, x: F.concat(a, x)), F.when(F.col("classed"), F.concat(sink.u32(F.lit(CLASSES)), sink.u32(F.col("count")))).otherwise(none))
    middle = F.concat(F.when(F.col("classed"), pad(F.col("count"))).otherwise(none), F.when(F.col("likely"), F.concat(sink.u32(F.lit(LIKELIHOODS)), sink.u32(F.col("count") * 4))).otherwise(none))
    own = chunks.join(sums, "file")
    parts = [
        sink.pieces(each, 0, F.concat(sink.raw(frame(kind, 0)[:12]), sink.u32(F.col("count")))),
        sink.pieces(chunks, 1, F.col("body"), F.col("no")),
        sink.pieces(each, 2, start),
        sink.pieces(own.filter("classed"), 3, F.col("classes"), F.col("no")),
        sink.pieces(each, 4, middle),
        sink.pieces(own.filter("likely"), 5, F.col("likelihoods"), F.col("no")),
    ]
    sink.write(reduce(DataFrame.unionByName, parts), by_parts)
    drop(chunks)


def write_images(entries: DataFrame, dims: DataFrame, folder: str) -> None:
    """A container ``folder``/<image_id>.ridg for each image of ``dims``, with its size as metadata."""
    path = F.concat(F.lit(folder.rstrip("/") + "/"), F.col("image_id"), F.lit(".ridg"))
    from .sink import u32

    size = F.create_map(F.lit(ROWS), u32(F.col("rows")), F.lit(COLS), u32(F.col("cols")))
    write(entries.withColumn("file", path), dims.select(path.alias("file"), size.alias("metadata")))
