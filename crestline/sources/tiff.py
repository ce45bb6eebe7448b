"""Single-channel TIFF in strips: float32 surfaces in and out, 8-bit masks out and back.

Tag numbers, field types and compression codes are those of the TIFF 6.0 specification and
its supplements; strips may be plain, PackBits, LZW or deflate, the file classic or BigTIFF.
Tiled files, predictors and other sample formats are refused, not guessed at.  Output is
plain, written in bands of rows by many tasks, and BigTIFF where it passes 4 GB.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.surface import SCHEMA, clipped
from . import ranges
from .ranges import Read, held

# fixed values: tags of TIFF 6.0
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS = 256, 257, 258, 259, 262, 273
SAMPLES, ROWS_PER_STRIP, BYTE_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, FORMAT = 277, 278, 279, 284, 317, 322, 339
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
STRIP_BYTES = 8192
BATCH = 1 << 20  # pixels


class FormatError(ValueError):
    """Not a TIFF of the supported kind."""


def tags_at(read: Read) -> tuple[str, dict[int, list]]:
    raw = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8 or (version := struct.unpack(order + "H", raw[2:4])[0]) not in (42, 43):
        raise FormatError("not a TIFF file")
    big = version == 43
    word, entry, inline = ("Q", 20, 8) if big else ("I", 12, 4)
    try:
        (at,) = struct.unpack_from(order + word, raw, 8 if big else 4)
        first = "Q" if big else "H"
        (n,) = struct.unpack(order + first, read(at, struct.calcsize(order + first)))
        at += 8 if big else 2
        entries = read(at, entry * n)
        out: dict[int, list] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HH" + word, entries, entry * i)
            if kind not in _CODES:
                continue
            size_, form = _SIZES[kind] * count, f"{order}{count}{_CODES[kind]}"
            place = entry * (i + 1) - inline
            if size_ > inline:
                (far,) = struct.unpack_from(order + word, entries, place)
                out[tag] = list(struct.unpack(form, read(far, size_)))
            else:
                out[tag] = list(struct.unpack_from(form, entries, place))
        return order, out
    except struct.error:
        raise FormatError("the file ends early") from None


def _tags(raw: bytes) -> tuple[str, dict[int, list]]:
    return tags_at(held(raw))


def size_of(tags: dict[int, list]) -> tuple[int, int]:
    if LENGTH not in tags or WIDTH not in tags:
        raise FormatError("the image has no size")
    return tags[LENGTH][0], tags[WIDTH][0]


def size(raw: bytes) -> tuple[int, int]:
    """(rows, cols) from the header alone."""
    return size_of(_tags(raw)[1])


def unpackbits(raw: bytes) -> bytes:
    """A count byte n, then n + 1 bytes as they are, or one byte 1 - n times where n is negative."""
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += raw[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def unlzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends; widths grow one code early."""
    out, held, bits, width = [], 0, 0, 9
    table: list[bytes] = []
    last = b""
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code > len(table) or (code == len(table) and not last):
            raise FormatError("a strip is damaged")
        word = table[code] if code < len(table) else last + last[:1]
        out.append(word)
        if last and len(table) < 4096:
            table.append(last + word[:1])
            width = min(12, max(9, (len(table) + 1).bit_length()))
        last = word
    return b"".join(out)


_UNPACK = {PLAIN: bytes, LZW: unlzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpackbits}


def _checked(tags: dict[int, list], bits: int, form: int) -> Callable[[bytes], bytes]:
    """How to unpack a strip of an image of the supported kind."""
    if TILE_WIDTH in tags:
        raise FormatError("tiled images are not supported")
    if tags.get(SAMPLES, [1])[0] != 1 or tags.get(BITS, [1])[0] != bits or tags.get(FORMAT, [1])[0] != form:
        raise FormatError(f"only one channel of {bits}-bit samples of format {form} is supported")
    unpack = _UNPACK.get(tags.get(COMPRESSION, [PLAIN])[0])
    if unpack is None or tags.get(PREDICTOR, [1])[0] != 1:
        raise FormatError("the compression of the strips is not supported")
    return unpack


def _samples(read: Read, unpack: Callable[[bytes], bytes], strips: list[tuple[int, int]], need: int) -> bytes:
    try:
        body = b"".join(unpack(read(o, n)) for o, n in strips)
    except zlib.error as e:
        raise FormatError("a strip is damaged") from e
    if len(body) < need:
        raise FormatError("the file ends early")
    return body[:need]


def strips_of(tags: dict[int, list]) -> list[tuple[int, int]]:
    return list(zip(tags.get(OFFSETS, []), tags.get(BYTE_COUNTS, [])))


def _image(raw: bytes, bits: int, form: int, code: str) -> np.ndarray:
    order, tags = _tags(raw)
    rows, cols = size_of(tags)
    body = _samples(held(raw), _checked(tags, bits, form), strips_of(tags), rows * cols * bits // 8)
    return np.frombuffer(body, order + code).reshape(rows, cols)


def decode(raw: bytes) -> np.ndarray:
    """float32 surface of the first image."""
    return _image(raw, 32, 3, "f4").astype(np.float32)


def decode_mask(raw: bytes) -> np.ndarray:
    """uint8 mask of the first image."""
    return _image(raw, 8, 1, "u1")


def rows_per_strip(cols: int, size: int) -> int:
    return max(1, STRIP_BYTES // max(1, cols * size))


def head(rows: int, cols: int, is_float: bool) -> tuple[bytes, int, int]:
    """(header and directory, place of the strips, strips) of an image with plain strips of about 8 KB.

    After the directory come the strips' offsets and byte counts, unless there is one strip.
    Files that pass 4 GB are BigTIFF.
    """
    size = 4 if is_float else 1
    per = rows_per_strip(cols, size)
    n = -(-rows // per) if rows else 0
    big = 16 * n + rows * cols * size + 1024 >= 2**32
    word, entry, first = (8, 20, 16) if big else (4, 12, 8)
    after = first + (8 if big else 2) + entry * 11 + word
    data = after + (2 * n * word if n > 1 else 0)
    long = 16 if big else 4
    fields = [
        (WIDTH, 4, cols), (LENGTH, 4, rows), (BITS, 3, 8 * size), (COMPRESSION, 3, PLAIN), (PHOTOMETRIC, 3, 1), (OFFSETS, long, after if n > 1 else data),
        (SAMPLES, 3, 1), (ROWS_PER_STRIP, 4, per), (BYTE_COUNTS, long, after + n * word if n > 1 else rows * cols * size), (PLANAR, 3, 1), (FORMAT, 3, 3 if is_float else 1),
    ]
    out = struct.pack("<2sHHHQQ", b"II", 43, 8, 0, 16, len(fields)) if big else struct.pack("<2sHIH", b"II", 42, 8, len(fields))
    for tag, kind, value in fields:
        many = n if tag in (OFFSETS, BYTE_COUNTS) else 1
        code = ("Q" if kind == 16 or many > 1 else "H" if kind == 3 else "I") if big else ("H" if kind == 3 else "I")
        out += struct.pack("<HH" + ("Q" if big else "I"), tag, kind, many) + struct.pack("<" + code, value).ljust(word, b"\0")
    return out + bytes(word), data, n


def strip_words(rows: int, cols: int, is_float: bool, first: int, end: int) -> tuple[bytes, bytes]:
    """Offsets and byte counts of strips first to end, as they follow the directory."""
    size = 4 if is_float else 1
    per = rows_per_strip(cols, size)
    body, data, n = head(rows, cols, is_float)
    k = np.arange(first, min(end, n), dtype=np.int64)
    word = "<u8" if body[2] == 43 else "<u4"
    return (data + k * per * cols * size).astype(word).tobytes(), (np.minimum(per, rows - k * per) * cols * size).astype(word).tobytes()


def encode(image: np.ndarray) -> bytes:
    """float32 or uint8 image, black is smallest, strips of about 8 KB."""
    rows, cols = image.shape
    is_float = image.dtype != np.uint8
    start, _, n = head(rows, cols, is_float)
    words = strip_words(rows, cols, is_float, 0, n) if n > 1 else (b"", b"")
    return start + b"".join(words) + image.astype("<f4" if is_float else np.uint8).tobytes()


BAND_BYTES = 1 << 20
WORDS = 1 << 16  # strips whose offsets are one piece


def bands(images: DataFrame, pixels: DataFrame, value: str, size: int, run, schema: str) -> DataFrame:
    """``run`` for every band of rows of about a megabyte: (file, rows, cols, band, top, dense array) to a table.

    ``images``: file, image_id, rows, cols; ``pixels``: image_id, row, col and the value,
    whose absent pixels are 0.  A band holds whole strips.
    """
    row_bytes = F.greatest(F.lit(1), F.col("cols") * size).cast("bigint")
    per = F.greatest(F.lit(1), F.expr(f"{STRIP_BYTES} div greatest(1L, cast(cols as bigint) * {size})"))
    sized = images.withColumn("tall", per * F.greatest(F.lit(1), F.floor(F.lit(BAND_BYTES) / (per * row_bytes))))
    every = sized.filter("rows > 0 and cols > 0").withColumn("band", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rows") - 1) / F.col("tall")))))
    own = pixels.select("image_id", "row", "col", F.col(value).alias("v")).join(sized.select("image_id", "tall"), "image_id")
    # both sides may come from one frame: each gets columns of its own
    every = every.select(F.col("image_id").alias("of"), F.col("band").alias("nth"), *[F.col(c).alias(c) for c in ("file", "rows", "cols", "tall", "band")])
    own = own.select(F.col("image_id").alias("of"), F.floor(F.col("row") / F.col("tall")).alias("nth"), *[F.col(c).alias(c) for c in ("row", "col", "v")])

    def both(band: pa.Table, part: pa.Table) -> pa.Table:
        if not band.num_rows:  # pixels outside the image
            return empty
        b = band.to_pylist()[0]
        top = b["band"] * b["tall"]
        dense = np.zeros((min(b["tall"], b["rows"] - top), b["cols"]), np.float32 if size == 4 else np.uint8)
        row, col = part["row"].to_numpy(), part["col"].to_numpy()
        inside = (row - top < len(dense)) & (col >= 0) & (col < b["cols"])
        dense[row[inside] - top, col[inside]] = part["v"].to_numpy(zero_copy_only=False)[inside]
        return run(b["file"], b["rows"], b["cols"], b["band"], top, dense)

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return every.groupBy("of", "nth").cogroup(own.groupBy("of", "nth")).applyInArrow(both, schema)


def write(pixels: DataFrame, images: DataFrame, value: str = "v", mask: bool = False, by_parts: bool | None = None) -> None:
    """A TIFF for each row (file, image_id, rows, cols) of ``images``, written band by band by many tasks."""
    from . import sink

    size = 1 if mask else 4

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([f["file"]]), pa.array([head(f["rows"], f["cols"], not mask)[0]], pa.binary())], names=["file", "body"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                both = strip_words(f["rows"], f["cols"], not mask, f["k"] * WORDS, (f["k"] + 1) * WORDS)
                yield pa.RecordBatch.from_arrays([pa.array([f["file"]] * 2), pa.array([1, 2], pa.int32()), pa.array([f["k"]] * 2, pa.int64()), pa.array(both, pa.binary())], names=["file", "section", "no", "body"])

    def strip(file: str, rows: int, cols: int, band: int, top: int, dense: np.ndarray) -> pa.Table:
        return pa.table({"file": pa.array([file]), "no": pa.array([band], pa.int64()), "body": pa.array([dense.tobytes()], pa.binary())})

    strips = F.expr(f"(rows + greatest(1, {STRIP_BYTES} div greatest(1, cols * {size})) - 1) div greatest(1, {STRIP_BYTES} div greatest(1, cols * {size}))")
    files = images.select("file", "image_id", F.col("rows").cast("bigint").alias("rows"), F.col("cols").cast("bigint").alias("cols"))
    many = files.withColumn("n", strips).filter("n > 1").withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {WORDS}"))))
    parts = sink.pieces(files.mapInArrow(heads, "file string, body binary"), 0, F.col("body"))
    parts = parts.unionByName(many.select("file", "rows", "cols", "k").mapInArrow(words, sink.PIECE))
    done = bands(files, pixels, value, size, strip, "file string, no bigint, body binary")
    sink.write(parts.unionByName(sink.pieces(done, 3, F.col("body"), F.col("no"))), by_parts)


def write_images(pixels: DataFrame, dims: DataFrame, folder: str, value: str = "v", mask: bool = False) -> None:
    """A TIFF ``folder``/<image_id>.tif for each image of ``dims`` (image_id, rows, cols)."""
    path = F.concat(F.lit(folder.rstrip("/") + "/"), F.col("image_id"), F.lit(".tif"))
    write(pixels, dims.withColumn("file", path), value, mask)


def read(spark: SparkSession, path: str, extents: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Surfaces (image_id = file) of the TIFFs at ``path``; extents are top, left, height, width.

    Strips are planned from the headers, and of extents only what they touch is read; files
    on systems that tasks cannot open by range are read whole by Spark.
    """
    from . import planned

    files = ranges.listed(spark, path)
    if all(map(ranges.reachable, files)):
        out = planned.scan(spark, planned.TiffSource, files)
    else:
        out = surfaces_of(spark.read.format("binaryFile").load(path).select("path", "content"))
    return clipped(out, *extents) if extents else out


def packing_of(tags: dict[int, list], mask: bool = False) -> int:
    """How the strips of a float image (or mask) are packed; raises if it is not of the supported kind."""
    _checked(tags, *((8, 1) if mask else (32, 3)))
    return tags.get(COMPRESSION, [PLAIN])[0]


def unpacked(strip: bytes, packing: int) -> bytes:
    try:
        return _UNPACK[packing](strip)
    except zlib.error as e:
        raise FormatError("a strip is damaged") from e


def pixels_batch(name: str, top: int, part: np.ndarray, left: int = 0) -> pa.RecordBatch:
    rows, cols = part.shape
    columns = [
        pa.array([name] * part.size, pa.string()),
        pa.array(np.repeat(np.arange(top, top + rows, dtype=np.int32), cols)),
        pa.array(np.tile(np.arange(left, left + cols, dtype=np.int32), rows)),
        pa.array(part.ravel().astype(np.float64)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["image_id", "row", "col", "v"])


def surfaces_of(files: DataFrame) -> DataFrame:
    """Surfaces of (path, content) rows, in batches of about a million pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                image = decode(content)
                rows, cols = image.shape
                many = max(1, BATCH // max(1, cols))
                for top in range(0, rows, many):
                    yield pixels_batch(name, top, image[top : top + many])

    return files.mapInArrow(run, SCHEMA)


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, rows, cols) of the TIFFs at ``path``, from their headers."""
    files = ranges.listed(spark, path)
    if not all(map(ranges.reachable, files)):
        return sizes_of(spark.read.format("binaryFile").load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                with ranges.opened(name) as at:
                    rows, cols = size_of(tags_at(at)[1])
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int32()), pa.array([cols], pa.int32())], names=["image_id", "rows", "cols"])

    return spark.createDataFrame([(f,) for f in files], "path string").mapInArrow(run, "image_id string, rows int, cols int")


def sizes_of(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [size(c) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32())], names=["image_id", "rows", "cols"])

    return files.select("path", "content").mapInArrow(run, "image_id string, rows int, cols int")
