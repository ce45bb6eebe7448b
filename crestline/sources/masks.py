"""Mask files: 8-bit grey PNG and TIFF, one per image, written band by band by many tasks.

A PNG's lines are packed in bands that each end on a full flush, so a band is packed and
unpacked without the others: a chunk with the stream's two leading bytes, one chunk for
each band, one with the empty last block and the checksum, which is combined from the bands'.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges, sink, tiff
from .ranges import Read

SET = "image_id string, row int, col int, m smallint"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _start(rows: int, cols: int) -> bytes:
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", sink.DEFLATE_HEAD)


def _end(adler: int) -> bytes:
    return chunk(b"IDAT", sink.deflate_tail(adler)) + chunk(b"IEND", b"")


def _lines(image: np.ndarray) -> bytes:
    return np.hstack([np.zeros((len(image), 1), np.uint8), image.astype(np.uint8)]).tobytes()  # filter type 0 on every line


def png(image: np.ndarray) -> bytes:
    """8-bit grey PNG of a uint8 image, as one band."""
    told = _lines(image)
    return _start(*image.shape) + chunk(b"IDAT", sink.deflated(told)) + _end(zlib.adler32(told))


def write(mask: DataFrame, images: DataFrame, form: str, by_parts: bool | None = None) -> None:
    """A mask file for each row (file, image_id, rows, cols) of ``images``; form is "png" or "tiff".

    ``mask`` has (image_id, row, col, m), densely or set pixels only.
    """
    if form == "tiff":
        return tiff.write(mask, images, "m", mask=True, by_parts=by_parts)

    def band(file: str, rows: int, cols: int, no: int, top: int, dense: np.ndarray) -> pa.Table:
        told = _lines(dense)
        return pa.table({"file": [file], "no": pa.array([no], pa.int64()), "body": pa.array([chunk(b"IDAT", sink.deflated(told))], pa.binary()), "adler": pa.array([zlib.adler32(told)], pa.int64()), "n": pa.array([len(told)], pa.int64())})

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                both = [_start(f["rows"], f["cols"]), _end(f["adler"])]
                yield pa.RecordBatch.from_arrays([pa.array([f["file"]] * 2), pa.array([0, 2], pa.int32()), pa.array([0, 0], pa.int64()), pa.array(both, pa.binary())], names=["file", "section", "no", "body"])

    with sink.banded(tiff.bands(images, mask, "m", 1, band, sink.BAND)) as (done, sums):
        whole = images.select("file", "rows", "cols").join(sums, "file", "left").select("file", "rows", "cols", F.coalesce("adler", F.lit(1)).alias("adler"))
        sink.write(whole.mapInArrow(ends, sink.PIECE).unionByName(sink.pieces(done, 1, F.col("body"), F.col("no"))), by_parts)


def write_images(mask: DataFrame, dims: DataFrame, folder: str, form: str) -> None:
    """A mask ``folder``/<image_id>.<suffix> for each image of ``dims``."""
    path = F.concat(F.lit(folder.rstrip("/") + "/"), F.col("image_id"), F.lit({"png": ".png", "tiff": ".tif"}[form]))
    write(mask, dims.withColumn("file", path), form)


def chunks(read: Read) -> tuple[int, int, list[tuple[int, int]]]:
    """(rows, cols, place and size of each band) of a PNG written in bands."""
    start = read(0, 33)
    if start[:8] != _SIGNATURE or len(start) < 33:
        raise ValueError("not a PNG file")
    cols, rows, depth, colour = struct.unpack_from(">IIBB", start, 16)
    if (depth, colour) != (8, 0):
        raise ValueError("only grey masks of 8 bits are read")
    at, found = 33, []
    while len(head := read(at, 8)) == 8:
        (n,), kind = struct.unpack(">I", head[:4]), head[4:]
        if kind == b"IDAT":
            found.append((at + 8, n))
        at += 12 + n
    if len(found) < 2 or found[0][1] != len(sink.DEFLATE_HEAD):
        raise ValueError("only masks packed in bands are read")
    return rows, cols, found[1:-1]


def lines(band: bytes, cols: int) -> np.ndarray:
    """The uint8 lines of a band."""
    told = np.frombuffer(zlib.decompressobj(-15).decompress(band), np.uint8).reshape(-1, cols + 1)
    if told[:, 0].any():
        raise ValueError("only unfiltered masks are read")
    return told[:, 1:]


def set_pixels(name: str, top: int, image: np.ndarray, left: int = 0) -> pa.RecordBatch:
    row, col = np.nonzero(image)
    columns = [pa.array([name] * len(row), pa.string()), pa.array((row + top).astype(np.int32)), pa.array((col + left).astype(np.int32)), pa.array(image[row, col].astype(np.int16))]
    return pa.RecordBatch.from_arrays(columns, names=["image_id", "row", "col", "m"])


def read(spark: SparkSession, path: str, form: str) -> DataFrame:
    """Set pixels (image_id = file, row, col, m) of the masks at ``path``, band by band."""
    from . import planned

    files = ranges.listed(spark, path)
    return planned.scan(spark, planned.PngSource, files) if form == "png" else planned.scan(spark, planned.TiffSource, files, form="mask")
