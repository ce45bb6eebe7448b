"""Loading and saving entries by path: container files, and exports by suffix."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster
from ..operators.entries import kind_of
from . import masks, ridg, text

FORMATS = {"svg": "svg", "pdf": "pdf", "csv": "csv", "png": "png", "tif": "tiff", "tiff": "tiff"}


def format_of(path: str, form: str | None = None) -> str:
    """The format asked for, else by suffix without regard to case, else SVG."""
    if form:
        return FORMATS[form]
    return FORMATS.get(Path(path).suffix[1:].lower(), "svg")


@dataclass(frozen=True)
class Loaded:
    """One file: entries with class and likelihood, and all metadata that is not per entry."""

    entries: DataFrame
    metadata: dict[int, bytes]

    def uint32(self, key: int) -> int | None:
        raw = self.metadata.get(key)
        return int.from_bytes(raw, "big") if raw is not None and len(raw) == 4 else None

    @property
    def rows(self) -> int | None:
        return self.uint32(ridg.ROWS)

    @property
    def cols(self) -> int | None:
        return self.uint32(ridg.COLS)


def load(spark: SparkSession, path: str) -> Loaded:
    """The file at ``path``; only its header and metadata come to the driver."""
    head = ridg.headers_at(spark, path).first()
    return Loaded(ridg.read(spark, path, head["kind"], with_class=True), {k: bytes(v) for k, v in head["metadata"].items()})


def located(path: str) -> str:
    """A path with its scheme; one without names a file that the driver and its executors share."""
    return path if ":" in path.split("/", 1)[0] else "file:" + str(Path(path).absolute())


def save(entries: DataFrame, path: str, metadata: dict[int, bytes] | None = None) -> None:
    """One container file, encoded and written by many tasks; the target is the old file until the new one is whole.

    Classes and likelihoods follow the entries that are left.
    """
    target = located(path)
    told = {k: bytearray(v) for k, v in (metadata or {}).items()}
    one = entries.sparkSession.createDataFrame([(target, told)], "file string, metadata map<int,binary>")
    ridg.write(entries.withColumn("file", F.lit(target)), one)


def convert(entries: DataFrame, path: str, rows: int, cols: int, form: str | None = None, coloured: bool = False, selected: int | None = None) -> None:
    """Export one image's entries, formatted and written by many tasks; ``coloured`` SVG strokes show classes."""
    form, target = format_of(path, form), located(path)
    if form == "csv":
        text.write_lines(text.csv_lines(entries).orderBy("entry_id", "pos").select("line"), target)
    elif form == "svg":
        text.write_lines(text.svg_lines(text.class_elements(entries, selected=selected) if coloured else text.svg_elements(entries), rows, cols), target)
    elif form == "pdf":
        text.write_pdf(text.pdf_operators(entries, rows).orderBy("entry_id"), target, rows, cols)
    else:
        hit = raster.pixels(entries).select(F.lit("").alias("image_id"), "row", "col", F.lit(255).cast("smallint").alias("m")).distinct()
        one = entries.sparkSession.createDataFrame([(target, "", rows, cols)], "file string, image_id string, rows int, cols int")
        masks.write(hit, one, form)
