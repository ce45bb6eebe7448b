"""Data sources whose partitions come from headers: TIFFs, PNG masks and RIDG containers.

The planner reads headers only.  Conditions on rows, columns, tiles, entries and files are
pushed into the source and decide which byte ranges become partitions, so what is read
follows the window or the range of entries.  Every file is planned alike, whatever its size.

Plain strips are cut anywhere: a partition reads the rows of its window, and where more than
GAP bytes lie between two rows' parts of it, each part alone.  Packed strips are read whole
and belong to one partition; for tiles, a strip that is taller than a tile is unpacked once
for each row of tiles.  Entries of fixed size are found by arithmetic; lines by their lengths,
which the planner passes over in pieces of PASS bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..operators.surface import SCHEMA as PIXELS
from ..operators.tiles import SCHEMA as TILES
from . import masks, ranges, ridg, tiff

GAP = 1 << 16
BATCH = 1 << 20  # pixels of a partition
HEADERS_AT_ONCE = 32
_EVERYTHING = (0, 2**62)


class Pushed:
    """Ranges of integer columns and a set of files, gathered from filters."""

    def __init__(self, *columns: str):
        self.range = dict.fromkeys(columns, _EVERYTHING)
        self.files: set[str] | None = None

    def _narrowed(self, column: str, low: int = 0, high: int = 2**62) -> None:
        a, b = self.range[column]
        self.range[column] = max(a, low), min(b, high)

    def take(self, f: Filter) -> bool:
        """Whether the filter is now wholly seen to."""
        name, value = getattr(f, "attribute", ()), getattr(f, "value", None)
        column = name[0] if len(name) == 1 else None
        if column == "image_id" and isinstance(f, (EqualTo, In)):
            found = {value} if isinstance(f, EqualTo) else set(value)
            self.files = found if self.files is None else self.files & found
            return True
        if column not in self.range:
            return isinstance(f, IsNotNull) and column == "image_id"
        if isinstance(f, IsNotNull):
            return True
        if not isinstance(value, int):
            return False
        bounds = {EqualTo: (value, value + 1), EqualNullSafe: (value, value + 1), GreaterThan: (value + 1, 2**62), GreaterThanOrEqual: (value, 2**62), LessThan: (0, value), LessThanOrEqual: (0, value + 1)}
        if type(f) not in bounds:
            return False
        self._narrowed(column, *bounds[type(f)])
        return True


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], *columns: str):
        self.files, self.pushed = json.loads(options["files"]), Pushed(*columns)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.pushed.take(f)]

    def partitions(self) -> list[InputPartition]:
        wanted = [f for f in self.files if self.pushed.files is None or f in self.pushed.files]
        with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
            found = [p for parts in pool.map(self.of_file, wanted) for p in parts]
        return found or [InputPartition(None)]  # none at all is refused

    def of_file(self, path: str) -> list[InputPartition]:
        raise NotImplementedError


@dataclass
class Window(InputPartition):
    """Pixels [top, top + rows) x [left, left + width) of an image of ``cols`` columns; strips as (offset, bytes, first row, rows)."""

    path: str
    order: str
    packing: int
    cols: int
    top: int
    rows: int
    left: int
    width: int
    strips: list[tuple[int, int, int, int]]
    code: str = "f4"

    @property
    def size(self) -> int:
        return int(self.code[1])

    @property
    def apart(self) -> bool:
        return self.packing == tiff.PLAIN and self.size * (self.cols - self.width) > GAP

    def ranges(self) -> list[tuple[int, int]]:
        """The byte ranges that are read."""
        if self.packing != tiff.PLAIN:
            return [(at, n) for at, n, *_ in self.strips]
        out: list[tuple[int, int]] = []
        for at, _, first, many in self.strips:
            a, b = max(first, self.top), min(first + many, self.top + self.rows)
            if self.apart:
                out += [(at + self.size * ((r - first) * self.cols + self.left), self.size * self.width) for r in range(a, b)]
            else:
                out.append((at + self.size * (a - first) * self.cols, self.size * (b - a) * self.cols))
        joined: list[tuple[int, int]] = []
        for at, n in out:
            if joined and sum(joined[-1]) == at:
                joined[-1] = joined[-1][0], joined[-1][1] + n
            else:
                joined.append((at, n))
        return joined

    def pixels(self) -> np.ndarray:
        with ranges.opened(self.path) as read:
            body = b"".join(tiff.unpacked(read(at, n), self.packing) for at, n in self.ranges())
        cols = self.width if self.apart else self.cols
        first = self.top if self.packing == tiff.PLAIN else self.strips[0][2]
        need = self.size * cols * (self.top - first + self.rows)
        if len(body) < need:
            raise tiff.FormatError("the file ends early")
        whole = np.frombuffer(body[:need], self.order + self.code).astype(self.code).reshape(-1, cols)
        return whole[self.top - first :] if self.apart else whole[self.top - first :, self.left : self.left + self.width]


class TiffReader(_Reader):
    def __init__(self, options: dict[str, str]):
        self.form, self.side, self.batch = options.get("form", "pixels"), int(options.get("side", 256)), int(options.get("batch", BATCH))
        super().__init__(options, *(("tr", "tc") if self.form == "tiles" else ("row", "col")))

    def of_file(self, path: str) -> list[InputPartition]:
        with ranges.opened(path) as read:
            order, tags = tiff.tags_at(read)
        rows, cols = tiff.size_of(tags)
        packing = tiff.packing_of(tags, self.form == "mask")
        per, places = min(tags.get(tiff.ROWS_PER_STRIP, [rows])[0], rows), tiff.strips_of(tags)
        if len(places) * per < rows:
            raise tiff.FormatError("the file ends early")
        each = self.side if self.form == "tiles" else 1
        (r0, r1), (c0, c1) = ((a * each, min(b * each, end)) for (a, b), end in zip(self.pushed.range.values(), (rows, cols)))
        if r0 >= r1 or c0 >= c1:
            return []
        if self.form == "tiles":
            across = max(1, self.batch // (self.side * self.side)) * self.side
            cuts = [(t, min(t + self.side, r1), w, min(w + across, c1)) for t in range(r0 - r0 % self.side, r1, self.side) for w in range(c0, c1, across)]
        else:  # packed strips are not shared between partitions
            many = max(1, self.batch // max(1, cols if packing != tiff.PLAIN else c1 - c0))
            many = many if packing == tiff.PLAIN else max(1, many // per) * per
            cuts = [(max(t, r0), min(t + many, r1), c0, c1) for t in range(r0 - r0 % many if packing != tiff.PLAIN else r0, r1, many)]
        out = []
        for top, bottom, left, right in cuts:
            own = [(*places[k], k * per, min(per, rows - k * per)) for k in range(top // per, -(-bottom // per))]
            out.append(Window(path, order, packing, cols, top, bottom - top, left, right - left, own, "u1" if self.form == "mask" else "f4"))
        return out

    def read(self, p: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(p, Window):
            return
        part = p.pixels()
        if self.form == "pixels":
            yield tiff.pixels_batch(p.path, p.top, part, p.left)
            return
        if self.form == "mask":
            yield masks.set_pixels(p.path, p.top, part, p.left)
            return
        for at in range(0, p.width, self.side):
            tile = np.ascontiguousarray(part[:, at : at + self.side]).astype(np.float64)
            numbers = (p.top // self.side, (p.left + at) // self.side, p.top, p.left + at, *tile.shape)
            body = pa.ListArray.from_arrays(pa.array([0, tile.size], pa.int32()), pa.array(tile.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([p.path]), *(pa.array([n], pa.int32()) for n in numbers), body], names=["image_id", "tr", "tc", "top", "left", "height", "width", "v"])


@dataclass
class Part(InputPartition):
    """Entries [first, first + n) of a file, ``size`` bytes from ``at`` on; ``low`` to ``high`` are asked for."""

    path: str
    first: int
    n: int
    at: int
    size: int
    low: int
    high: int
    classes: int | None
    likelihoods: int | None


class RidgReader(_Reader):
    def __init__(self, options: dict[str, str]):
        self.kind, self.with_class, self.part_bytes = options["kind"], options.get("classes") == "true", int(options.get("partBytes", ridg.PART_BYTES))
        super().__init__(options, "entry_id")

    def of_file(self, path: str) -> list[InputPartition]:
        with ranges.opened(path) as read:
            found = ridg.layout(read, self.part_bytes, self.pushed.range["entry_id"])
        if found.kind != self.kind:
            raise ridg.FormatError(f"{path} holds {found.kind}, not {self.kind}")
        own = []
        for key, size, what, each in ((ridg.CLASSES, 1, "classification", "one byte"), (ridg.LIKELIHOODS, 4, "likelihoods", "four bytes")):
            begin, length = found.metadata.get(key, (None, None))
            if self.with_class and begin is not None and length != size * found.count:
                raise ridg.FormatError(f"the {what} do not have {each} per entry")
            own.append(begin)
        low, high = self.pushed.range["entry_id"]
        return [Part(path, *part, low, high, *own) for part in found.parts if part[0] < high and part[0] + part[1] > low]

    def read(self, p: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(p, Part):
            return
        with ranges.opened(p.path) as read:
            body = ridg.frame(self.kind, p.n) + ridg.exactly(read, p.at, p.size) + ridg.trailer({})
            out = ridg.batch_of(p.path, ridg.decode(body), p.first)
            if self.with_class:
                for name, begin, code, type_ in (("class", p.classes, "u1", pa.int16()), ("likelihood", p.likelihoods, ">f4", pa.float32())):
                    size = np.dtype(code).itemsize
                    got = np.frombuffer(ridg.exactly(read, begin + size * p.first, size * p.n), code) if begin is not None else None
                    out = out.append_column(name, pa.array(got.astype(type_.to_pandas_dtype()) if got is not None else [None] * p.n, type_))
        a, b = max(0, p.low - p.first), min(p.n, p.high - p.first)
        yield out.slice(a, max(0, b - a))


@dataclass
class Band(InputPartition):
    """A chunk of a PNG that holds whole lines packed on their own."""

    path: str
    top: int
    cols: int
    at: int
    size: int


class PngReader(_Reader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options, "row")

    def of_file(self, path: str) -> list[InputPartition]:
        with ranges.opened(path) as read:
            rows, cols, chunks = masks.chunks(read)
            if not chunks:
                return []
            tall = len(masks.lines(read(*chunks[0]), cols))
        low, high = self.pushed.range["row"]
        return [Band(path, i * tall, cols, at, size) for i, (at, size) in enumerate(chunks) if i * tall < high and (i + 1) * tall > low]

    def read(self, p: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(p, Band):
            return
        with ranges.opened(p.path) as read:
            part = masks.lines(read(p.at, p.size), p.cols)
        low, high = self.pushed.range["row"]
        a, b = max(0, low - p.top), max(0, min(len(part), high - p.top))
        yield masks.set_pixels(p.path, p.top + a, part[a:b])


class PngSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crestline_png"

    def schema(self) -> str:
        return masks.SET

    def reader(self, schema) -> DataSourceReader:
        return PngReader(dict(self.options))


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crestline_tiff"

    def schema(self) -> str:
        return {"tiles": TILES, "mask": masks.SET}.get(self.options.get("form", ""), PIXELS)

    def reader(self, schema) -> DataSourceReader:
        return TiffReader(dict(self.options))


class RidgSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crestline_ridg"

    def schema(self) -> str:
        return ridg.SCHEMAS[self.options["kind"]] + (", class smallint, likelihood float" if self.options.get("classes") == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return RidgReader(dict(self.options))


_known: set[str] = set()


def _register(spark: SparkSession) -> None:
    """Once per application: the sources, and the setting that lets filters into Python sources."""
    if spark.sparkContext.applicationId not in _known:
        _known.add(spark.sparkContext.applicationId)
        for source in (TiffSource, PngSource, RidgSource):
            spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def scan(spark: SparkSession, source: type[DataSource], files: list[str], **options: object) -> DataFrame:
    _register(spark)
    return spark.read.format(source.name()).options(files=json.dumps(files), **{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load()


def tiffs(spark: SparkSession, path: str, form: str = "pixels", **options: object) -> DataFrame:
    """The float TIFFs at ``path`` as pixels or tiles."""
    return scan(spark, TiffSource, ranges.listed(spark, path), form=form, **options)


def containers(spark: SparkSession, path: str, kind: str, classes: bool = False, **options: object) -> DataFrame:
    return scan(spark, RidgSource, ranges.listed(spark, path), kind=kind, classes=classes, **options)
