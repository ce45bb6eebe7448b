"""CSV lines, SVG pages and PDF pages of ridge entries, as ordered rows of text."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import to_subpixel
from ..operators.entries import kind_of
from . import sink

#: Class 0, any other class, the stroke under the selected line.
COLOURS = ("#0000ff", "#ff0000", "#00ff00")
RADIUS = 0.7978845608028654  # sqrt(2 / pi): a disc as large as a 1-pixel stroke's dot


def _pixels(fx: Column) -> Column:
    """%.3f of a position; halves of a thousandth go to even, as in C."""
    return F.format_string("%.3f", F.rint(fx * F.lit(1000.0) / F.lit(128.0)) / F.lit(1000.0))


def _e(v: Column) -> Column:
    return F.format_string("%e", v.cast("double"))


def csv_point(p: Column) -> Column:
    return F.concat_ws(",", _pixels(p["row_fx"]), _pixels(p["col_fx"]), _e(p["brightness"]), _e(p["strength"]))


def csv_lines(entries: DataFrame) -> DataFrame:
    """image_id, entry_id, pos, line: 4 fields a point, 8 a segment; a blank row ends each line."""
    kind = kind_of(entries)
    if kind == "points":
        p = F.struct("row_fx", "col_fx", "brightness", "strength")
        return entries.select("image_id", "entry_id", F.lit(0).alias("pos"), csv_point(p).alias("line"))
    if kind == "segments":
        return entries.select("image_id", "entry_id", F.lit(0).alias("pos"), F.concat_ws(",", csv_point(F.col("start")), csv_point(F.col("end"))).alias("line"))
    rows = F.array_append(F.transform("points", csv_point), F.lit(""))
    return entries.select("image_id", "entry_id", F.posexplode(rows).alias("pos", "line"))


def write_csv(entries: DataFrame, path: str) -> None:
    """Text files whose parts are in entry order."""
    csv_lines(entries).orderBy("image_id", "entry_id", "pos").select("line").write.mode("overwrite").text(path)


def _coordinate(fx: Column) -> Column:
    """Exact: 1/128 has seven decimals."""
    return F.regexp_replace(F.format_string("%.7f", to_subpixel(fx)), r"\.?0+$", "")


def _at(p: Column) -> Column:
    return F.concat_ws(" ", _coordinate(p["col_fx"]), _coordinate(p["row_fx"]))


def _stroke(path: Column, ink: Column, width: str) -> Column:
    return F.concat(F.lit('<path d="'), path, F.lit('" stroke="'), ink, F.lit(f'" stroke-width="{width}" stroke-linecap="round" fill="none"/>'))


def _path(kind: str) -> Column:
    if kind == "segments":
        return F.concat(F.lit("M "), _at(F.col("start")), F.lit(" L "), _at(F.col("end")))
    return F.concat(F.lit("M "), F.array_join(F.transform("points", _at), " L "))


def svg_elements(entries: DataFrame) -> DataFrame:
    """image_id, entry_id, element: a black disc per point, one stroke per segment or line."""
    kind = kind_of(entries)
    if kind == "points":
        shape = F.concat(F.lit('<circle cx="'), _coordinate(F.col("col_fx")), F.lit('" cy="'), _coordinate(F.col("row_fx")), F.lit(f'" r="{RADIUS:.6f}" fill="#000000"/>'))
    else:
        shape = _stroke(_path(kind), F.lit("#000000"), "1")
    return entries.select("image_id", "entry_id", shape.alias("element"))


def class_elements(entries: DataFrame, column: str = "class", selected: int | None = None) -> DataFrame:
    """image_id, entry_id, layer, element: lines or segments in the colour of their class, half a pixel wide.

    Under the selected entry lies a green stroke of width 1 (layer 0), whose own colour
    stays on top (layer 1).  Entries are painted in order, each with its layers.
    """
    path = _path(kind_of(entries))
    own = F.struct(F.lit(1).alias("layer"), _stroke(path, F.when(F.col(column) == 0, COLOURS[0]).otherwise(COLOURS[1]), "0.5").alias("element"))
    both = F.array(own)
    if selected is not None:
        under = F.struct(F.lit(0).alias("layer"), _stroke(path, F.lit(COLOURS[2]), "1").alias("element"))
        both = F.when(F.col("entry_id") == selected, F.array(under, own)).otherwise(both)
    return entries.select("image_id", "entry_id", F.inline(both))


def svg_page(rows: int, cols: int) -> tuple[str, str]:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{cols}" height="{rows}" viewBox="0 0 {cols} {rows}"><rect width="{cols}" height="{rows}" fill="#ffffff"/>'
    return head, "</svg>"


def svg_lines(elements: DataFrame, rows: int, cols: int) -> DataFrame:
    """``line`` rows of one image's page, in order, from (entry_id, element) and perhaps layers."""
    head, tail = svg_page(rows, cols)
    layer = F.col("layer") if "layer" in elements.columns else F.lit(0)
    body = elements.select(F.lit(1).alias("part"), "entry_id", layer.alias("layer"), F.col("element").alias("line"))
    ends = elements.sparkSession.createDataFrame([(0, -1, 0, head), (2, -1, 0, tail)], "part int, entry_id bigint, layer int, line string")
    return body.unionByName(ends).orderBy("part", "entry_id", "layer").select("line")


def pdf_operators(entries: DataFrame, rows: int) -> DataFrame:
    """image_id, entry_id, ops: PDF drawing operators; y grows upwards on a PDF page."""
    kind = kind_of(entries)

    def xy(p: Column) -> Column:
        return F.concat_ws(" ", _coordinate(p["col_fx"]), _coordinate(F.lit(rows * 128) - p["row_fx"]))

    if kind == "points":  # a stroke of no length with round caps is a disc of its width
        p = F.struct("row_fx", "col_fx")
        ops = F.concat(F.lit(f"{2 * RADIUS:.6f} w "), xy(p), F.lit(" m "), xy(p), F.lit(" l S"))
    elif kind == "segments":
        ops = F.concat(xy(F.col("start")), F.lit(" m "), xy(F.col("end")), F.lit(" l S"))
    else:
        first, rest = F.col("points")[0], F.slice("points", 2, F.size("points") - 1)
        ops = F.concat(xy(first), F.lit(" m "), F.array_join(F.transform(rest, lambda p: F.concat(xy(p), F.lit(" l"))), " "), F.lit(" S"))
    return entries.select("image_id", "entry_id", ops.alias("ops"))


def write_lines(lines: DataFrame, path: str) -> None:
    """One file of the ``line`` rows, in their order, from many tasks."""
    sink.write(sink.text_pieces(lines.select(F.lit(path).alias("file"), "line"), 0))


def write_pdf(operators: DataFrame, path: str, rows: int, cols: int) -> None:
    """A one-page PDF with the ``ops`` rows in order, black round strokes on white; the page's stream is packed in bands."""
    begin = f"1 1 1 rg 0 0 {cols} {rows} re f 0 0 0 RG 1 J 1 w".encode()
    first = operators.sparkSession.createDataFrame([(path, -1, bytearray(sink.deflated(begin)), zlib.adler32(begin), len(begin))], sink.BAND)
    with sink.banded(first.unionByName(sink.text_bands(operators.select(F.lit(path).alias("file"), F.col("ops").alias("line"))))) as (done, sums):
        _, adler, size = sums.first()
        start, end = _pdf_ends(size, adler, rows, cols)
        ends = operators.sparkSession.createDataFrame([(path, 0, 0, bytearray(start)), (path, 2, 0, bytearray(end))], sink.PIECE)
        sink.write(ends.unionByName(sink.pieces(done, 1, F.col("body"), F.col("no"))))


def _pdf_ends(size: int, adler: int, rows: int, cols: int) -> tuple[bytes, bytes]:
    """What stands before and after the bands of a page's stream, ``size`` bytes of them."""
    last = sink.deflate_tail(adler)
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {cols} {rows}] /Contents 4 0 R /Resources << >> >>".encode(),
    ]
    out, places = b"%PDF-1.4\n", []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
    places.append(len(out))
    out += b"4 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n" % (len(sink.DEFLATE_HEAD) + size + len(last)) + sink.DEFLATE_HEAD
    end = last + b"\nendstream\nendobj\n"
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out, end + table + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(places) + 1, len(out) + size + len(end))
