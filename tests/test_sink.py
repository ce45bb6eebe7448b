import struct
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crestline.sources import files, masks, ridg, sink, text, tiff

from .test_sources import points, unpng


@given(st.lists(st.binary(max_size=9000), max_size=6))
def test_streams_join(parts):
    whole = b"".join(parts)
    adler = sink.joined_adler((zlib.adler32(p), len(p)) for p in parts)
    assert adler == zlib.adler32(whole)
    assert zlib.decompress(sink.DEFLATE_HEAD + b"".join(map(sink.deflated, parts)) + sink.deflate_tail(adler)) == whole


@pytest.mark.parametrize("by_parts", [None, True])
def test_pieces_become_files(spark, tmp_path, by_parts):
    names = [f"file:{tmp_path}/{n}" for n in ("a b", "c%d")]
    rows = [(names[k], s, no, bytearray(f"{k}.{s}.{no};".encode() * (no % 5))) for k in (0, 1) for s in (0, 1, 3) for no in [*range(0, 3000, 7), (1 << 33) + 1, (1 << 33) + 2]]
    (tmp_path / "a b").write_bytes(b"old" * 99999)
    sink.write(spark.createDataFrame(rows[::-1], sink.PIECE).repartition(5), by_parts)
    for k, name in enumerate(("a b", "c%d")):
        assert (tmp_path / name).read_bytes() == b"".join(bytes(r[3]) for r in rows if r[0] == names[k])
    assert sorted(x.name for x in tmp_path.iterdir()) == ["a b", "c%d"]


@pytest.mark.parametrize("by_parts", [None, True])
def test_a_failed_write_leaves_the_old_file(spark, tmp_path, by_parts):
    (tmp_path / "a").write_bytes(b"old")
    rows = [(f"file:{tmp_path}/a", 0, i, bytearray(b"new")) for i in range(4)] + [(f"file:{tmp_path}/a/below", 0, 0, bytearray(b"x"))]
    with pytest.raises(Exception):  # a file is no folder
        sink.write(spark.createDataFrame(rows, sink.PIECE), by_parts)
    assert (tmp_path / "a").read_bytes() == b"old" and len(list(tmp_path.iterdir())) == 1


@pytest.mark.parametrize("kind", ["points", "segments", "lines"])
@pytest.mark.parametrize("classed", [False, True])
def test_containers_from_many_tasks_equal_the_encoder(spark, tmp_path, monkeypatch, kind, classed):
    rng = np.random.default_rng(4)
    some = lambda n: points(*[(int(a), int(b), float(c), 0.5) for a, b, c in zip(rng.integers(0, 2**32, n), rng.integers(0, 99, n), range(n))])
    n = 301
    body = {"points": some(n), "segments": some(2 * n).reshape(n, 2), "lines": [some(1 + i % 4 * 3) for i in range(n)]}[kind]
    meta = {0x10: b"\0\0\0\5", 0x77: b"odd"}
    if classed:
        meta |= {0x80: bytes(i % 256 for i in range(n)), 0x81: np.arange(n).astype(">f4").tobytes()}
    raw = ridg.encode(ridg.Dataset(kind, body, meta))
    source = spark.createDataFrame([("x", bytearray(raw))], "path string, content binary")
    entries = ridg.entries_of(source, kind, with_class=True).repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        files.save(entries, str(tmp_path / "a.ridg"), {k: v for k, v in meta.items() if k < 0x80})
        both = entries.withColumn("image_id", F.concat(F.lit("i"), (F.col("entry_id") % 2).cast("string")))
        dims = spark.createDataFrame([("i0", 5, 6), ("i1", 7, 8), ("none", 1, 1)], "image_id string, rows int, cols int")
        ridg.write_images(both, dims, f"file:{tmp_path}/of images")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (tmp_path / "a.ridg").read_bytes() == raw
    for i in range(2):
        own = ridg.decode((tmp_path / "of images" / f"i{i}.ridg").read_bytes())
        assert [np.asarray(x).tolist() for x in own.entries] == [np.asarray(x).tolist() for x in body[i::2]]
        assert own.uint32(ridg.ROWS) == 5 + 2 * i and (own.metadata.get(0x80) == meta[0x80][i::2] if classed else 0x80 not in own.metadata)
    assert len(ridg.decode((tmp_path / "of images" / "none.ridg").read_bytes()).entries) == 0


@pytest.mark.parametrize("band", [300, 5000, 1 << 20])
def test_images_from_many_tasks_equal_the_encoder(spark, tmp_path, monkeypatch, band):
    monkeypatch.setattr(tiff, "BAND_BYTES", band)
    rng = np.random.default_rng(4)
    shapes = {"a": (200, 70), "b": (3, 4000), "c": (1, 1), "d": (90, 1)}
    image = {k: rng.normal(size=s).astype(np.float32) * (rng.random(s) < 0.2) + np.float32(0) for k, s in shapes.items()}
    rows = [(k, int(i), int(j), float(v)) for k, a in image.items() for (i, j), v in np.ndenumerate(a) if v]
    rows += [("a", 200, 3, 1.0), ("a", 3, 70, 1.0)]  # outside
    pixels = spark.createDataFrame(rows, "image_id string, row int, col int, v double")
    dims = spark.createDataFrame([(k, *s) for k, s in shapes.items()] + [("none", 7, 5)], "image_id string, rows int, cols int")
    tiff.write_images(pixels, dims, f"file:{tmp_path}/f")
    hit = pixels.filter("v > 0").select("image_id", "row", "col", F.lit(255).cast("smallint").alias("m"))
    for form in ("png", "tiff"):
        masks.write_images(hit, dims, f"file:{tmp_path}/{form}", form)
        got = {(r.image_id.split("/")[-1][0], r.row, r.col) for r in masks.read(spark, f"{tmp_path}/{form}", form).collect()}
        assert got == {(k, i, j) for k, i, j, v in rows[:-2] if v > 0}
    few = masks.read(spark, f"{tmp_path}/png", "png").filter("row >= 5 and row < 9")
    assert {r.row for r in few.collect()} <= {5, 6, 7, 8} and few.count() == len([r for r in rows[:-2] if 5 <= r[1] < 9 and r[3] > 0])
    for k, a in [*image.items(), ("none", np.zeros((7, 5), np.float32))]:
        assert (tmp_path / "f" / f"{k}.tif").read_bytes() == tiff.encode(a)
        want = np.where(a > 0, 255, 0).astype(np.uint8)
        assert (tmp_path / "tiff" / f"{k}.tif").read_bytes() == tiff.encode(want)
        assert (unpng((tmp_path / "png" / f"{k}.png").read_bytes()) == want).all()


def test_directory_past_four_gigabytes():
    rows, cols = 70_000, 20_000
    start, data, n = tiff.head(rows, cols, True)
    offsets, counts = tiff.strip_words(rows, cols, True, 0, n)
    order, tags = tiff.tags_at(ridg.ranges.held(start + offsets + counts))
    assert start[2] == 43 and tiff.size_of(tags) == (rows, cols) and n == rows
    places = tiff.strips_of(tags)
    assert len(start + offsets + counts) == data == places[0][0] and places[-1] == (data + 4 * cols * (rows - 1), 4 * cols)
    assert tiff.strip_words(rows, cols, True, 5, 9)[0] == offsets[40:72] and places[-1][0] > 2**32


def test_text_files(spark, tmp_path):
    pair = "struct<row_fx:bigint,col_fx:bigint,brightness:float,strength:float>"
    rows = [("im", i, (128 * i, 64, 1.0, 2.0), (128 * i + 128, 192, 1.5, 0.5), i % 2) for i in range(500)]
    segments = spark.createDataFrame(rows, f"image_id string, entry_id bigint, start {pair}, end {pair}, class int").repartition(5)
    out = lambda n: str(tmp_path / n)
    files.convert(segments, out("a.csv"), 502, 3)
    lines = (tmp_path / "a.csv").read_text().split("\n")
    assert len(lines) == 501 and lines[7] == "7.000,0.500,1.000000e+00,2.000000e+00,8.000,1.500,1.500000e+00,5.000000e-01" and lines[-1] == ""
    files.convert(segments, out("a.svg"), 502, 3, coloured=True, selected=4)
    drawn = [x for x in (tmp_path / "a.svg").read_text().split("\n") if x.startswith("<path")]
    assert len(drawn) == 501 and [x.split('stroke="')[1][:7] for x in drawn[3:7]] == ["#ff0000", "#00ff00", "#0000ff", "#ff0000"]
    assert 'stroke-width="1"' in drawn[4] and 'stroke-width="0.5"' in drawn[5] and drawn[4].split(" stroke=")[0] == drawn[5].split(" stroke=")[0]
    files.convert(segments, out("a.pdf"), 502, 3)
    raw = (tmp_path / "a.pdf").read_bytes()
    n, at = int(raw.split(b"/Length ")[1].split()[0]), raw.index(b"stream\n") + 7
    told = zlib.decompress(raw[at : at + n]).decode().split("\n")
    assert raw[at + n :].startswith(b"\nendstream") and len(told) == 501 and told[3] == "0.5 500 m 1.5 499 l S"
    table = int(raw.split(b"startxref\n")[1].split()[0])
    assert raw[table:].startswith(b"xref\n0 5\n") and all(raw[int(x[:10]) :].startswith(b"%d 0 obj" % i) for i, x in enumerate(raw[table:].split(b"\n")[3:7], 1))
    for form in ("png", "tif"):
        files.convert(segments, out(f"a.{form}"), 502, 3)
        assert masks.read(spark, out(f"a.{form}"), {"tif": "tiff"}.get(form, form)).count() == 500
    files.convert(segments.limit(0), out("none.png"), 4, 3)
    assert not unpng((tmp_path / "none.png").read_bytes()).any() and struct.calcsize("I") == 4
    assert text.class_elements(segments).count() == 500
