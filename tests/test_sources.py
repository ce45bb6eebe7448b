import json
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan, StringContains

from crestline import cli
from crestline.operators import surface, tiles
from crestline.sources import files, masks, planned, ridg, text, tiff


def points(*rows):
    return np.array(list(rows), ridg.POINT)


def test_container_bytes():
    d = ridg.Dataset("points", points((256, 384, 1.0, 0.5)))
    d.set_uint32(ridg.ROWS, 5)
    d.set_uint32(ridg.COLS, 5)
    want = "52494447 00000001 00000000 00000001 00000100 00000180 3F800000 3F000000 00000002 00000010 00000004 00000005 00000011 00000004 00000005"
    assert ridg.encode(d) == bytes.fromhex(want)


numbers = st.tuples(st.integers(0, 2**31 - 1), st.integers(0, 2**31 - 1), st.floats(-9, 9, width=32), st.floats(-9, 9, width=32))


@settings(max_examples=40)
@given(st.lists(st.lists(numbers, min_size=2, max_size=5), max_size=5), st.dictionaries(st.integers(0, 200), st.binary(max_size=9), max_size=4))
def test_container_round_trip(lines, meta):
    d = ridg.decode(ridg.encode(ridg.Dataset("lines", [points(*x) for x in lines], meta)))
    assert [x.tolist() for x in d.entries] == [points(*x).tolist() for x in lines] and d.metadata == meta


@pytest.mark.parametrize("raw", [b"", b"RIDX" + bytes(12), b"RIDG" + struct.pack(">III", 0, 0, 0), b"RIDG" + struct.pack(">III", 1, 0, 0), b"RIDG" + struct.pack(">III", 1, 0, 2) + bytes(20)])
def test_bad_containers(raw):
    with pytest.raises(ridg.FormatError):
        ridg.decode(raw)


def test_class_sizes_are_checked():
    d = ridg.Dataset("points", points((1, 2, 0, 0)), {ridg.CLASSES: b"\1\0", ridg.LIKELIHOODS: b"\0"})
    with pytest.raises(ridg.FormatError):
        d.classes()
    with pytest.raises(ridg.FormatError):
        d.likelihoods()


@settings(max_examples=20)
@given(st.integers(1, 70), st.integers(1, 70))
def test_tiff_round_trip(rows, cols):
    a = np.random.default_rng(rows * 71 + cols).normal(size=(rows, cols)).astype(np.float32)
    raw = tiff.encode(a)
    assert tiff.size(raw) == (rows, cols) and (tiff.decode(raw) == a).all()


def test_tiff_refusals():
    with pytest.raises(tiff.FormatError):
        tiff.decode(tiff.encode(np.zeros((2, 2), np.uint8)))
    with pytest.raises(tiff.FormatError):
        tiff.decode(b"II*\0")
    with pytest.raises(tiff.FormatError):
        tiff.decode(b"not a tiff")


def retold(raw, code, pack, big=False):
    """The file with its strips packed otherwise, or as BigTIFF, written by hand."""
    order, tags = tiff._tags(raw)
    strips = [pack(raw[o : o + n]) for o, n in zip(tags[tiff.OFFSETS], tags[tiff.BYTE_COUNTS])]
    tags = {**tags, tiff.COMPRESSION: [code], tiff.BYTE_COUNTS: [len(x) for x in strips]}
    begin = 16 if big else 8
    tags[tiff.OFFSETS] = [begin + sum(map(len, strips[:i])) for i in range(len(strips))]
    body = b"".join(strips)
    word, fmt, kind = (8, "<HHQ", 16) if big else (4, "<HHI", 4)
    at = begin + len(body)
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at)
    out, far = struct.pack("<Q" if big else "<H", len(tags)), b""
    after = at + len(out) + len(tags) * (20 if big else 12) + word
    for tag in sorted(tags):
        packed = struct.pack(f"<{len(tags[tag])}{'Q' if big else 'I'}", *tags[tag])
        out += struct.pack(fmt, tag, kind, len(tags[tag]))
        if len(packed) > word:
            out += (after + len(far)).to_bytes(word, "little")
            far += packed
        else:
            out += packed.ljust(word, b"\0")
    return head + body + out + bytes(word) + far


def lzw(raw):
    """A plain LZW packer: 9 to 12 bits, high bits first, widths grow one code early."""
    bits, table, width, word = "", None, 9, b""
    put = lambda c: format(c, f"0{width}b")
    fresh = lambda: {bytes([i]): i for i in range(256)}
    table, n = fresh(), 258
    bits += put(256)
    for b in raw:
        if (longer := word + bytes([b])) in table:
            word = longer
            continue
        bits += put(table[word])
        table[longer] = n
        n += 1
        width = max(9, (n).bit_length()) if n < 4096 else 12
        if n >= 4094:
            bits += put(256)
            table, n, width = fresh(), 258, 9
        word = bytes([b])
    bits += put(table[word]) if word else ""
    width = max(width, min(12, (n + 1).bit_length()))
    bits += put(257)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def packbits(raw):
    return b"".join(bytes([len(raw[i : i + 128]) - 1]) + raw[i : i + 128] for i in range(0, len(raw), 128)) + b"\x80\x80"


@pytest.mark.parametrize("code, pack", [(1, bytes), (5, lzw), (8, zlib.compress), (32946, zlib.compress), (32773, packbits)])
@pytest.mark.parametrize("big", [False, True])
def test_packed_strips(code, pack, big):
    a = (np.random.default_rng(3).integers(0, 40, (90, 70)) / 8).astype(np.float32)
    raw = retold(tiff.encode(a), code, pack, big)
    assert tiff.size(raw) == (90, 70) and (tiff.decode(raw) == a).all()


@pytest.mark.parametrize("code, pack, big", [(1, bytes, False), (5, lzw, True), (8, zlib.compress, False)])
def test_tiffs_are_planned_by_strips(spark, tmp_path, monkeypatch, code, pack, big):
    a = np.random.default_rng(3).integers(0, 9, (200, 70)).astype(np.float32)
    (tmp_path / "a b%.tif").write_bytes(retold(tiff.encode(a), code, pack, big))
    (tmp_path / "small.tif").write_bytes(tiff.encode(a[:3]))
    for name, want in (("a b%.tif", a), ("small.tif", a[:3])):
        for options in ({}, {"batch": 500}):
            got = planned.tiffs(spark, str(tmp_path / name), **options).collect()
            assert len(got) == want.size and all(want[r.row, r.col] == r.v for r in got)
    found = {r.image_id.split("/")[-1]: (r.rows, r.cols) for r in tiff.sizes(spark, str(tmp_path)).collect()}
    assert found == {"a b%.tif": (200, 70), "small.tif": (3, 70)}
    both = tiff.read(spark, str(tmp_path))
    name = next(r.image_id for r in tiff.sizes(spark, str(tmp_path)).collect() if "small" not in r.image_id)
    some = both.filter((F.col("image_id") == name) & F.col("row").between(31, 60) & (F.col("col") >= 60) & (F.col("col") < 64) & (F.col("v") > 4))
    assert sorted((r.row, r.col, r.v) for r in some.collect()) == [(i, j, a[i, j]) for i in range(31, 61) for j in range(60, 64) if a[i, j] > 4]
    assert both.filter("row = 2 and image_id like '%small%'").count() == 70 and both.filter("row = 300").count() == 0
    cut = planned.tiffs(spark, str(tmp_path / "a b%.tif"), "tiles", side=32).filter("tr >= 2 and tr < 4 and tc = 1")
    assert sorted((r.tr, r.tc, r.top, r.left, r.height, r.width) for r in cut.collect()) == [(2, 1, 64, 32, 32, 32), (3, 1, 96, 32, 32, 32)]
    whole = tiles.to_pixels(planned.tiffs(spark, str(tmp_path / "a b%.tif"), "tiles", side=48)).collect()
    assert len(whole) == a.size and all(a[r.row, r.col] == r.v for r in whole)
    (tmp_path / "cut.tif").write_bytes((tmp_path / "a b%.tif").read_bytes()[:-9])
    with pytest.raises(Exception, match="ends early"):
        tiff.read(spark, str(tmp_path / "cut.tif")).collect()


def test_bytes_read_follow_the_window(tmp_path):
    a = np.arange(400 * 300, dtype=np.float32).reshape(400, 300)
    raw = tiff.encode(a)
    (tmp_path / "a.tif").write_bytes(raw)
    (tmp_path / "p.tif").write_bytes(retold(raw, 8, zlib.compress))

    def read(name, gap, form="pixels", **bounds):
        r = planned.TiffReader({"files": json.dumps([str(tmp_path / name)]), "form": form, "side": "64"})
        filters = [k for n, (lo, hi) in bounds.items() for k in (GreaterThanOrEqual((n,), lo), LessThan((n,), hi))]
        assert r.pushFilters(filters + [StringContains(("image_id",), "a")]) == [StringContains(("image_id",), "a")]
        parts = r.partitions()
        return sum(n for p in parts for _, n in p.ranges()), {(p.top + i, p.left + j): x for p in parts for (i, j), x in np.ndenumerate(p.pixels())}

    for gap, most in ((1 << 16, 20 * 300 * 4), (100, 20 * 5 * 4)):
        planned.GAP, kept = gap, planned.GAP
        try:
            n, got = read("a.tif", gap, row=(101, 121), col=(7, 12))
        finally:
            planned.GAP = kept
        assert n == most and got == {(i, j): a[i, j] for i in range(101, 121) for j in range(7, 12)}
    n, got = read("p.tif", 0, row=(101, 121), col=(7, 12))
    assert n < len(raw) / 10 and got == {(i, j): a[i, j] for i in range(101, 121) for j in range(7, 12)}
    n, got = read("a.tif", 0, "tiles", tr=(2, 3), tc=(4, 5))
    assert n == 64 * 300 * 4 and set(got) == {(i, j) for i in range(128, 192) for j in range(256, 300)}
    assert planned.TiffReader({"files": json.dumps([])}).partitions()[0].value is None


def test_packbits_runs_and_refusals():
    assert tiff.unpackbits(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA])) == bytes.fromhex("aaaaaa80002aaaaaaaaa")
    raw = tiff.encode(np.zeros((2, 2), np.float32))
    for bad in (retold(raw, 7, bytes), retold(raw, 8, bytes), retold(raw, 5, lambda x: b"\xff" * 9)):
        with pytest.raises(tiff.FormatError):
            tiff.decode(bad)


def test_tiff_scan(spark, tmp_path):
    a = np.arange(30, dtype=np.float32).reshape(5, 6)
    (tmp_path / "a.tif").write_bytes(tiff.encode(a))
    got = {(r.row, r.col): r.v for r in tiff.read(spark, str(tmp_path / "a.tif"), (1, 2, 2, 3)).collect()}
    assert got == {(i, j): a[i + 1, j + 2] for i in range(2) for j in range(3)}
    assert tuple(tiff.sizes(spark, str(tmp_path)).first())[1:] == (5, 6)
    image = tiff.read(spark, str(tmp_path / "a.tif")).withColumn("image_id", F.lit("again"))
    tiff.write_images(image, surface.size(image), str(tmp_path))
    assert (tmp_path / "again.tif").read_bytes() == tiff.encode(a)


def test_png():
    a = np.array([[0, 255], [255, 0], [0, 0]], np.uint8)
    raw = masks.png(a)
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", raw[16:24]) == (2, 3)
    assert unpng(raw).tolist() == a.tolist()


def unpng(raw):
    """Any unfiltered grey PNG, with its chunks' and its stream's checksums checked."""
    at, body, kinds = 8, b"", []
    while at < len(raw):
        (n,) = struct.unpack(">I", raw[at : at + 4])
        kind, told = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        assert struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + told)
        body += told if kind == b"IDAT" else b""
        kinds.append(kind)
        at += 12 + n
    assert kinds[0] == b"IHDR" and kinds[-1] == b"IEND"
    cols, rows = struct.unpack(">II", raw[16:24])
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(rows, cols + 1)
    assert not lines[:, 0].any()
    return lines[:, 1:]


def test_csv_rounds_half_to_even(spark):
    p = spark.createDataFrame([("im", 0, 8, 128, 1.5, 0.25)], "image_id string, entry_id bigint, row_fx int, col_fx int, brightness double, strength double")
    assert text.csv_lines(p).first().line == "0.062,1.000,1.500000e+00,2.500000e-01"


def test_formats():
    assert [files.format_of(x) for x in ("a.PNG", "b.tif", "c.TIFF", "d", "e.pdf", "f.csv", "g.xyz")] == ["png", "tiff", "tiff", "svg", "pdf", "csv", "svg"]
    assert files.format_of("a.svg", "csv") == "csv"


def test_commands(spark, tmp_path, capsys):
    grid = np.zeros((5, 5), np.float32)
    grid[:, 2] = 1
    t = lambda n: str(tmp_path / n)
    (tmp_path / "a.tif").write_bytes(tiff.encode(grid))
    run = lambda *a: cli.main(list(a), spark)
    assert run("detect", "-l", "-t", "0.125", "--dump-lp", t("lp.tif"), t("a.tif"), t("a.ridg")) == 0
    d = ridg.decode((tmp_path / "a.ridg").read_bytes())
    assert d.kind == "lines" and len(d.entries) == 1 and d.uint32(ridg.ROWS) == 5
    assert tiff.size((tmp_path / "lp.tif").read_bytes()) == (5, 5)
    for form in ("svg", "pdf", "csv", "png", "tif"):
        assert run("convert", t("a.ridg"), t(f"o.{form}")) == 0 and (tmp_path / f"o.{form}").stat().st_size > 0
    assert (tmp_path / "o.csv").read_text().splitlines()[-1] == "" and (tmp_path / "o.pdf").read_bytes().startswith(b"%PDF")
    assert (tmp_path / "o.svg").read_text().count("<path") == 1
    assert run("cull", "-l", "9", t("a.ridg"), t("none.ridg")) == 0 and "Culled 1 of 1" in capsys.readouterr().err
    assert run("classstat", t("a.ridg")) == 3
    d.metadata[ridg.CLASSES] = b"\1"
    (tmp_path / "c.ridg").write_bytes(ridg.encode(d))
    assert run("classstat", t("c.ridg"), t("c.ridg")) == 0 and "B\t1\t100.00%" in capsys.readouterr().out
    assert run("classexport", t("c.ridg"), t("x.ridg"), t("y.ridg")) == 0
    assert len(ridg.decode((tmp_path / "x.ridg").read_bytes()).entries) == 0 and len(ridg.decode((tmp_path / "y.ridg").read_bytes()).entries) == 1
    assert run("cull", t("missing"), t("z")) == 2 and run("detect", "-t", "1:0:2", t("a.tif")) == 1 and run("nonsense") == 1
    assert run("classstat", t("c.ridg"), t("none.ridg")) in (3, 4)


META = {0x10: b"\0\0\0\5", 0x11: b"\0\0\0\6", 0x77: b"kept as it is", 0x80: b"\0\1\2", 0x81: struct.pack(">3f", 0.5, -1.5, 2.25)}
BIG = 2**31 + 5


@pytest.mark.parametrize("kind", ["points", "segments", "lines"])
def test_files_keep_everything(spark, tmp_path, kind):
    """All metadata, classes of the entries left, coordinates over 2^31; and the old file until the new one is whole."""
    p = [points((BIG + i, 7 * i, 0.5 * i, 0.25)) for i in range(6)]
    body = {"points": np.concatenate(p[:3]), "segments": np.stack([np.concatenate(p[:2]), np.concatenate(p[2:4]), np.concatenate(p[4:])]), "lines": [np.concatenate(p[: 2 + i]) for i in range(3)]}[kind]
    raw = ridg.encode(ridg.Dataset(kind, body, META))
    path = tmp_path / "a.ridg"
    path.write_bytes(raw)
    got = files.load(spark, str(path))
    assert (got.rows, got.cols) == (5, 6) and 0x80 not in got.metadata
    files.save(got.entries, str(path), got.metadata)
    assert path.read_bytes() == raw and [x.name for x in tmp_path.iterdir()] == ["a.ridg"]
    files.save(got.entries.filter("entry_id <> 1"), str(path), got.metadata)
    d = ridg.decode(path.read_bytes())
    assert len(d.entries) == 2 and d.metadata[0x80] == b"\0\2" and d.metadata[0x81] == META[0x81][:4] + META[0x81][8:] and d.metadata[0x77] == META[0x77]
    assert int(np.asarray(d.entries[0]).ravel()[0]["row_fx"]) == BIG
    with pytest.raises(Exception):
        files.save(got.entries.withColumn("entry_id", got.entries["entry_id"] / 0), str(path), got.metadata)
    assert len(ridg.decode(path.read_bytes()).entries) == 2 and len(list(tmp_path.iterdir())) == 1
    files.save(got.entries.limit(0), str(path))
    assert len(ridg.decode(path.read_bytes()).entries) == 0


@pytest.mark.parametrize("kind", ["points", "segments", "lines"])
def test_containers_are_planned_in_parts(spark, tmp_path, kind):
    rng = np.random.default_rng(4)
    some = lambda n: points(*[(int(a), int(b), float(c), 0.5) for a, b, c in zip(rng.integers(0, 2**32, n), rng.integers(0, 99, n), range(n))])
    body = {"points": some(50), "segments": some(100).reshape(50, 2), "lines": [some(1 + i % 4 * 3) for i in range(50)]}[kind]
    meta = {0x10: b"\0\0\0\5", 0x81: struct.pack(">50f", *range(50)), 0x77: b"odd", 0x80: bytes(range(50))}
    raw = ridg.encode(ridg.Dataset(kind, body, meta))
    (tmp_path / "a b.ridg").write_bytes(raw)
    (tmp_path / "none.ridg").write_bytes(ridg.encode(ridg.Dataset(kind, body[:0])))
    files_ = spark.read.format("binaryFile").load(str(tmp_path))
    want = sorted(map(repr, ridg.entries_of(files_.select("path", "content"), kind, with_class=True).collect()))
    heads = sorted(map(repr, ridg.headers(files_.select("path", "content")).collect()))
    assert len(ridg.layout(ridg.ranges.held(raw), 100).parts) > 5
    for size in (100, 1 << 20):
        got = planned.containers(spark, str(tmp_path), kind, True, partBytes=size)
        assert sorted(map(repr, got.collect())) == want and len(want) == 50
        some = got.filter("entry_id >= 11 and entry_id < 23 and class > 12")
        assert sorted(r.entry_id for r in some.collect()) == list(range(13, 23)) and all(r["class"] == r.likelihood == r.entry_id for r in some.collect())
    assert sorted(map(repr, ridg.headers_at(spark, str(tmp_path)).collect())) == heads
    assert ridg.read(spark, str(tmp_path), kind).count() == 50 and ridg.read(spark, str(tmp_path), kind).filter("entry_id = 49").count() == 1
    r = planned.RidgReader({"files": json.dumps([str(tmp_path / "a b.ridg")]), "kind": kind, "partBytes": "100"})
    assert list(r.pushFilters([EqualTo(("entry_id",), 30)])) == []
    assert sum(p.n for p in r.partitions()) < 50 / 4 and len(r.partitions()) == 1
    for cut in (8, 20, len(raw) - 70, len(raw) - 1):
        with pytest.raises(ridg.FormatError, match="ends early"):
            ridg.layout(ridg.ranges.held(raw[:cut]))
    other = "lines" if kind != "lines" else "points"
    with pytest.raises(Exception, match=f"holds {kind}"):
        ridg.read(spark, str(tmp_path / "a b.ridg"), other).collect()
    (tmp_path / "a b.ridg").write_bytes(ridg.encode(ridg.Dataset(kind, body, {0x80: b"short"})))
    with pytest.raises(Exception, match="one byte per entry"):
        ridg.read(spark, str(tmp_path), kind, with_class=True).collect()


def test_sql_views(spark):
    from crestline.sql import register_ridges, register_tables

    register_tables(spark, "/root/testdata/sf0.001")
    register_ridges(spark, "/root/testdata/sf0.001", "li", 1 / 3)
    got = spark.sql("SELECT count(*) n, (SELECT count(*) FROM edges) e FROM points").first()
    assert got.n == got.e > 0 and spark.sql("SELECT count(*) FROM region").first()[0] == 5
    assert surface.SCHEMA
