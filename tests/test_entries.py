import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.operators import classes, entries, raster
from crestline.sources import ridg

LINE = "image_id string, entry_id bigint, points array<struct<row_fx:int,col_fx:int,brightness:double,strength:double>>"
SEG = "image_id string, entry_id bigint, start struct<row_fx:int,col_fx:int,brightness:double,strength:double>, end struct<row_fx:int,col_fx:int,brightness:double,strength:double>"
POINT = "image_id string, entry_id bigint, row_fx int, col_fx int, brightness double, strength double"


def one_line(spark):
    return spark.createDataFrame([("im", 0, [(0, 0, 1.0, 0.0), (0, 128, 2.0, 0.0), (0, 256, 6.0, 3.0)])], LINE)


def test_line_attributes_and_cull(spark):
    x = one_line(spark)
    a = entries.attributes(x).first()
    assert (a.length, a.mean_brightness, a.mean_strength) == (2, 3.0, 1.0)
    assert entries.cull(x, 3).count() == 1 and entries.cull(x, 3.1).count() == 0 and entries.cull(x, None, 3).count() == 0
    assert entries.cull(x, 3, invert=True).count() == 0 and entries.cull(x, 3.1, invert=True).count() == 1
    assert entries.cull(x, 3.1, invert=True, compat=True).count() == 0
    assert tuple(entries.cull_counts(x, 3.1).first()) == (1, 1)


def test_point_and_segment_attributes(spark):
    p = spark.createDataFrame([("im", 0, 1, 2, 5.0, 7.0)], POINT)
    s = spark.createDataFrame([("im", 0, (0, 0, 1.0, 2.0), (0, 1, 3.0, 4.0))], SEG)
    assert entries.attributes(p).select("length", "mean_brightness", "mean_strength").first() == (0, 5.0, 7.0)
    assert entries.attributes(s).select("length", "mean_brightness", "mean_strength").first() == (1, 2.0, 3.0)


def test_access(spark):
    p = spark.createDataFrame([("im", i, i, i, 0.0, 0.0) for i in range(3)], POINT)
    assert entries.at_index(p, 1).count() == 1 and entries.at_index(p, 9).count() == 0 and entries.at_index(p, 1, "lines").count() == 0
    assert sorted(r.entry_id for r in entries.appended(p, p).collect()) == list(range(6))
    assert sorted(r.entry_id for r in entries.without(p, 1).collect()) == [0, 2]


def test_metadata(spark):
    m = spark.createDataFrame([({16: bytearray(b"\0\0\1\5"), 7: bytearray(b"x")},)], "m map<int,binary>")
    got = m.select(entries.metadata_uint32(F.col("m"), 16), entries.metadata_uint32(F.col("m"), 7), entries.metadata_uint32(F.col("m"), 99)).first()
    assert tuple(got) == (261, None, None)
    changed = m.select(entries.with_metadata(entries.with_metadata(F.col("m"), 7, None), 16, b"abcd")).first()[0]
    assert changed == {16: bytearray(b"abcd")}


def test_masks(spark):
    p = spark.createDataFrame([("im", 0, 130, 255, 0.0, 0.0)], POINT)
    assert [tuple(r)[1:] for r in raster.pixels(p).collect()] == [(1, 1)]
    s = spark.createDataFrame([("im", 0, (300, 200, 0.0, 0.0), (260, 256, 0.0, 0.0))], SEG)
    assert [tuple(r)[1:] for r in raster.pixels(s).collect()] == [(2, 1)]
    s = spark.createDataFrame([("im", 0, (256, 64, 0.0, 0.0), (192, 128, 0.0, 0.0))], SEG)
    assert [tuple(r)[1:] for r in raster.pixels(s).collect()] == [(1, 0)]
    assert [tuple(r)[1:] for r in raster.pixels(s, compat=True).collect()] == [(2, 0)]
    dims = spark.createDataFrame([("im", 2, 2)], "image_id string, rows int, cols int")
    assert {(r.row, r.col): r.m for r in raster.mask(raster.pixels(p), dims).collect()} == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 255}


def labelled(spark, xs):
    return spark.createDataFrame(list(enumerate(xs)), "entry_id bigint, class smallint")


def test_classes(spark):
    ref, data = labelled(spark, [0, 0, 1, 1]), labelled(spark, [0, 2, 0, 1])
    assert classes.summary(data).first().asDict() == {"a": 2, "b": 2, "n": 4, "a_percent": 50.0, "b_percent": 50.0}
    assert classes.difference(data, ref).first().asDict() == {"a_to_b": 1, "b_to_a": 1, "n": 4, "a_to_b_percent": 25.0, "b_to_a_percent": 25.0}
    a, b = classes.split(data)
    assert a.count() == b.count() == 2
    assert [r["class"] for r in classes.toggled(data, 1).orderBy("entry_id").collect()] == [0, 0, 0, 1]
    more = spark.range(6).select(F.col("id").alias("entry_id"))
    assert [r["class"] for r in classes.extended(more, data).orderBy("entry_id").collect()] == [0, 2, 0, 1, 0, 0]
    with pytest.raises(Exception, match="differ in size"):
        classes.difference(labelled(spark, [0]), ref).collect()
    with pytest.raises(Exception, match="no valid class"):
        classes.validated(labelled(spark, [0, None])).collect()


def test_dump_with_likelihood(spark):
    x = spark.createDataFrame([(0, 1, 0.5)], "entry_id bigint, class smallint, likelihood float")
    assert classes.dump(x, "class", "likelihood").first().line == "1\t5.000000e-01"


def test_pixel_index(spark):
    lines = [("im", 0, [(0, 64), (128, 64)]), ("im", 1, [(0, 70), (128, 70)])]
    ix = classes.pixel_index(spark.createDataFrame(lines, "image_id string, entry_id bigint, points array<struct<row_fx:bigint,col_fx:bigint>>"))
    assert [tuple(r) for r in ix.collect()] == [("im", 0, 0, 1)]
    assert classes.pick(ix, "im", 0.4, 0.3).first()[0] == 1 and classes.pick(ix, "im", 5, 5).count() == 0


def test_stream_of_containers(spark, tmp_path):
    from crestline.streaming.entries import container_stream, culled_stream

    data = ridg.Dataset("points", np.array([(1, 2, b, 0.0) for b in (1.0, 5.0)], ridg.POINT))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ridg").write_bytes(ridg.encode(data))
    s = culled_stream(container_stream(spark, str(tmp_path / "in"), "points"), 2.0)
    q = s.writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.brightness for r in spark.table("kept").collect()] == [5.0]
