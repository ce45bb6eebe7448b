import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.operators.blocks import edges_by_blocks
from crestline.sources import editlog, pixelindex
from crestline.sources.editlog import EditLog
from crestline.streaming.bands import edges_stream

from .test_detection import image, same

INDEX = "image_id string, row int, col int, entry_id bigint"


def test_morton_codes(spark):
    pairs = [(0, 0), (1, 0), (0, 1), (3, 5), (2**31 - 1, 0), (123456, 2**31 - 1)]
    got = spark.createDataFrame(pairs, "r int, c int").select(pixelindex.morton(F.col("r"), F.col("c"))).collect()
    assert [x[0] for x in got] == [pixelindex.morton_of(*p) for p in pairs] and pixelindex.morton_of(3, 5) == 0b011011


def test_a_pick_reads_one_file(spark, tmp_path):
    rng = np.random.default_rng(2)
    pixels = {(im, int(r), int(c)): i for i, (im, r, c) in enumerate(zip(rng.choice(["a", "b"], 3000), rng.integers(0, 200, 3000), rng.integers(0, 90, 3000)))}
    path = str(tmp_path / "index")
    pixelindex.store(spark.createDataFrame([(*k, v) for k, v in pixels.items()], INDEX), path, 200)
    files = {p.name: p for p in (tmp_path / "index" / "pixels").iterdir() if p.is_dir()}
    assert len(files) > 10
    for rows, cols in (((10, 60), (5, 30)), ((-5, 1), (0, 90)), ((7, 7), (0, 9)), ((150, 999), (80, 999))):
        got = {tuple(r) for r in pixelindex.within(spark, path, "a", rows, cols).collect()}
        assert got == {(r, c, v) for (im, r, c), v in pixels.items() if im == "a" and rows[0] <= r < rows[1] and cols[0] <= c < cols[1]}
    (im, r, c), v = next(iter(pixels.items()))
    held = spark.read.parquet(f"{path}/pixels").filter((F.col("image_id") == im) & (F.col("row") == r) & (F.col("col") == c)).first()["part"]
    for name, folder in files.items():  # a pick needs its own file only
        if name != f"part={held}":
            shutil.rmtree(folder)
    assert [x[0] for x in pixelindex.pick(spark, path, im, c + 0.4, r - 0.4).collect()] == [v]
    assert pixelindex.pick(spark, path, "none", c, r).collect() == [] == pixelindex.pick(spark, path, im, -3, 2).collect()


def test_edits_equal_a_rewrite(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(editlog, "BLOCK", 32)
    model = {im: {i: (rng.randrange(3), f"{im}{i}") for i in range(n)} for im, n in (("a", 150), ("b", 7))}
    rows = lambda: [(im, i, c, x) for im, own in model.items() for i, (c, x) in own.items()]
    schema = "image_id string, entry_id bigint, class smallint, x string"
    log = EditLog.create(spark.createDataFrame(rows(), schema), str(tmp_path / "log"))
    assert sorted(map(tuple, log.read().collect())) == sorted(rows())
    for turn in range(3):
        steps = []
        for step in range(40):
            im, i = rng.choice("aab"), rng.randrange(200)
            op, value = rng.choice(["remove", "toggle", "toggle", "set"]), rng.randrange(3)
            steps.append((step, op, im, i, value if op == "set" else None))
            if i in model[im]:
                c, x = model[im][i]
                if op == "remove":
                    del model[im][i]
                else:
                    model[im][i] = (value if op == "set" else int(c == 0), x)
        log.edit(spark.createDataFrame(steps, "step int, op string, image_id string, entry_id int, class int"))
        if turn == 1:
            more = [("a", i, None, f"new{i}") for i in range(9)]
            log.append(spark.createDataFrame(more, schema))
            model["a"] |= {150 + i: (0, f"new{i}") for i in range(9)}
        assert sorted(map(tuple, log.read().select("image_id", "entry_id", "class", "x").collect())) == sorted(rows())
    want = {(im, i): k for im, own in model.items() for k, i in enumerate(sorted(own))}
    assert {(r.image_id, r.entry_id): r.place for r in log.placed().collect()} == want
    asked = spark.createDataFrame([("a", 0), ("a", 77), ("b", 2), ("b", 900), ("a", 77)], "image_id string, place int")
    at = {(im, k): i for (im, i), k in want.items()}
    assert sorted(map(tuple, log.at_places(asked).collect())) == sorted((im, k, at[im, k]) for im, k in [("a", 0), ("a", 77), ("b", 2), ("a", 77)] if (im, k) in at)
    small = log.compacted(str(tmp_path / "small"))
    assert sorted(map(tuple, small.read().select("image_id", "entry_id", "class", "x").collect())) == sorted((im, want[im, i], c, x) for im, i, c, x in rows())
    assert small.tombstones().count() == 0
    with pytest.raises(Exception, match="an edit is"):
        log.edit(spark.createDataFrame([(0, "paint", "a", 1)], "step int, op string, image_id string, entry_id int"))


@pytest.mark.parametrize("t, columns", [(0.0, 1024), (1.0, 9)])
def test_arriving_rows_give_the_edges_of_the_batch(spark, tmp_path, t, columns):
    rng = np.random.default_rng(6)
    grids = {"a": rng.normal(size=(41, 23)), "b": rng.normal(size=(6, 30)), "c": rng.normal(size=(1, 5))}
    grids["a"][3, 4], grids["a"][9, 9] = np.nan, np.inf
    batches = [[], [], [], []]
    for im, g in grids.items():
        for i, r in enumerate(g):
            batches[min(3, i // 12 + int(rng.integers(0, 2)))].append((im, i, len(g), [float(x) for x in r]))
    batches[3] += [("a", 2, 41, [9.0] * 23), ("a", 99, 41, [9.0] * 23), ("b", 5, 6, [9.0] * 30), ("a", 40, 41, [])]  # late, outside, repeated, empty
    batches[3].sort(key=lambda r: (r[3][:1] == [9.0], -r[1]))
    schema = "image_id string, row int, rows int, v array<double>"
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*"))
    out = edges_stream(stream, t, "A", 0.5, columns)
    run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    whole = spark.createDataFrame([], "image_id string, row int, col int, v double")
    for im, g in grids.items():
        whole = whole.unionByName(image(spark, g, im))
    want = edges_by_blocks(whole, t, "A", 0.5)
    same(spark.read.parquet(str(tmp_path / "out")), want, want.count())
    with pytest.raises(ValueError):
        edges_stream(stream, 2.0, columns=5)


def test_batches_of_the_stream_query_do_not_grow_with_small_files(spark, tmp_path):
    from pathlib import Path

    from crestline.plans import queries
    from crestline.plans.staging import shared_dir

    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=9)]) for i in range(4096)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    at = lambda: set(Path(shared_dir(spark).removeprefix("file:")).glob("*/rows-*"))
    before, tasks = at(), spark.conf.get("spark.sql.shuffle.partitions")
    got = queries.edge_crossings_stream(spark, str(tmp_path))
    want = queries.edge_crossings(spark, str(tmp_path))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and want.count() > 4096
    (place,) = at() - before
    batches = [p for p in (place / "state/commits").iterdir() if p.name.isdigit()]
    assert 2 <= len(batches) <= 4  # 8 where every 64 rows are a file
    assert spark.conf.get("spark.sql.shuffle.partitions") == tasks
