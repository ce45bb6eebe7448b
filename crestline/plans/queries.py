"""Registered queries over the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.algebra import eigen_literal, fine, millionths, to_fixed, to_subpixel
from ..functions.kernels import derivative, gaussian
from ..operators import blocks, classes, entries, raster, scalespace, stencil, surface, tiles
from ..operators.detect import EDGE_SCHEMA
from ..operators.detect import cells as cells_of
from ..sources import editlog, masks, pixelindex, planned, ridg, text, tiff
from ..sources.tables import RUNS, SURFACES, emb, evt, li
from ..streaming.bands import edges_stream
from . import oracle as O
from .detection import detection, detection_of_tiles
from .staging import folder, table
from .windowed import Windowed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
T = 1.0  # the scale of the registered detections
SPACE = [1.0, 0.34, 2.0, 1.01]
GRID = 'image_id, "row", col'


def query(sql: str | None = None, name: str | None = None):
    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register


def _u(*names: str) -> list[Column]:
    return [millionths(F.col(n)).alias(f"{n}_u") for n in names]


def _us(*names: str) -> str:
    return ", ".join(f"{O.millionths(n)} AS {n}_u" for n in names)


#: Strengths of vectors near 1 are tiny, those of counts and quantities large.
UNIT = {"emb": 1e15, "evt": 1e9, "li": 1e2}


def _f(*names: str, of: str = "emb") -> list[Column]:
    return [fine(F.col(n), UNIT[of]).alias(f"{n}_f") for n in names]


def _fs(*names: str, of: str = "emb") -> str:
    return ", ".join(f"{O.fine(n, UNIT[of])} AS {n}_f" for n in names)


# surfaces ------------------------------------------------------------------------------

for _name, _make in SURFACES.items():
    query(O.SURFACES[_name], f"surface_{_name}")(_make)


@query(f"""WITH raw AS ({O.SURFACES["emb"]}) SELECT image_id, CAST("row" - 3 AS INTEGER) AS "row", CAST(col - 5 AS INTEGER) AS col,
CASE WHEN v < -1 THEN 0.25 ELSE v END AS v FROM raw WHERE "row" >= 3 AND "row" < 43 AND col >= 5 AND col < 35""")
def clip_fill(spark, sf_dir):
    """The half-open window; values under -1 stand for missing pixels (NaN) and are filled."""
    holes = emb(spark, sf_dir).withColumn("v", F.when(F.col("v") < -1, F.lit(float("nan"))).otherwise(F.col("v")))
    return surface.filled(surface.clipped(holes, 3, 5, 40, 30), 0.25)


@query(f'WITH raw AS ({O.SURFACES["evt"]}) SELECT image_id, col AS "row", "row" AS col, v FROM raw')
def surface_transpose(spark, sf_dir):
    return surface.transposed(evt(spark, sf_dir))


@query(" UNION ALL ".join(f'SELECT image_id, CAST(max("row") + 1 AS INTEGER) AS "rows", CAST(max(col) + 1 AS INTEGER) AS cols FROM ({s}) GROUP BY image_id' for s in O.SURFACES.values()))
def surface_size(spark, sf_dir):
    return surface.size(emb(spark, sf_dir).unionByName(evt(spark, sf_dir)).unionByName(li(spark, sf_dir)))


# stencils ------------------------------------------------------------------------------


@query(f"WITH raw AS ({O.SURFACES['emb']}), {O.smoothing('raw', 'sm', T)} SELECT {GRID}, {_us('v')} FROM sm")
def smooth_gauss(spark, sf_dir):
    return blocks.smoothed(emb(spark, sf_dir), T).select("image_id", "row", "col", *_u("v"))


@query(f"WITH raw AS ({O.SURFACES['emb']}), {O.smoothing('raw', 'sm', T)}, {O.derivative_ctes('sm', 'dv')} SELECT {GRID}, {_us('dx', 'dy', 'dxx', 'dyy', 'dxy')} FROM dv")
def derivatives(spark, sf_dir):
    return blocks.derivatives(emb(spark, sf_dir), T).select("image_id", "row", "col", *_u("dx", "dy", "dxx", "dyy", "dxy"))


def _metrics(metric: str) -> None:
    sql = f"""WITH raw AS ({O.SURFACES["emb"]}), {O.smoothing("raw", "sm", T)}, {O.derivative_ctes("sm", "dv")}, {O.metric_ctes("dv", "me", metric, O.number(T))}
SELECT {GRID}, {_us("l1", "l2", "lp", "lpp")}, {_fs("r")} FROM me"""

    @query(sql, f"eigen_metrics_{metric.lower()}")
    def run(spark, sf_dir):
        return blocks.metrics_by_blocks(emb(spark, sf_dir), T, metric).select("image_id", "row", "col", *_u("l1", "l2", "lp", "lpp"), *_f("r"))


for _m in "NMA":
    _metrics(_m)


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.staged(tiles.from_runs(RUNS["emb"](spark, sf_dir)))


@query(f"WITH raw AS ({O.SURFACES['emb']}), {O.smoothing('raw', 'sm', T)} SELECT {GRID}, {_us('v')} FROM sm")
def smooth_tiles(spark, sf_dir):
    return tiles.to_pixels(tiles.filtered(_tiles(spark, sf_dir), gaussian(T))).select("image_id", "row", "col", *_u("v"))


@query(f"WITH raw AS ({O.SURFACES['emb']}), {O.smoothing('raw', 'sm', T)}, {O.derivative_ctes('sm', 'dv')} SELECT {GRID}, {_us('dx', 'dy', 'dxx', 'dyy', 'dxy')} FROM dv")
def derivatives_tiles(spark, sf_dir):
    """Smoothed tiles are tiles again, whose derivatives need another exchange of strips."""
    smooth = tiles.staged(tiles.filtered(_tiles(spark, sf_dir), gaussian(T)))
    return tiles.to_pixels(tiles.derivatives(smooth), "dx", "dy", "dxx", "dyy", "dxy").select("image_id", "row", "col", *_u("dx", "dy", "dxx", "dyy", "dxy"))


@query(f"""WITH raw AS ({O.SURFACES["emb"]}), {O.smoothing("raw", "sm", T)}, {O.derivative_ctes("sm", "dv")}, {O.metric_ctes("dv", "me", "N", O.number(T))}
SELECT {GRID}, {_us("l1", "l2", "lp", "lpp")}, {_fs("r")} FROM me""")
def eigen_metrics_tiles(spark, sf_dir):
    planes = ("l1", "l2", "lp", "lpp", "r")
    return tiles.to_pixels(tiles.metrics(_tiles(spark, sf_dir), T), *planes).select("image_id", "row", "col", *_u("l1", "l2", "lp", "lpp"), *_f("r"))


@query(f"WITH raw AS ({O.SURFACES['emb']}), {O.smoothing('raw', 'sm', T)}, {O.derivative_ctes('sm', 'dv')} SELECT {GRID}, {_us('dx', 'dy', 'dxx', 'dyy', 'dxy')} FROM dv")
def derivatives_windows(spark, sf_dir):
    """The window plan, which the block plan is held against."""
    return stencil.derivatives(stencil.smoothed(emb(spark, sf_dir), T)).select("image_id", "row", "col", *_u("dx", "dy", "dxx", "dyy", "dxy"))


def _literal_sql() -> str:
    f = lambda x: f"CAST({x} AS FLOAT)"
    zero, half, one = (f"{x}::FLOAT" for x in ("0", "0.5", "1"))
    steps = [
        f"i AS (SELECT {GRID}, {f('dyy')} AS a, {f('dxy')} AS b0, {f('dxx')} AS d FROM dv)",
        f"j AS (SELECT *, CASE WHEN abs(b0) < {f('pow(2, -23)')} * (abs(a) + abs(d)) THEN {zero} ELSE b0 END AS b, (a - d) * {half} AS half FROM i)",
        f"k AS (SELECT *, {f('sqrt(half::DOUBLE * half::DOUBLE + b::DOUBLE * b::DOUBLE)')} AS h FROM j)",
        "l AS (SELECT *, CASE WHEN half < 0 THEN half + h ELSE h - half END AS gap FROM k)",
        f"m AS (SELECT *, b * (CASE WHEN gap = 0 THEN CAST(sign(b) AS FLOAT) * CAST('inf' AS FLOAT) ELSE {f('b / gap')} END) AS part FROM l)",
        "n AS (SELECT *, CASE WHEN half = 0 THEN d - abs(b) WHEN half < 0 THEN d - part ELSE d + part END AS mu0 FROM m)",
        f"o AS (SELECT *, a - CASE WHEN {f('pow(2, -23)')} * abs(mu0) > abs(a) + abs(b) THEN {zero} ELSE mu0 END AS x FROM n)",
        "p AS (SELECT *, abs(b) > abs(x) AS steep FROM o)",
        f"q AS (SELECT *, CASE WHEN b = 0 THEN NULL WHEN steep THEN {f('-x / b')} ELSE {f('-b / x')} END AS q FROM p)",
        f"r AS (SELECT *, {f(f'{one} / ' + f(f'sqrt({one} + q * q)'))} AS r FROM q)",
        f"s AS (SELECT *, CASE WHEN b = 0 THEN {one} WHEN steep THEN r * q ELSE r END AS c, CASE WHEN b = 0 THEN {zero} WHEN steep THEN r ELSE r * q END AS s FROM r)",
        "t AS (SELECT *, CASE WHEN b = 0 THEN a ELSE (c * a - s * b) * c - (c * b - s * d) * s END AS l1, CASE WHEN b = 0 THEN d ELSE (s * a + c * b) * s + (s * b + c * d) * c END AS l2 FROM s)",
    ]
    return ",\n".join(steps)


@query(f"""WITH raw AS ({O.SURFACES["emb"]}), {O.smoothing("raw", "sm", T)}, {O.derivative_ctes("sm", "dv")}, {_literal_sql()}
SELECT {GRID}, {_us("l1", "l2", "c", "s")} FROM t""")
def eigen_compat(spark, sf_dir):
    """The eigen shift as it stands in single precision, rounded after each step."""
    d = blocks.derivatives(emb(spark, sf_dir), T).withColumn("e", eigen_literal(F.col("dyy"), F.col("dxy"), F.col("dxx")))
    return d.select("image_id", "row", "col", F.col("e.l1").cast("double").alias("l1"), F.col("e.l2").cast("double").alias("l2"), F.col("e.e11").cast("double").alias("c"), F.col("e.e21").cast("double").alias("s")).select(
        "image_id", "row", "col", *_u("l1", "l2", "c", "s")
    )


# detection -----------------------------------------------------------------------------


@query(O.ridges("emb", T, f'SELECT image_id, "row", col, dir, d, {_us("brightness")}, {_fs("strength")} FROM edges'))
def edge_crossings(spark, sf_dir):
    return detection(emb(spark, sf_dir), T).edges.select("image_id", "row", "col", "dir", "d", *_u("brightness"), *_f("strength"))


@query(O.ridges("emb", T, f'SELECT image_id, "row", col, dir, d, {_us("brightness")}, {_fs("strength")} FROM edges', metric="A"))
def edge_crossings_windows(spark, sf_dir):
    """The window plan of the image stage, with metric A."""
    return detection(emb(spark, sf_dir), T, "A", plan="windows").edges.select("image_id", "row", "col", "dir", "d", *_u("brightness"), *_f("strength"))


@query(O.ridges("emb", T, f'SELECT image_id, "row", col, dir, d, {_us("brightness")}, {_fs("strength")} FROM edges'))
def edge_crossings_tiles(spark, sf_dir):
    """From table rows to tiles, which exchange halo strips only."""
    found = detection_of_tiles(_tiles(spark, sf_dir), T)
    return found.edges.select("image_id", "row", "col", "dir", "d", *_u("brightness"), *_f("strength"))


@query(O.ridges("emb", T, f'SELECT image_id, "row", col, dir, d, {_us("brightness")}, {_fs("strength")} FROM edges'))
def edge_crossings_stream(spark, sf_dir):
    """Rows of the image arrive in files in their order, some at a time; the stream gives the edges of the batch.

    A file has 64 rows or a 32nd of the image, up to 2048: a batch of 8 files holds 16384 rows at most,
    and there is a batch for so many rows.  State is dealt to as many tasks as the stretches need.
    """
    place, runs, columns = folder(spark, "rows"), RUNS["emb"](spark, sf_dir), 32
    count, width = runs.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    per = min(2048, max(64, -(-count // 32)))
    sized = runs.select("image_id", "row", F.lit(count).alias("rows"), "v", F.expr(f"row div {per}").alias("part"))
    sized.repartitionByRange(max(1, -(-count // per)), "part").sortWithinPartitions("part").write.partitionBy("part").parquet(f"{place}/in")
    rows = spark.readStream.schema("image_id string, row int, rows bigint, v array<double>").option("maxFilesPerTrigger", 8).parquet(f"{place}/in")
    edges = edges_stream(rows, T, columns=columns).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(tasks), max(1, -(-width // columns) * 4))))
    try:
        run = edges.start()  # in a session of its own from here on
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
    run.awaitTermination()
    found = spark.read.schema(EDGE_SCHEMA).parquet(f"{place}/out")
    return found.select("image_id", "row", "col", "dir", "d", *_u("brightness"), *_f("strength"))


@query(O.ridges("emb", T, f'SELECT image_id, "row", col, dir, d, {_us("brightness")}, {_fs("strength")} FROM edges WHERE "row" BETWEEN 90 AND 109 AND col BETWEEN 20 AND 39'))
def edge_crossings_window(spark, sf_dir):
    """Edges inside a window; the scan reads the window widened by what the passes reach."""
    found = Windowed(partial(emb, spark, sf_dir)).edges(T).where((90, 110), (20, 40)).df()
    return found.select("image_id", "row", "col", "dir", "d", *_u("brightness"), *_f("strength"))


@query(O.ridges("emb", T, 'SELECT image_id, "row", col, flags, north, west FROM cells', O.SIDES, O.CELLS))
def ridge_cells(spark, sf_dir):
    d = detection(emb(spark, sf_dir), T)
    return cells_of(d.edges, d.dims)


def _points(surface_name: str, t: float) -> None:
    sql = O.ridges(surface_name, t, f"SELECT image_id, entry_id, row_fx, col_fx, {_us('brightness')}, {_fs('strength', of=surface_name)} FROM points", O.POINTS)

    @query(sql, "ridge_points" if surface_name == "emb" else f"ridge_points_{surface_name}")
    def run(spark, sf_dir):
        return detection(SURFACES[surface_name](spark, sf_dir), t).points().select("image_id", "entry_id", "row_fx", "col_fx", *_u("brightness"), *_f("strength", of=surface_name))


for _name, _t in (("emb", T), ("evt", 2 / 3), ("li", 1 / 3)):
    _points(_name, _t)


def _flat(d: DataFrame) -> DataFrame:
    p = lambda e, f, n: F.col(f"{e}.{f}").alias(n)
    return d.select("image_id", "entry_id", p("start", "row_fx", "r1"), p("start", "col_fx", "c1"), p("end", "row_fx", "r2"), p("end", "col_fx", "c2"), *[fine(F.col(f"{e}.strength")).alias(f"{n}_f") for e, n in (("start", "s1"), ("end", "s2"))])


@query(O.ridges("emb", T, f"SELECT image_id, entry_id, r1, c1, r2, c2, {_fs('s1', 's2')} FROM segments", O.SIDES, O.SEGMENTS))
def ridge_segments(spark, sf_dir):
    return _flat(detection(emb(spark, sf_dir), T).segments())


def _exploded(lines: DataFrame) -> DataFrame:
    out = lines.select("image_id", "entry_id", F.posexplode("points").alias("pos", "p"))
    return out.select("image_id", "entry_id", F.col("pos").cast("bigint").alias("pos"), "p.row_fx", "p.col_fx", "p.brightness", "p.strength")


def _lines(name: str, t: float) -> None:
    sql = O.ridges(name, t, f"SELECT '{name}' AS image_id, entry_id, pos, row_fx, col_fx, {_us('brightness')}, {_fs('strength', of=name)} FROM lines", O.SIDES, O.SEGMENTS, O.LINES)

    @query(sql, "ridge_lines" if name == "emb" else f"ridge_lines_{name}")
    def run(spark, sf_dir):
        return _exploded(detection(SURFACES[name](spark, sf_dir), t).lines()).select("image_id", "entry_id", "pos", "row_fx", "col_fx", *_u("brightness"), *_f("strength", of=name))


for _name, _t in (("emb", T), ("li", 1 / 3)):
    _lines(_name, _t)


@query(O.ridges("emb", T, "SELECT 'emb' AS image_id, entry_id, count(*) AS n_points, min(row_fx) AS top FROM lines GROUP BY entry_id", O.SIDES, O.SEGMENTS, O.LINES))
def line_components(spark, sf_dir):
    """Lines as components, with their size."""
    lines = detection(emb(spark, sf_dir), T).lines()
    return lines.select("image_id", "entry_id", F.size("points").cast("bigint").alias("n_points"), F.array_min(F.transform("points", lambda p: p["row_fx"])).alias("top"))


# culling -------------------------------------------------------------------------------
B, S, L = 0.02, 1e-7, 4.0
_LINE_ATTR = "line_attr AS (SELECT entry_id, count(*) - 1 AS length, list_reduce(list_prepend(0.0::DOUBLE, list(brightness ORDER BY pos)), lambda a, b: a + b) / count(*) AS mb, list_reduce(list_prepend(0.0::DOUBLE, list(strength ORDER BY pos)), lambda a, b: a + b) / count(*) AS ms FROM lines GROUP BY entry_id)"


@query(O.ridges("emb", T, f"SELECT image_id, entry_id, row_fx, col_fx FROM points WHERE NOT (brightness < {B} OR strength < {S})", O.POINTS))
def cull_points(spark, sf_dir):
    return entries.cull(detection(emb(spark, sf_dir), T).points(), B, None, S).select("image_id", "entry_id", "row_fx", "col_fx")


@query(O.ridges("emb", T, f"SELECT image_id, entry_id, r1, c1, r2, c2, {_fs('s1', 's2')} FROM segments WHERE NOT (1 < 1 OR (b1 + b2) / 2.0::DOUBLE < {B} OR (s1 + s2) / 2.0::DOUBLE < {S})", O.SIDES, O.SEGMENTS))
def cull_segments(spark, sf_dir):
    return _flat(entries.cull(detection(emb(spark, sf_dir), T).segments(), B, 1, S))


@query(O.ridges("emb", T, f"SELECT 'emb' AS image_id, entry_id, CAST(length AS INTEGER) AS length, {O.millionths('mb')} AS mean_brightness_u FROM line_attr WHERE NOT (length < {L} OR mb < {B} OR ms < {S})", O.SIDES, O.SEGMENTS, O.LINES, _LINE_ATTR))
def cull_lines(spark, sf_dir):
    kept = entries.cull(detection(emb(spark, sf_dir), T).lines(), B, L, S)
    return entries.attributes(kept).select("image_id", "entry_id", "length", *_u("mean_brightness"))


@query(O.ridges("emb", T, f"SELECT image_id, entry_id, row_fx, col_fx FROM points WHERE NOT (brightness >= {B} OR strength >= {S})", O.POINTS))
def cull_inverted(spark, sf_dir):
    return entries.cull(detection(emb(spark, sf_dir), T).points(), B, None, S, invert=True).select("image_id", "entry_id", "row_fx", "col_fx")


@query(O.ridges("emb", T, f"SELECT count(*) FILTER (WHERE length < {L} OR mb < {B}) AS culled, count(*) AS total FROM line_attr", O.SIDES, O.SEGMENTS, O.LINES, _LINE_ATTR))
def cull_counts(spark, sf_dir):
    return entries.cull_counts(detection(emb(spark, sf_dir), T).lines(), B, L)


@query(O.ridges("emb", T, "SELECT image_id, entry_id, row_fx, col_fx FROM points WHERE entry_id = 17", O.POINTS))
def entry_get(spark, sf_dir):
    return entries.at_index(detection(emb(spark, sf_dir), T).points(), 17, "points").select("image_id", "entry_id", "row_fx", "col_fx")


@query(O.ridges("emb", T, "SELECT image_id, entry_id, row_fx, col_fx FROM points WHERE entry_id <> 5 UNION ALL SELECT image_id, entry_id + (SELECT count(*) FROM points), row_fx, col_fx FROM points WHERE entry_id < 10", O.POINTS))
def entry_append_remove(spark, sf_dir):
    """The first ten points again at the end, then one removed."""
    p = detection(emb(spark, sf_dir), T).points()
    return entries.without(entries.appended(p, p.filter("entry_id < 10")), 5).select("image_id", "entry_id", "row_fx", "col_fx")


# masks ---------------------------------------------------------------------------------


def _mask_sql(hit: str) -> str:
    return f"""SELECT g.image_id, CAST(g."row" AS INTEGER) AS "row", CAST(g.col AS INTEGER) AS col, CAST(CASE WHEN h.pr IS NULL THEN 0 ELSE 255 END AS SMALLINT) AS m FROM raw g
LEFT JOIN (SELECT DISTINCT * FROM ({hit})) h ON h.pr = g."row" AND h.pc = g.col"""


@query(O.ridges("emb", T, _mask_sql("SELECT row_fx >> 7 AS pr, col_fx >> 7 AS pc FROM points"), O.POINTS))
def mask_points(spark, sf_dir):
    d = detection(emb(spark, sf_dir), T)
    return raster.mask(raster.pixels(d.points()), d.dims)


@query(O.ridges("emb", T, _mask_sql("SELECT least(r1, r2) >> 7 AS pr, least(c1, c2) >> 7 AS pc FROM segments"), O.SIDES, O.SEGMENTS))
def mask_segments(spark, sf_dir):
    d = detection(emb(spark, sf_dir), T)
    return raster.mask(raster.pixels(d.segments()), d.dims)


_PAIRS = "pairs AS (SELECT entry_id, row_fx AS r1, col_fx AS c1, lead(row_fx) OVER w AS r2, lead(col_fx) OVER w AS c2 FROM lines WINDOW w AS (PARTITION BY entry_id ORDER BY pos))"


@query(O.ridges("emb", T, _mask_sql("SELECT least(r1, r2) >> 7 AS pr, least(c1, c2) >> 7 AS pc FROM pairs WHERE r2 IS NOT NULL"), O.SIDES, O.SEGMENTS, O.LINES, _PAIRS))
def mask_lines(spark, sf_dir):
    d = detection(emb(spark, sf_dir), T)
    return raster.mask(raster.pixels(d.lines()), d.dims)


# classes -------------------------------------------------------------------------------
_LABELS = "l AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS entry_id, * FROM labels)"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id by doc_id; blocks of ids are ranked apart, so no task ranks them all."""
    rows = table(spark, sf_dir, "labels").withColumn("b", F.expr("doc_id div 4096"))
    counts = rows.groupBy("b").count()
    above = F.coalesce(F.sum("count").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("b").orderBy("doc_id"))
    return rows.withColumn("k", rank).join(counts.select("b", above.alias("above")), "b").select((F.col("above") + F.col("k") - 1).alias("entry_id"), "doc_id", "quality", "toxic")


@query(f"""WITH {_LABELS}, c AS (SELECT count(*) FILTER (WHERE toxic = 0) AS a, count(*) FILTER (WHERE toxic <> 0) AS b, count(toxic) AS n FROM l)
SELECT a, b, n, round(a * 100.0::DOUBLE / n, 2) AS a_percent, round(b * 100.0::DOUBLE / n, 2) AS b_percent FROM c""")
def class_summary(spark, sf_dir):
    return classes.summary(labels(spark, sf_dir), "toxic")


@query(f"""WITH {_LABELS}, c AS (SELECT count(*) FILTER (WHERE toxic <> 0 AND quality = 0) AS a_to_b, count(*) FILTER (WHERE toxic = 0 AND quality <> 0) AS b_to_a, count(*) AS n FROM l)
SELECT a_to_b, b_to_a, n, round(a_to_b * 100.0::DOUBLE / n, 2) AS a_to_b_percent, round(b_to_a * 100.0::DOUBLE / n, 2) AS b_to_a_percent FROM c""")
def class_diff(spark, sf_dir):
    """quality is the reference, toxic the tested classification."""
    x = labels(spark, sf_dir)
    return classes.difference(x.select("entry_id", F.col("toxic").alias("class")), x.select("entry_id", F.col("quality").alias("class")))


@query(f"WITH {_LABELS} SELECT entry_id, CAST(toxic AS VARCHAR) AS line FROM l")
def class_dump(spark, sf_dir):
    return classes.dump(labels(spark, sf_dir), "toxic")


@query(f"WITH {_LABELS} SELECT CASE WHEN toxic <> 0 THEN 'b' ELSE 'a' END AS part, entry_id FROM l")
def class_split(spark, sf_dir):
    a, b = classes.split(classes.validated(labels(spark, sf_dir), "toxic"), "toxic")
    return a.select(F.lit("a").alias("part"), "entry_id").unionByName(b.select(F.lit("b").alias("part"), "entry_id"))


@query(f"WITH {_LABELS} SELECT CAST(d.doc_id AS BIGINT) AS entry_id, CAST(coalesce(l.toxic, 0) AS SMALLINT) AS class FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id")
def class_extend(spark, sf_dir):
    """Documents as entries; those without a label get class 0."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"))
    known = labels(spark, sf_dir).select(F.col("doc_id").alias("entry_id"), F.col("toxic").alias("class"))
    return classes.extended(docs, known).select("entry_id", "class")


@query(f"WITH {_LABELS} SELECT entry_id, CAST(CASE WHEN entry_id = 3 THEN CASE WHEN toxic = 0 THEN 1 ELSE 0 END ELSE toxic END AS SMALLINT) AS class FROM l")
def class_toggle(spark, sf_dir):
    return classes.toggled(labels(spark, sf_dir).select("entry_id", F.col("toxic").alias("class")), 3)


_INDEX = 'pixel AS (SELECT (r1 + r2) >> 8 AS "row", (c1 + c2) >> 8 AS col, max(entry_id) AS entry_id FROM pairs WHERE r2 IS NOT NULL GROUP BY ALL)'


@query(O.ridges("emb", T, """SELECT 'emb' AS image_id, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, entry_id FROM pixel""", O.SIDES, O.SEGMENTS, O.LINES, _PAIRS, _INDEX))
def pixel_index(spark, sf_dir):
    return classes.pixel_index(detection(emb(spark, sf_dir), T).lines())


@query(O.ridges("emb", T, """SELECT entry_id FROM pixel WHERE "row" = 18 AND col = 10""", O.SIDES, O.SEGMENTS, O.LINES, _PAIRS, _INDEX))
def pixel_pick(spark, sf_dir):
    return classes.pick(classes.pixel_index(detection(emb(spark, sf_dir), T).lines()), "emb", 10.2, 17.8)


@query(O.ridges("emb", T, """SELECT CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, entry_id FROM pixel WHERE "row" BETWEEN 100 AND 179 AND col BETWEEN 8 AND 39""", O.SIDES, O.SEGMENTS, O.LINES, _PAIRS, _INDEX))
def pixel_window(spark, sf_dir):
    """A window of a stored index in Morton order, of which only the files it touches are read."""
    place = folder(spark, "index")
    pixelindex.store(classes.pixel_index(detection(emb(spark, sf_dir), T).lines()), place, 2000)
    return pixelindex.within(spark, place, "emb", (100, 180), (8, 40))


@query(f"""WITH {_LABELS}, e AS (SELECT entry_id, toxic, quality, doc_id FROM l UNION ALL SELECT entry_id + (SELECT count(*) FROM l), toxic, quality, doc_id FROM l WHERE quality = 1),
f AS (SELECT entry_id, doc_id, CASE WHEN entry_id % 7 = 1 THEN 1 - toxic WHEN entry_id % 11 = 2 THEN 1 - CAST(entry_id % 2 AS INTEGER) ELSE toxic END AS class FROM e WHERE entry_id % 5 <> 3)
SELECT row_number() OVER (ORDER BY entry_id) - 1 AS entry_id, doc_id, CAST(class AS SMALLINT) AS class FROM f""")
def class_edits(spark, sf_dir):
    """Appended entries, removals, toggles and classes set over one base, merged and compacted."""
    every = labels(spark, sf_dir).select(F.lit("labels").alias("image_id"), "entry_id", "doc_id", "quality", F.col("toxic").alias("class"))
    good = every.filter("quality = 1")
    log = editlog.EditLog.create(every, folder(spark, "edits"))
    log.append(good)
    ids = log.live().select("image_id", "entry_id")
    edit = lambda some, op, step, value=None: some.select(F.lit(step).alias("step"), F.lit(op).alias("op"), "image_id", "entry_id", (F.lit(None) if value is None else value).cast("smallint").alias("class"))
    log.edit(edit(ids.filter("entry_id % 11 = 2 and entry_id % 7 <> 1"), "set", 0, F.col("entry_id") % 2))
    log.edit(edit(ids.filter("entry_id % 7 = 1 or entry_id % 11 = 2"), "toggle", 1).unionByName(edit(ids.filter("entry_id % 5 = 3"), "remove", 2)))
    return log.compacted().read().select("entry_id", "doc_id", "class")


# scale space ---------------------------------------------------------------------------


def _space_ctes() -> tuple[str, list[str]]:
    from ..functions.scales import sorted_distinct, to_thirds

    scales, parts, names, last = sorted_distinct(to_thirds(SPACE)), [f"raw AS ({O.SURFACES['emb']})"], [], 0.0
    for i, s in enumerate(scales):
        parts.append(O.smoothing(f"p{i - 1}" if i else "raw", f"p{i}", s - last))
        names.append(f'SELECT image_id, {i} AS scale_idx, {O.number(s)} AS scale, "row", col, v FROM p{i}')
        last = s
    return ",\n".join([*parts, f"space AS MATERIALIZED ({' UNION ALL '.join(names)})"]), names


_SPACE, _ = _space_ctes()
_SPACE_KEYS = 'image_id, scale_idx, scale, "row", col'


@query(f'WITH {_SPACE} SELECT image_id, scale_idx, scale, "row", col, {_us("v")} FROM space')
def scale_space(spark, sf_dir):
    return scalespace.generate(emb(spark, sf_dir), SPACE).select("image_id", "scale_idx", "scale", "row", "col", *_u("v"))


@query(f'WITH {_SPACE} SELECT image_id, scale_idx, "row", {_us("v")} FROM space WHERE col = 7 AND scale_idx <> 1')
def scale_sections(spark, sf_dir):
    """A cut across the scales, without its second plane; of the image only columns near the cut are read."""
    cut = Windowed(partial(emb, spark, sf_dir)).scale_space(SPACE).section("col", 7).df()
    return cut.filter("scale_idx <> 1").select("image_id", "scale_idx", "row", *_u("v"))


@query(f"WITH {_SPACE}, f AS (SELECT {_SPACE_KEYS}, {O.convolved('v', O.DERIVATIVE)} AS v FROM space {O.window('scale')}) SELECT image_id, scale_idx, \"row\", col, {_us('v')} FROM f")
def scale_derivative(spark, sf_dir):
    return scalespace.filter_space(scalespace.generate(emb(spark, sf_dir), SPACE), derivative(), ("scale",)).select("image_id", "scale_idx", "row", "col", *_u("v"))


@query(f"""WITH {_SPACE}, {O.derivative_ctes("space", "dv", _SPACE_KEYS, ", scale_idx")}, {O.metric_ctes("dv", "me", "N", "scale")},
g AS (SELECT *, {O.convolved("r", O.DERIVATIVE)} AS dr FROM me {O.window("scale")}), h AS (SELECT *, {O.convolved("dr", O.DERIVATIVE)} AS ddr FROM g {O.window("scale")})
SELECT image_id, scale_idx, "row", col, {_us("lp", "lpp")}, {_fs("r", "dr", "ddr")} FROM h""")
def scale_metrics(spark, sf_dir):
    return scalespace.scale_metrics(scalespace.generate(emb(spark, sf_dir), SPACE)).select("image_id", "scale_idx", "row", "col", *_u("lp", "lpp"), *_f("r", "dr", "ddr"))


# text and files ------------------------------------------------------------------------


def _csv(*point: str) -> str:
    return "printf('%.3f,%.3f,%e,%e', {} / 128.0::DOUBLE, {} / 128.0::DOUBLE, {}, {})".format(*point)


@query(O.ridges("emb", T, f"SELECT entry_id, {_csv('row_fx', 'col_fx', 'brightness', 'strength')} AS line FROM points", O.POINTS))
def csv_rows(spark, sf_dir):
    """All four fields of the CSV rows of points."""
    return text.csv_lines(detection(emb(spark, sf_dir), T).points()).select("entry_id", "line")


@query(O.ridges("emb", T, f"SELECT entry_id, {_csv('r1', 'c1', 'b1', 's1')} || ',' || {_csv('r2', 'c2', 'b2', 's2')} AS line FROM segments", O.SIDES, O.SEGMENTS))
def csv_segments(spark, sf_dir):
    """The eight fields of a segment."""
    return text.csv_lines(detection(emb(spark, sf_dir), T).segments()).select("entry_id", "line")


@query(O.ridges("emb", T, f"""SELECT entry_id, pos, {_csv('row_fx', 'col_fx', 'brightness', 'strength')} AS line FROM lines
UNION ALL SELECT entry_id, max(pos) + 1, '' FROM lines GROUP BY entry_id""", O.SIDES, O.SEGMENTS, O.LINES))
def csv_line_rows(spark, sf_dir):
    """A row for each point of a line, and a blank one after it."""
    rows = text.csv_lines(detection(emb(spark, sf_dir), T).lines())
    return rows.select("entry_id", F.col("pos").cast("bigint").alias("pos"), "line")


@query(O.ridges("emb", T, """SELECT entry_id, string_agg(regexp_replace(printf('%.7f', col_fx / 128.0::DOUBLE), '\\.?0+$', '') || ' ' || regexp_replace(printf('%.7f', row_fx / 128.0::DOUBLE), '\\.?0+$', ''), ' L ' ORDER BY pos) AS path FROM lines GROUP BY entry_id""", O.SIDES, O.SEGMENTS, O.LINES))
def svg_paths(spark, sf_dir):
    shapes = text.svg_elements(detection(emb(spark, sf_dir), T).lines())
    return shapes.select("entry_id", F.regexp_extract("element", 'd="M ([^"]*)"', 1).alias("path"))


def _name(path: Column) -> Column:
    """The image that a file is named after."""
    return F.regexp_extract(path, r"([^/]*)\.[a-z]+$", 1)


def _container(spark: SparkSession, entries: DataFrame, dims: DataFrame) -> str:
    """The path of a container that many tasks have written."""
    place = folder(spark, "containers")
    ridg.write_images(entries, dims, place)
    return f"{place}/emb.ridg"


def _image(spark: SparkSession, name: str, pixels: DataFrame, value: str = "v") -> str:
    """The path of a float TIFF that many tasks have written."""
    place = folder(spark, "images")
    tiff.write_images(pixels, surface.size(pixels), place, value)
    return f"{place}/{name}.tif"


@query(O.ridges("emb", T, "SELECT entry_id, row_fx, col_fx FROM points", O.POINTS))
def ridg_roundtrip(spark, sf_dir):
    """Points written to one container by many tasks and read from it in planned parts."""
    d = detection(emb(spark, sf_dir), T)
    return ridg.read(spark, _container(spark, d.points(), d.dims), "points").select("entry_id", "row_fx", "col_fx")


@query(O.ridges("emb", T, "SELECT entry_id, row_fx, col_fx FROM points WHERE entry_id >= 100 AND entry_id < 160", O.POINTS))
def ridg_range(spark, sf_dir):
    """A range of entries, of which alone the bytes are read."""
    d = detection(emb(spark, sf_dir), T)
    points = ridg.read(spark, _container(spark, d.points(), d.dims), "points")
    return points.filter("entry_id >= 100 and entry_id < 160").select("entry_id", "row_fx", "col_fx")


@query(f'WITH raw AS ({O.SURFACES["emb"]}) SELECT image_id, "row", col, v FROM raw')
def tiff_roundtrip(spark, sf_dir):
    """A surface written to one TIFF in bands and read by its strips."""
    return tiff.read(spark, _image(spark, "emb", emb(spark, sf_dir))).withColumn("image_id", _name(F.col("image_id")))


@query(f'WITH raw AS ({O.SURFACES["emb"]}) SELECT image_id, CAST("row" - 7 AS INTEGER) AS "row", CAST(col - 9 AS INTEGER) AS col, v FROM raw WHERE "row" >= 7 AND "row" < 57 AND col >= 9 AND col < 41')
def tiff_extents(spark, sf_dir):
    """A window of a TIFF: half-open, moved to the origin; only the rows it touches are read."""
    return tiff.read(spark, _image(spark, "emb", emb(spark, sf_dir)), (7, 9, 50, 32)).withColumn("image_id", _name(F.col("image_id")))


@query(O.ridges("emb", T, f'SELECT image_id, "row", col, dir, d, {_us("brightness")} FROM edges'))
def tiff_tiles(spark, sf_dir):
    """Edges of an image read as tiles, which its strips become directly."""
    image = planned.tiffs(spark, _image(spark, "emb", emb(spark, sf_dir)), "tiles")
    found = detection_of_tiles(tiles.staged(image), T)
    return found.edges.select(_name(F.col("image_id")).alias("image_id"), "row", "col", "dir", "d", *_u("brightness"))


@query(f'WITH raw AS ({O.SURFACES["li"]}) SELECT image_id, CAST(max("row") + 1 AS INTEGER) AS "rows", CAST(max(col) + 1 AS INTEGER) AS cols FROM raw GROUP BY image_id')
def tiff_sizes(spark, sf_dir):
    """Sizes from headers alone."""
    return tiff.sizes(spark, _image(spark, "li", li(spark, sf_dir))).withColumn("image_id", _name(F.col("image_id")))


@query(f"""WITH raw AS ({O.SURFACES["emb"]}), {O.smoothing("raw", "sm", T)}, {O.derivative_ctes("sm", "dv")}, {O.metric_ctes("dv", "me", "N", O.number(T))}
SELECT 'lpp' AS plane, "row", col, {O.millionths("x")} AS v_u FROM (SELECT "row", col, CAST(CAST(lpp AS FLOAT) AS DOUBLE) AS x FROM me)""")
def tiff_dump(spark, sf_dir):
    """A plane of the metrics written as a float TIFF and read back."""
    m = blocks.metrics_by_blocks(emb(spark, sf_dir), T, "N")
    return tiff.read(spark, _image(spark, "emb", m, "lpp")).select(F.lit("lpp").alias("plane"), "row", "col", *_u("v"))


@query(O.ridges("emb", T, """SELECT 'points' AS kind, (SELECT count(*) FROM points) AS entries, CAST("rows" AS BIGINT) AS "rows", CAST(cols AS BIGINT) AS cols, CAST(3735928559 AS BIGINT) AS own, true AS gone FROM dims""", O.POINTS))
def metadata_block(spark, sf_dir):
    """Metadata of a container: the image's size, a key set, a key taken out, one of another length."""
    d = detection(emb(spark, sf_dir), T)
    head = ridg.headers_at(spark, _container(spark, d.points(), d.dims))
    meta = entries.with_metadata(entries.with_metadata(F.col("metadata"), 0x77, bytes.fromhex("deadbeef")), 0x78, b"no")
    out = head.withColumns({"m": meta, "left": entries.with_metadata(meta, 0x77, None)})
    gone = entries.metadata_uint32(F.col("left"), 0x77).isNull() & entries.metadata_uint32(F.col("m"), 0x78).isNull()
    return out.select("kind", "entries", *[entries.metadata_uint32(F.col("m"), k).alias(n) for k, n in ((ridg.ROWS, "rows"), (ridg.COLS, "cols"), (0x77, "own"))], gone.alias("gone"))


@query(O.ridges("emb", T, "SELECT entry_id, r1, c1, r2, c2 FROM segments", O.SIDES, O.SEGMENTS))
def ridg_segments(spark, sf_dir):
    """Segments written to one container by many tasks and read from it in planned parts."""
    d = detection(emb(spark, sf_dir), T)
    return _flat(ridg.read(spark, _container(spark, d.segments(), d.dims), "segments")).select("entry_id", "r1", "c1", "r2", "c2")


@query(O.ridges("emb", T, "SELECT entry_id, pos, row_fx, col_fx FROM lines", O.SIDES, O.SEGMENTS, O.LINES))
def ridg_lines(spark, sf_dir):
    """Lines written to one container by many tasks and read from it in planned parts."""
    d = detection(emb(spark, sf_dir), T)
    return _exploded(ridg.read(spark, _container(spark, d.lines(), d.dims), "lines")).select("entry_id", "pos", "row_fx", "col_fx")


@query(O.ridges("emb", T, "SELECT entry_id, CAST(entry_id % 3 AS SMALLINT) AS class, CAST(entry_id % 8 AS FLOAT) / 8 AS likelihood FROM points", O.POINTS))
def class_save(spark, sf_dir):
    """Classes and likelihoods through a container file."""
    d = detection(emb(spark, sf_dir), T)
    classed = d.points().withColumns({"class": (F.col("entry_id") % 3).cast("smallint"), "likelihood": ((F.col("entry_id") % 8) / 8).cast("float")})
    return ridg.read(spark, _container(spark, classed, d.dims), "points", with_class=True).select("entry_id", "class", "likelihood")


_HIT = """SELECT DISTINCT image_id, CAST({r} AS INTEGER) AS "row", CAST({c} AS INTEGER) AS col, CAST(255 AS SMALLINT) AS m FROM {t} JOIN dims USING (image_id) WHERE {r} < "rows" AND {c} < cols"""


def _masked(spark: SparkSession, hit: DataFrame, dims: DataFrame, form: str) -> DataFrame:
    place = folder(spark, "masks")
    masks.write_images(hit.withColumn("m", F.lit(255).cast("smallint")), dims, place, form)
    return masks.read(spark, place, form).withColumn("image_id", _name(F.col("image_id")))


@query(O.ridges("emb", T, _HIT.format(r="(row_fx >> 7)", c="(col_fx >> 7)", t="points"), O.POINTS))
def mask_png(spark, sf_dir):
    """Set pixels of a PNG mask that many tasks wrote, read back band by band."""
    d = detection(emb(spark, sf_dir), T)
    return _masked(spark, raster.pixels(d.points()), d.dims, "png")


@query(O.ridges("emb", T, _HIT.format(r="(least(r1, r2) >> 7)", c="(least(c1, c2) >> 7)", t="segments"), O.SIDES, O.SEGMENTS))
def mask_tiff(spark, sf_dir):
    """Set pixels of an 8-bit TIFF mask that many tasks wrote, read back by its strips."""
    d = detection(emb(spark, sf_dir), T)
    return _masked(spark, raster.pixels(d.segments()), d.dims, "tiff")


def _px(x: str) -> str:
    return f"regexp_replace(printf('%.7f', ({x}) / 128.0::DOUBLE), '\\.?0+$', '')"


@query(O.ridges("emb", T, f"SELECT entry_id, {_px('c1')} || ' ' || {_px('500 * 128 - r1')} || ' m ' || {_px('c2')} || ' ' || {_px('500 * 128 - r2')} || ' l S' AS ops FROM segments", O.SIDES, O.SEGMENTS))
def pdf_segments(spark, sf_dir):
    """Drawing operators of a PDF page 500 high; y grows upwards."""
    return text.pdf_operators(detection(emb(spark, sf_dir), T).segments(), 500).select("entry_id", "ops")


@query(O.ridges("emb", T, """SELECT entry_id, layer, CASE WHEN layer = 0 THEN '#00ff00' WHEN entry_id % 3 = 0 THEN '#0000ff' ELSE '#ff0000' END AS stroke, CASE WHEN layer = 0 THEN '1' ELSE '0.5' END AS width
FROM (SELECT entry_id, 1 AS layer FROM line_ids UNION ALL SELECT entry_id, 0 FROM line_ids WHERE entry_id = 4)""", O.SIDES, O.SEGMENTS, O.LINES))
def svg_classes(spark, sf_dir):
    """Strokes of classified lines: a colour per class, and a green stroke under the selected line."""
    classed = detection(emb(spark, sf_dir), T).lines().withColumn("class", (F.col("entry_id") % 3).cast("smallint"))
    shapes = text.class_elements(classed, selected=4)
    return shapes.select("entry_id", "layer", F.regexp_extract("element", 'stroke="([^"]*)"', 1).alias("stroke"), F.regexp_extract("element", 'stroke-width="([^"]*)"', 1).alias("width"))


@query(O.ridges("emb", T, "SELECT entry_id, row_fx, CAST(round_even((col_fx / 128.0::DOUBLE + 0.005::DOUBLE) * 128.0::DOUBLE, 0) AS BIGINT) AS col_fx FROM points", O.POINTS))
def fixed_positions(spark, sf_dir):
    """Positions to pixels and back, the columns moved by less than one unit."""
    p = detection(emb(spark, sf_dir), T).points()
    return p.select("entry_id", to_fixed(to_subpixel(F.col("row_fx"))).alias("row_fx"), to_fixed(to_subpixel(F.col("col_fx")) + F.lit(0.005)).alias("col_fx"))


def _sampled(v: str) -> str:
    tap = lambda i: f"exp(-{i * i}::DOUBLE / 2.0::DOUBLE) / sqrt(2.0::DOUBLE * pi())"
    return "(" + " + ".join(f"{tap(i)} * {O.shifted(v, -i)}" for i in range(-3, 4)) + ")"


@query(f"WITH raw AS ({O.SURFACES['emb']}), one AS (SELECT {GRID}, {_sampled('v')} AS v FROM raw {O.window('rows')}), two AS (SELECT {GRID}, {_sampled('v')} AS v FROM one {O.window('cols')}) SELECT {GRID}, {_us('v')} FROM two")
def smooth_sampled(spark, sf_dir):
    """The sampled Gaussian of variance 1, not normalised."""
    return blocks.filtered(emb(spark, sf_dir), gaussian(1.0, sampled=True)).select("image_id", "row", "col", *_u("v"))


@query(f'WITH {_SPACE} SELECT image_id, CAST(scale_idx - 1 AS INTEGER) AS scale_idx, CAST("row" - 10 AS INTEGER) AS "row", CAST(col - 4 AS INTEGER) AS col, {_us("v")} FROM space WHERE scale_idx BETWEEN 1 AND 2 AND "row" BETWEEN 10 AND 29 AND col BETWEEN 4 AND 15')
def scale_view(spark, sf_dir):
    """A box of the scale space, moved to its origin; the scan reads the rows and planes that it rests on."""
    return Windowed(partial(emb, spark, sf_dir)).scale_space(SPACE).view(10, 4, 20, 12, 1, 2).select("image_id", "scale_idx", "row", "col", *_u("v"))
