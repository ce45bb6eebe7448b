"""The same computations as SQL text, for checking against another engine.

Every sum keeps the plan's term order, so doubles agree bit for bit; results are
compared as integers (positions, flags, millionths).
"""

from __future__ import annotations

# fixed values, not the engine's: (shift, weight) of the derivative, and weights of the Gaussians
# of variance n/3, last sample first; 216 (n = 3) is 6^3, and so on, summed in double
DERIVATIVE = ((1, -0.5), (-1, 0.5))
GAUSSIANS = {
    1: (0.16666666666666666, 0.6666666666666666, 0.16666666666666666),
    2: (0.027777777777777776, 0.2222222222222222, 0.5, 0.2222222222222222, 0.027777777777777776),
    3: (0.004629629629629629, 0.05555555555555555, 0.2361111111111111, 0.4074074074074074, 0.23611111111111108, 0.05555555555555555, 0.004629629629629629),
}
Terms = tuple[tuple[int, float], ...]

SURFACES = {
    "emb": """SELECT 'emb' AS image_id, CAST(vec_id AS INTEGER) AS "row", CAST(i - 1 AS INTEGER) AS col, CAST(embedding[i] AS DOUBLE) AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
    "evt": """SELECT 'evt' AS image_id, CAST(r.i AS INTEGER) AS "row", CAST(c.i AS INTEGER) AS col, CAST(coalesce(n, 0) AS DOUBLE) AS v
  FROM (SELECT unnest(range(0, (SELECT max(user_id) + 1 FROM events))) AS i) r CROSS JOIN (SELECT unnest(range(0, 30)) AS i) c
  LEFT JOIN (SELECT user_id, day(ts) - 1 AS d, count(*) AS n FROM events GROUP BY ALL) e ON e.user_id = r.i AND e.d = c.i""",
    "li": """SELECT 'li' AS image_id, CAST(r.i AS INTEGER) AS "row", CAST(c.i AS INTEGER) AS col, CAST(coalesce(q, 0) AS DOUBLE) AS v
  FROM (SELECT unnest(range(0, (SELECT max(l_suppkey) + 1 FROM lineitem))) AS i) r
  CROSS JOIN (SELECT unnest(range(0, (SELECT max(year(l_shipdate) * 12 + month(l_shipdate)) - min(year(l_shipdate) * 12 + month(l_shipdate)) + 1 FROM lineitem))) AS i) c
  LEFT JOIN (SELECT l_suppkey, year(l_shipdate) * 12 + month(l_shipdate) - (SELECT min(year(l_shipdate) * 12 + month(l_shipdate)) FROM lineitem) AS m, sum(CAST(l_quantity AS BIGINT)) AS q
             FROM lineitem GROUP BY ALL) s ON s.l_suppkey = r.i AND s.m = c.i""",
}
_AXIS = {"rows": ('image_id, "row"', "col"), "cols": ("image_id, col", '"row"'), "scale": ('image_id, "row", col', "scale_idx")}


def number(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def millionths(x: str) -> str:
    return f"CAST(floor({x} * {number(1e6)} + {number(0.5)}) AS BIGINT)"


def fine(x: str, unit: float = 1e15) -> str:
    return f"CAST(floor({x} * {number(unit)} + {number(0.5)}) AS BIGINT)"


def window(axis: str, extra: str = "") -> str:
    keys, order = _AXIS[axis]
    part = f"PARTITION BY {keys}{extra} ORDER BY {order}"
    return f"WINDOW w AS ({part}), wf AS ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def shifted(v: str, by: int) -> str:
    if by == 0:
        return v
    return f"coalesce(lead({v}, {by}) OVER w, last_value({v}) OVER wf)" if by > 0 else f"coalesce(lag({v}, {-by}) OVER w, first_value({v}) OVER wf)"


def convolved(v: str, terms: Terms) -> str:
    return "(" + " + ".join(f"{number(weight)} * {shifted(v, by)}" for by, weight in terms) + ")"


def smoothing(source: str, target: str, t: float, keys: str = 'image_id, "row", col', extra: str = "") -> str:
    """CTEs ``target`` = ``source`` smoothed."""
    n = round(3 * t)
    if n == 0:
        return f"{target} AS (SELECT {keys}, v FROM {source})"
    k = tuple((n - i, weight) for i, weight in enumerate(GAUSSIANS[n]))
    return f"""{target}_1 AS (SELECT {keys}, {convolved("v", k)} AS v FROM {source} {window("rows", extra)}),
{target} AS (SELECT {keys}, {convolved("v", k)} AS v FROM {target}_1 {window("cols", extra)})"""


def derivative_ctes(source: str, target: str, keys: str = 'image_id, "row", col', extra: str = "") -> str:
    d = DERIVATIVE
    return f"""{target}_1 AS (SELECT {keys}, v, {convolved("v", d)} AS dx FROM {source} {window("rows", extra)}),
{target}_2 AS (SELECT *, {convolved("dx", d)} AS dxx FROM {target}_1 {window("rows", extra)}),
{target}_3 AS (SELECT *, {convolved("v", d)} AS dy, {convolved("dx", d)} AS dxy FROM {target}_2 {window("cols", extra)}),
{target} AS (SELECT *, {convolved("dy", d)} AS dyy FROM {target}_3 {window("cols", extra)})"""


def metric_ctes(source: str, target: str, metric: str, t: str) -> str:
    """From derivatives to l1, l2, lp, lpp, r; ``t`` is an SQL expression."""
    eps = number(2.0**-23)
    strength = {
        "N": f"((({t} * {t}) * ({t} * {t})) * (l1 * l1 - l2 * l2)) * (l1 * l1 - l2 * l2)",
        "M": f"{t} * greatest(abs(l1), abs(l2))",
        "A": f"({t} * {t}) * ((l1 - l2) * (l1 - l2))",
    }[metric]
    return f"""{target}_a AS (SELECT *, dyy AS a, dxx AS d, CASE WHEN abs(dxy) < {eps} * (abs(dyy) + abs(dxx)) THEN {number(0.0)} ELSE dxy END AS b FROM {source}),
{target}_b AS (SELECT *, (a - d) / {number(2.0)} AS hf FROM {target}_a),
{target}_c AS (SELECT *, sqrt(hf * hf + b * b) AS h FROM {target}_b),
{target}_d AS (SELECT *, b * b / nullif(h + abs(hf), 0) AS far FROM {target}_c),
{target}_e AS (SELECT *, CASE WHEN hf <= 0 THEN far ELSE -far END AS x FROM {target}_d),
{target}_f AS (SELECT *, abs(b) > abs(x) AS steep, CASE WHEN abs(b) > abs(x) THEN -x / nullif(b, 0) ELSE -b / nullif(x, 0) END AS q FROM {target}_e),
{target}_g AS (SELECT *, {number(1.0)} / sqrt({number(1.0)} + q * q) AS rr FROM {target}_f),
{target}_h AS (SELECT *, CASE WHEN b <> 0 THEN CASE WHEN steep THEN rr * q ELSE rr END ELSE {number(1.0)} END AS c,
  CASE WHEN b <> 0 THEN CASE WHEN steep THEN rr ELSE rr * q END ELSE {number(0.0)} END AS s FROM {target}_g),
{target}_i AS (SELECT *, CASE WHEN b = 0 THEN a ELSE (c * c * a - {number(2.0)} * (c * s) * b) + s * s * d END AS l1,
  CASE WHEN b = 0 THEN d ELSE (s * s * a + {number(2.0)} * (c * s) * b) + c * c * d END AS l2 FROM {target}_h),
{target} AS (SELECT *, CASE WHEN abs(l1) > abs(l2) THEN c * dy + (-s) * dx ELSE s * dy + c * dx END AS lp,
  CASE WHEN abs(l1) > abs(l2) THEN l1 ELSE l2 END AS lpp, {strength} AS r FROM {target}_i)"""


def edge_ctes(surface: str, t: float, metric: str = "N") -> str:
    """CTEs raw .. edges and dims of one of the table surfaces."""

    def side(name: str, axis: str) -> str:
        keys, order = _AXIS[axis]
        cols = ", ".join(f"lead({c}) OVER w AS {c}2" for c in ("lp", "lpp", "r", "raw"))
        return f"""edge_{name} AS (SELECT image_id, "row", col, '{name}' AS dir, x, raw, raw2, r, r2 FROM
  (SELECT *, CASE WHEN (lp > 0) = (lp2 <= 0) THEN lp / nullif(lp - lp2, 0) END AS x FROM
    (SELECT *, {cols} FROM both_ WINDOW w AS (PARTITION BY {keys} ORDER BY {order})) WHERE lp2 IS NOT NULL)
  WHERE x IS NOT NULL AND NOT ((1 - x) * lpp + x * lpp2 > 0))"""

    return f"""raw AS MATERIALIZED ({SURFACES[surface]}),
dims AS (SELECT image_id, CAST(max("row") + 1 AS INTEGER) AS "rows", CAST(max(col) + 1 AS INTEGER) AS cols FROM raw GROUP BY image_id),
{smoothing("raw", "sm", t)},
{derivative_ctes("sm", "dv")},
{metric_ctes("dv", "me", metric, number(float(t)))},
both_ AS (SELECT m.image_id, m."row", m.col, lp, lpp, r, raw.v AS raw FROM me m JOIN raw USING (image_id, "row", col)),
{side("N", "rows")},
{side("W", "cols")},
edge_x AS (SELECT *, CAST(round_even(x * 128, 0) AS INTEGER) AS d FROM (SELECT * FROM edge_N UNION ALL SELECT * FROM edge_W)),
edges AS MATERIALIZED (SELECT image_id, "row", col, dir, d, (1 - d / {number(128.0)}) * raw + d / {number(128.0)} * raw2 AS brightness,
  (1 - d / {number(128.0)}) * r + d / {number(128.0)} * r2 AS strength,
  CAST("row" AS BIGINT) * 128 + CASE WHEN dir = 'N' THEN 0 ELSE d END AS row_fx, CAST(col AS BIGINT) * 128 + CASE WHEN dir = 'N' THEN d ELSE 0 END AS col_fx FROM edge_x)"""


POINTS = """points AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY "row", col, dir) - 1 AS entry_id, row_fx, col_fx, brightness, strength FROM edges)"""

SIDES = """sides AS (SELECT s.image_id, s.cr, s.cc, s.bit, s.er, s.ec, s.ed, s.d, s.row_fx, s.col_fx, s.brightness, s.strength FROM (
  SELECT *, "row" AS er, col AS ec, dir AS ed, "row" AS cr, col AS cc, CASE WHEN dir = 'N' THEN 1 ELSE 2 END AS bit FROM edges
  UNION ALL SELECT *, "row" AS er, col AS ec, dir AS ed, CASE WHEN dir = 'N' THEN "row" - 1 ELSE "row" END, CASE WHEN dir = 'N' THEN col ELSE col - 1 END, CASE WHEN dir = 'N' THEN 4 ELSE 8 END FROM edges) s
  JOIN dims USING (image_id) WHERE cr >= 0 AND cc >= 0 AND (bit <= 2 OR (cr < "rows" - 1 AND cc < cols - 1)))"""

CELLS = """cells AS (SELECT image_id, cr AS "row", cc AS col, CAST(sum(bit) AS TINYINT) AS flags, CAST(max(CASE WHEN bit = 1 THEN d END) AS SMALLINT) AS north,
  CAST(max(CASE WHEN bit = 2 THEN d END) AS SMALLINT) AS west FROM sides GROUP BY image_id, cr, cc)"""

SEGMENTS = """two AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id, cr, cc ORDER BY bit) AS k FROM sides QUALIFY count(*) OVER (PARTITION BY image_id, cr, cc) = 2),
segs AS (SELECT p.image_id, p.cr, p.cc, p.row_fx AS r1, p.col_fx AS c1, p.brightness AS b1, p.strength AS s1, q.row_fx AS r2, q.col_fx AS c2, q.brightness AS b2, q.strength AS s2
  FROM two p JOIN two q ON p.image_id = q.image_id AND p.cr = q.cr AND p.cc = q.cc AND p.k = 1 AND q.k = 2),
segments AS (SELECT row_number() OVER (PARTITION BY image_id ORDER BY cr, cc) - 1 AS entry_id, * FROM segs)"""

_PREFERENCE = "CASE {bit} WHEN 1 THEN 0 WHEN 4 THEN 1 WHEN 2 THEN 2 ELSE 3 END"
LINES = f"""ends AS (SELECT t.*, CAST(cr AS BIGINT) * cols + cc AS cell, (CAST(er AS BIGINT) * cols + ec) * 2 + CASE WHEN ed = 'N' THEN 0 ELSE 1 END AS edge FROM two t JOIN dims USING (image_id)),
arcs AS MATERIALIZED (SELECT i.cell * 2 + i.k - 1 AS arc, i.cell, i.bit AS in_bit, o.bit AS out_bit, i.edge AS in_edge, o.edge AS out_edge,
  i.row_fx AS ir, i.col_fx AS ic, i.brightness AS ib, i.strength AS ist, o.row_fx AS orr, o.col_fx AS oc, o.brightness AS ob, o.strength AS ost
  FROM ends i JOIN ends o ON i.cell = o.cell AND i.k <> o.k),
nexts AS MATERIALIZED (SELECT a.arc, b.arc AS nxt FROM arcs a JOIN arcs b ON b.in_edge = a.out_edge AND b.cell <> a.cell),
walk AS (SELECT arc AS src, arc, CAST(0 AS BIGINT) AS pos FROM arcs WHERE arc NOT IN (SELECT nxt FROM nexts)
  UNION ALL SELECT w.src, n.nxt, w.pos + 1 FROM walk w JOIN nexts n ON n.arc = w.arc),
opened AS (SELECT w.* FROM walk w JOIN (SELECT w.src, s.cell AS first, e.cell AS last, s.in_bit, s.out_bit FROM walk w JOIN arcs s ON s.arc = w.src JOIN arcs e ON e.arc = w.arc
    WHERE w.arc NOT IN (SELECT arc FROM nexts)) x ON x.src = w.src WHERE x.first < x.last OR (x.first = x.last AND x.in_bit < x.out_bit)),
ring AS (SELECT arc AS src, arc, CAST(0 AS BIGINT) AS pos FROM arcs WHERE arc NOT IN (SELECT arc FROM walk)
  UNION ALL SELECT r.src, n.nxt, r.pos + 1 FROM ring r JOIN nexts n ON n.arc = r.arc WHERE n.nxt <> r.src),
closed AS (SELECT r.* FROM ring r JOIN (SELECT r.src, min(a.cell) AS low FROM ring r JOIN arcs a ON a.arc = r.arc GROUP BY r.src) m ON m.src = r.src JOIN arcs s ON s.arc = r.src
  WHERE s.cell = m.low AND {_PREFERENCE.format(bit="s.out_bit")} < {_PREFERENCE.format(bit="s.in_bit")}),
steps AS (SELECT p.src, p.pos, s.cell AS line_cell, a.* FROM (SELECT * FROM opened UNION ALL SELECT * FROM closed) p JOIN arcs a ON a.arc = p.arc JOIN arcs s ON s.arc = p.src),
line_pts AS (SELECT line_cell, CAST(0 AS BIGINT) AS pos, ir AS row_fx, ic AS col_fx, ib AS brightness, ist AS strength FROM steps WHERE pos = 0
  UNION ALL SELECT line_cell, pos + 1, orr, oc, ob, ost FROM steps),
line_ids AS (SELECT line_cell, row_number() OVER (ORDER BY line_cell) - 1 AS entry_id FROM (SELECT DISTINCT line_cell FROM line_pts)),
lines AS MATERIALIZED (SELECT entry_id, pos, row_fx, col_fx, brightness, strength FROM line_pts JOIN line_ids USING (line_cell))"""


def ridges(surface: str, t: float, select: str, *parts: str, metric: str = "N") -> str:
    return f"WITH RECURSIVE {edge_ctes(surface, t, metric)}" + "".join(f",\n{p}" for p in parts) + f"\n{select}"
