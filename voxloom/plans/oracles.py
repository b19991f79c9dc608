"""DuckDB SQL of the morphometry queries.

Written apart from the Spark plans: volumes are rebuilt from the part table in SQL, topology comes
from cell tables, distances from min-plus joins, components from recursion.
"""

from __future__ import annotations

import re

from voxloom.functions import intercepts
from voxloom.plans import fixtures, oracle_figures, oracle_lines, oracle_surfaces

_BASE = """
balls AS (SELECT CAST(floor(p_partkey / 40.0) AS INT) AS s, p_partkey AS ball, CAST((p_partkey * 7919 + 13) % 24 AS INT) AS cx,
  CAST((p_partkey * 104729 + 7) % 24 AS INT) AS cy, CAST((p_partkey * 1299709 + 3) % 24 AS INT) AS cz, CAST(2 + p_size % 3 AS INT) AS r FROM part),
g AS (SELECT CAST(i AS INT) AS i FROM range(24) t(i)),
o AS (SELECT CAST(i AS INT) AS d FROM range(-4, 5) t(i)),
solid AS (SELECT DISTINCT s, cx + a.d AS x, cy + b.d AS y, cz + c.d AS z FROM balls, o a, o b, o c
  WHERE a.d * a.d + b.d * b.d + c.d * c.d <= r * r AND cx + a.d BETWEEN 0 AND 23 AND cy + b.d BETWEEN 0 AND 23 AND cz + c.d BETWEEN 0 AND 23),
disc AS (SELECT a.i AS x, b.i AS y FROM g a, g b WHERE (2 * a.i - 23) * (2 * a.i - 23) + (2 * b.i - 23) * (2 * b.i - 23) <= 484),
bone AS (SELECT solid.s, x, y, z FROM solid JOIN disc USING (x, y)),
sp AS (SELECT DISTINCT s FROM balls)"""
_D3 = "d3 AS (SELECT CAST(i AS INT) AS d FROM range(-1, 2) t(i)), n26 AS (SELECT a.d AS dx, b.d AS dy, c.d AS dz FROM d3 a, d3 b, d3 c WHERE NOT (a.d = 0 AND b.d = 0 AND c.d = 0)), n6 AS (SELECT * FROM n26 WHERE abs(dx) + abs(dy) + abs(dz) = 1)"
_GRID = "grid AS (SELECT s, a.i AS x, b.i AS y, c.i AS z, bone.s IS NOT NULL AS bone FROM sp CROSS JOIN g a CROSS JOIN g b CROSS JOIN g c LEFT JOIN bone ON bone.s = sp.s AND bone.x = a.i AND bone.y = b.i AND bone.z = c.i)".replace("SELECT s,", "SELECT sp.s AS s,")
_CELLS = """
t3 AS (SELECT CAST(i AS INT) AS i FROM range(3) t(i)),
cells AS (SELECT DISTINCT s, 2 * x + a.i AS u, 2 * y + b.i AS v, 2 * z + c.i AS w FROM bone, t3 a, t3 b, t3 c),
signed AS (SELECT s, CAST(u % 2 + v % 2 + w % 2 AS INT) AS dim, CAST(u IN (0, 48) AS INT) + CAST(v IN (0, 48) AS INT) + CAST(w IN (0, 48) AS INT) AS touch FROM cells),
measures AS (SELECT s, sum(CASE WHEN dim % 2 = 0 THEN 1 ELSE -1 END) AS euler,
  0.5 * (sum(CAST(dim = 1 AS INT)) - 2 * sum(CAST(dim = 2 AS INT)) + 3 * sum(CAST(dim = 3 AS INT))) AS breadth,
  sum(CASE WHEN touch >= 1 THEN CASE WHEN dim % 2 = 0 THEN 1 ELSE -1 END ELSE 0 END) / 2.0
  + sum(CASE WHEN touch >= 2 THEN CASE WHEN dim % 2 = 0 THEN 1 ELSE -1 END ELSE 0 END) / 4.0
  + sum(CASE WHEN touch >= 3 THEN CASE WHEN dim % 2 = 0 THEN 1 ELSE -1 END ELSE 0 END) / 8.0 AS correction FROM signed GROUP BY s)"""


def _edt(selected: str) -> str:
    """Squared distances of the voxels where ``selected`` holds, by three min-plus passes."""
    return f"""
f0 AS (SELECT s, x, y, z, CASE WHEN {selected} THEN 1000000 ELSE 0 END AS f FROM grid),
f1 AS (SELECT a.s, a.x, a.y, a.z, min(b.f + (a.x - b.x) * (a.x - b.x)) AS f FROM f0 a JOIN f0 b ON a.s = b.s AND a.y = b.y AND a.z = b.z GROUP BY ALL),
f2 AS (SELECT a.s, a.x, a.y, a.z, min(b.f + (a.y - b.y) * (a.y - b.y)) AS f FROM f1 a JOIN f1 b ON a.s = b.s AND a.x = b.x AND a.z = b.z GROUP BY ALL),
edt AS (SELECT a.s, a.x, a.y, a.z, CAST(min(b.f + (a.z - b.z) * (a.z - b.z)) AS INT) AS d2 FROM f2 a JOIN f2 b ON a.s = b.s AND a.x = b.x AND a.y = b.y GROUP BY ALL)"""


_LIMITS = """
lat AS (SELECT a.i AS i, b.i AS j, c.i AS k FROM range(0, 13) a(i), range(0, 13) b(i), range(0, 13) c(i)),
limits AS (SELECT CAST(r2.i AS INT) AS r2, CAST(max((lat.i + 1) * (lat.i + 1) + j * j + k * k) AS INT) AS t1,
  CAST(max((lat.i + 1) * (lat.i + 1) + (j + 1) * (j + 1) + k * k) AS INT) AS t2,
  CAST(max((lat.i + 1) * (lat.i + 1) + (j + 1) * (j + 1) + (k + 1) * (k + 1)) AS INT) AS t3
  FROM range(1, 145) r2(i) JOIN lat ON lat.i * lat.i + j * j + k * k <= r2.i GROUP BY r2.i)"""
_RIDGE = """
ridge AS (SELECT e.s, e.x, e.y, e.z, e.d2 FROM edt e WHERE e.d2 > 0 AND NOT EXISTS (
  SELECT 1 FROM n26, edt q, limits l WHERE q.s = e.s AND q.x = e.x + dx AND q.y = e.y + dy AND q.z = e.z + dz AND l.r2 = e.d2
  AND q.d2 >= CASE abs(dx) + abs(dy) + abs(dz) WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END))"""
_RIDGE_JOIN = """
blocked AS (SELECT DISTINCT e.s, e.x, e.y, e.z FROM (SELECT edt.*, n26.*, CASE abs(dx) + abs(dy) + abs(dz) WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END AS need
    FROM edt JOIN limits l ON l.r2 = edt.d2 CROSS JOIN n26 WHERE edt.d2 > 0) e
  JOIN edt q ON q.s = e.s AND q.x = e.x + e.dx AND q.y = e.y + e.dy AND q.z = e.z + e.dz WHERE q.d2 >= e.need),
ridge AS (SELECT e.s, e.x, e.y, e.z, e.d2 FROM edt e LEFT JOIN blocked b ON b.s = e.s AND b.x = e.x AND b.y = e.y AND b.z = e.z WHERE e.d2 > 0 AND b.s IS NULL)"""
_BALLS = """
o12 AS (SELECT CAST(i AS INT) AS d FROM range(-12, 13) t(i)),
sphere AS (SELECT a.d AS dx, b.d AS dy, c.d AS dz, a.d * a.d + b.d * b.d + c.d * c.d AS n FROM o12 a, o12 b, o12 c WHERE a.d * a.d + b.d * b.d + c.d * c.d <= 144),
cover AS (SELECT s, x + dx AS x, y + dy AS y, z + dz AS z, max(d2) AS r2 FROM ridge JOIN sphere ON n <= d2
  WHERE x + dx BETWEEN 0 AND 23 AND y + dy BETWEEN 0 AND 23 AND z + dz BETWEEN 0 AND 23 GROUP BY ALL)"""
_THICK = """
raw AS (SELECT grid.s, grid.x, grid.y, grid.z, {want} AS want, CAST(2 AS FLOAT) * CAST(sqrt(CAST(coalesce(r2, 0) AS DOUBLE)) AS FLOAT) AS t FROM grid LEFT JOIN cover USING (s, x, y, z)),
shift AS (SELECT s, x, y, z, x + dx AS px, y + dy AS py, z + dz AS pz FROM raw CROSS JOIN n26 WHERE t > 0),
surf AS (SELECT e.s, e.x, e.y, e.z, max(CAST(b.t = 0 AS INT)) AS surface FROM shift e JOIN raw b ON b.s = e.s AND b.x = e.px AND b.y = e.py AND b.z = e.pz GROUP BY ALL),
marked AS (SELECT raw.*, coalesce(surface, 0) AS surface FROM raw LEFT JOIN surf USING (s, x, y, z)),
inner_ AS (SELECT s, x, y, z, t FROM marked WHERE t > 0 AND surface = 0),
outer_ AS (SELECT shift.* FROM shift JOIN marked USING (s, x, y, z) WHERE surface = 1),
repl AS (SELECT e.s, e.x, e.y, e.z, avg(CAST(b.t AS DOUBLE)) AS m FROM outer_ e JOIN inner_ b ON b.s = e.s AND b.x = e.px AND b.y = e.py AND b.z = e.pz GROUP BY ALL),
clean AS (SELECT marked.s, x, y, z, want, CAST(coalesce(m, t) AS FLOAT) AS t FROM marked LEFT JOIN repl USING (s, x, y, z)),
scaled AS (SELECT s, t, CAST(t * CAST(25 AS FLOAT) AS DOUBLE) AS v FROM clean WHERE want AND t > 0)"""


def _with(*parts: str, select: str, recursive: bool = False) -> str:
    # every part is computed once, however often it is named
    parts = tuple(re.sub(r"^(\s*|.*?\),\n?\s*)(\w+) AS \(", r"\1\2 AS MATERIALIZED (", p, flags=re.M) for p in parts)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(p.strip() for p in parts) + "\n" + select


_CASES = """
corner AS (SELECT CAST(a.i AS INT) AS ux, CAST(b.i AS INT) AS uy, CAST(c.i AS INT) AS uz, CAST(a.i + 2 * b.i + 4 * c.i AS INT) AS bit FROM range(2) a(i), range(2) b(i), range(2) c(i)),
cubes AS (SELECT s, x - ux AS x, y - uy AS y, z - uz AS z, 255 - sum(1 << bit) AS c FROM bone, corner GROUP BY ALL)"""
_TH_STATS = "SELECT s AS specimen, round(avg(v), 3) AS mean, round(coalesce(stddev_samp(v), 0), 3) AS sd, round(max(v), 3) AS max FROM scaled GROUP BY s"
_TH_Q = "SELECT s AS specimen, {} FROM scaled GROUP BY s".format(", ".join(f"round(quantile_cont(CAST(t AS DOUBLE), {q}) * 25, 3) AS {n}" for q, n in ((0.1, "p10"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.9, "p90"))))

_SMOOTH = (
    _BASE, _GRID.replace("LEFT JOIN bone ON bone.s", "LEFT JOIN solid bone ON bone.s"), _edt("bone"), _edt("NOT bone").replace("f0", "h0").replace("f1", "h1").replace("f2", "h2").replace("edt", "edu"),
    "raww AS (SELECT CAST(i AS INT) AS k, exp(-0.5 * power(i / 1.2, 2)) AS v FROM range(-5, 6) t(i))", "w AS (SELECT k, v / (SELECT sum(v) FROM raww) AS v FROM raww)",
    "phi AS (SELECT s, x, y, z, 25.0 * (sqrt(edt.d2) - sqrt(edu.d2)) AS v FROM edt JOIN edu USING (s, x, y, z))",
    "e1 AS (SELECT s, x, y, z, least(greatest(x + k, 0), 23) AS q, w.v AS w FROM phi CROSS JOIN w)", "s1 AS (SELECT e.s, e.x, e.y, e.z, sum(w * v) AS v FROM e1 e JOIN phi ON phi.s = e.s AND phi.x = e.q AND phi.y = e.y AND phi.z = e.z GROUP BY ALL)",
    "e2 AS (SELECT s, x, y, z, least(greatest(y + k, 0), 23) AS q, w.v AS w FROM phi CROSS JOIN w)", "s2 AS (SELECT e.s, e.x, e.y, e.z, sum(w * v) AS v FROM e2 e JOIN s1 ON s1.s = e.s AND s1.y = e.q AND s1.x = e.x AND s1.z = e.z GROUP BY ALL)",
    "e3 AS (SELECT s, x, y, z, least(greatest(z + k, 0), 23) AS q, w.v AS w FROM phi CROSS JOIN w)", "s3 AS (SELECT e.s, e.x, e.y, e.z, sum(w * v) AS v FROM e3 e JOIN s2 ON s2.s = e.s AND s2.z = e.q AND s2.x = e.x AND s2.y = e.y GROUP BY ALL)",
)
_BETTI = (
    "runs AS (SELECT s, y, z, min(x) AS lo, max(x) AS hi, row_number() OVER () AS id FROM (SELECT *, x - row_number() OVER (PARTITION BY s, y, z ORDER BY x) AS k FROM bone) GROUP BY s, y, z, k)",
    "touch AS (SELECT a.id AS a, b.id AS b FROM runs a JOIN runs b ON a.s = b.s AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 AND a.lo <= b.hi + 1 AND b.lo <= a.hi + 1 AND a.id <> b.id)",
    "reach(id, root) AS (SELECT id, id FROM runs UNION SELECT touch.b, root FROM reach JOIN touch ON touch.a = reach.id WHERE touch.b > root)",
    "b0 AS (SELECT s, count(*) AS b0 FROM runs WHERE id NOT IN (SELECT id FROM reach WHERE root < id) GROUP BY s)",
    "void AS (SELECT s, y, z, min(x) AS lo, max(x) AS hi, row_number() OVER () AS id FROM (SELECT *, x - row_number() OVER (PARTITION BY s, y, z ORDER BY x) AS k FROM (SELECT sp.s, a.i AS x, b.i AS y, c.i AS z FROM sp, g a, g b, g c EXCEPT SELECT s, x, y, z FROM bone)) GROUP BY s, y, z, k)",
    "vtouch AS (SELECT a.id AS a, b.id AS b FROM void a JOIN void b ON a.s = b.s AND abs(a.y - b.y) + abs(a.z - b.z) = 1 AND a.lo <= b.hi AND b.lo <= a.hi)",
    "outer_(id) AS (SELECT id FROM void WHERE lo = 0 OR hi = 23 OR y IN (0, 23) OR z IN (0, 23) UNION SELECT vtouch.b FROM outer_ JOIN vtouch ON vtouch.a = outer_.id)",
    "inner_ AS (SELECT * FROM void WHERE id NOT IN (SELECT id FROM outer_))",
    "vreach(id, root) AS (SELECT id, id FROM inner_ UNION SELECT vtouch.b, root FROM vreach JOIN vtouch ON vtouch.a = vreach.id WHERE vtouch.b > root)",
    "b2 AS (SELECT s, count(*) AS b2 FROM inner_ WHERE id NOT IN (SELECT id FROM vreach WHERE root < id) GROUP BY s)",
)
#: Runs of one component on the lowest and on the highest layer with bone.
_SPANS = """
rooted AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
span AS (SELECT s, max(CAST(low AND high AS INT)) = 1 AS spans FROM (SELECT s, root, max(CAST(z = lo_z AS INT)) = 1 AS low, max(CAST(z = hi_z AS INT)) = 1 AS high, min(lo_z) < min(hi_z) AS layers
  FROM runs JOIN rooted USING (id) JOIN (SELECT s, min(z) AS lo_z, max(z) AS hi_z FROM runs GROUP BY s) USING (s) GROUP BY s, root) WHERE layers GROUP BY s)"""


def _distribution(source: str) -> str:
    cut = {n: f"quantile_cont(CAST(t AS DOUBLE), {q}) * 25" for q, n in ((0.1, "p10"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.9, "p90"))}
    shown = ", ".join(f"round({c}, 3) AS {n}" for n, c in cut.items())
    return f"SELECT s AS specimen, round(avg(v), 3) AS mean, round(coalesce(stddev_samp(v), 0), 3) AS sd, round(max(v), 3) AS max, {shown}, round({cut['p75']} - {cut['p25']}, 2) AS iqr, round(coalesce(stddev_samp(v), 0) / avg(v), 5) AS cv, 'OK' AS status, CAST(NULL AS VARCHAR) AS error FROM {source} GROUP BY s"


ORACLES: dict[str, str] = {
    "bv_tv": _with(_BASE, select="SELECT s AS specimen, count(*) AS bone_voxels, CAST(9216 AS BIGINT) AS tv_voxels, round(count(*) / 9216.0, 9) AS bv_tv FROM bone GROUP BY s"),
    "phase_inside": _with(_BASE, select="SELECT s AS specimen, count(*) AS solid, count(disc.x) AS inside, 9216 - count(disc.x) AS marrow FROM solid LEFT JOIN disc USING (x, y) GROUP BY s"),
    "neighbours6": _with(_BASE, _D3, "moved AS (SELECT s, dx, dy, dz, x + dx AS px, y + dy AS py, z + dz AS pz FROM bone CROSS JOIN n6)", select="SELECT m.s AS specimen, dx, dy, dz, count(*) AS pairs FROM moved m JOIN bone b ON b.s = m.s AND b.x = px AND b.y = py AND b.z = pz GROUP BY ALL"),
    "degree26": _with(_BASE, _D3, select="SELECT specimen, degree, count(*) AS voxels FROM (SELECT a.s AS specimen, a.x, a.y, a.z, count(b.s) AS degree FROM bone a CROSS JOIN n26 LEFT JOIN bone b ON b.s = a.s AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL) GROUP BY ALL"),
    "roi_boundary_fraction": _with(_BASE, _D3, select="SELECT s AS specimen, round(sum(edge) / count(*), 9) AS boundary_fraction FROM (SELECT a.s, a.x, a.y, a.z, max(CAST(disc.x IS NULL OR a.z + dz NOT BETWEEN 0 AND 23 AS INT)) AS edge FROM bone a CROSS JOIN n6 LEFT JOIN disc ON disc.x = a.x + dx AND disc.y = a.y + dy GROUP BY ALL) GROUP BY s"),
    "interface_faces": _with(_BASE, _D3, select="SELECT a.s AS specimen, count(*) AS faces, count(*) * 625.0 AS bs FROM bone a CROSS JOIN n6 JOIN disc ON disc.x = a.x + dx AND disc.y = a.y + dy LEFT JOIN bone b ON b.s = a.s AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE b.s IS NULL AND a.z + dz BETWEEN 0 AND 23 GROUP BY a.s"),
    "euler_chi": _with(_BASE, _CELLS, select="SELECT s AS specimen, CAST(euler AS BIGINT) AS euler FROM measures"),
    "mean_breadth": _with(_BASE, _CELLS, select="SELECT s AS specimen, round(breadth * 25, 6) AS breadth FROM measures"),
    "edge_correction": _with(_BASE, _CELLS, select="SELECT s AS specimen, round(correction, 6) AS edge_correction, round(euler - correction, 6) AS delta_chi, round(1 - (euler - correction), 6) AS connectivity FROM measures"),
    "conn_density": _with(_BASE, _CELLS, select="SELECT s AS specimen, round((1 - (euler - correction)) / 9216.0, 9) AS conn_per_voxel FROM measures"),
    "betti": _with(_BASE, _CELLS, *_BETTI, select="SELECT s AS specimen, b0, CAST(b0 + coalesce(b2, 0) - euler AS BIGINT) AS b1, coalesce(b2, 0) AS b2 FROM b0 JOIN measures USING (s) LEFT JOIN b2 USING (s)", recursive=True),
    "edt_squared": _with(_BASE, _GRID, _edt("bone"), select="SELECT s AS specimen, CAST(d2 AS BIGINT) AS d2, count(*) AS n FROM edt WHERE d2 > 0 GROUP BY ALL"),
    "ridge_templates": _with(_LIMITS, select="SELECT * FROM limits WHERE r2 <= 100"),
    "distance_ridge": _with(_BASE, _GRID, _D3, _LIMITS, _edt("bone"), _RIDGE_JOIN, select="SELECT s AS specimen, CAST(d2 AS BIGINT) AS d2, count(*) AS n FROM ridge GROUP BY ALL"),
    "ridge_ball": _with(_BASE, _GRID, _D3, _LIMITS, _edt("bone"), _RIDGE_JOIN, _BALLS, select="SELECT s AS specimen, CAST(r2 AS BIGINT) AS d2, count(*) AS n FROM cover GROUP BY ALL"),
    "tb_th": _with(_BASE, _GRID, _D3, _LIMITS, _edt("bone"), _RIDGE_JOIN, _BALLS, _THICK.format(want="bone"), select=_TH_STATS),
    "tb_sp": _with(_BASE, _GRID, _D3, _LIMITS, "inside AS (SELECT grid.*, disc.x IS NOT NULL AS roi FROM grid LEFT JOIN disc USING (x, y))", _edt("roi AND NOT bone").replace("FROM grid", "FROM inside"), _RIDGE_JOIN, _BALLS, _THICK.format(want="roi AND NOT bone").replace("FROM grid LEFT JOIN cover", "FROM inside AS grid LEFT JOIN cover"), select=_TH_STATS),
    "thickness_quantiles": _with(_BASE, _GRID, _D3, _LIMITS, _edt("bone"), _RIDGE_JOIN, _BALLS, _THICK.format(want="bone"), select=_TH_Q),
    "mesh_surface_area": _with(_BASE, _CASES, oracle_surfaces.CASE_SQL, oracle_surfaces.areas("foreground"), select="SELECT s AS specimen, round(sum(a) * 625, 3) AS area FROM cubes JOIN areas USING (c) GROUP BY s", recursive=True),
    "midpoint_mesh": _with(_BASE, _CASES, oracle_surfaces.CASE_SQL, oracle_surfaces.areas("middle"), select="SELECT s AS specimen, round(sum(a) * 625, 3) AS area FROM cubes JOIN areas USING (c) GROUP BY s", recursive=True),
    "surface_cases": _with(_BASE, _CASES, select='SELECT s AS specimen, CAST(c AS INT) AS "case", count(*) AS n FROM cubes WHERE c > 0 GROUP BY ALL'),
    "sdf": _with(
        _BASE, _GRID.replace("LEFT JOIN bone ON bone.s", "LEFT JOIN solid bone ON bone.s"), _edt("bone"),
        _edt("NOT bone").replace("f0", "h0").replace("f1", "h1").replace("f2", "h2").replace("edt", "edu"),
        select="SELECT s AS specimen, count(*) AS n, round(max(sqrt(edt.d2)) * 25, 6) AS high, round(max(sqrt(edu.d2)) * -25, 6) AS low, round((sum(sqrt(edt.d2)) - sum(sqrt(edu.d2))) * 25, 3) AS total, sum(edt.d2 + edu.d2) * 625.0 AS squares FROM edt JOIN edu USING (s, x, y, z) GROUP BY s",
    ),
    "euler_lut": """WITH c AS (SELECT CAST(2 * i + 1 AS INT) AS config FROM range(128) t(i)), b AS (SELECT config, (config >> 1) & 1 AS a, (config >> 2) & 1 AS b, (config >> 3) & 1 AS ab, (config >> 4) & 1 AS c, (config >> 5) & 1 AS ac, (config >> 6) & 1 AS bc, (config >> 7) & 1 AS abc FROM c)
SELECT config, CAST(8 * CAST(config = 1 AS INT) - 4 * (CAST(a + b + ab = 0 AS INT) + CAST(a + c + ac = 0 AS INT) + CAST(b + c + bc = 0 AS INT)) + 2 * (3 - a - b - c) - 1 AS INT) AS contribution FROM b""",
    "window_moments": _with(_BASE, select="SELECT balls.s AS specimen, ball AS seed, count(*) AS n, CAST(sum(x) AS BIGINT) AS mx, CAST(sum(y) AS BIGINT) AS my, CAST(sum(z) AS BIGINT) AS mz, CAST(sum(x * x) AS BIGINT) AS mxx, CAST(sum(y * y) AS BIGINT) AS myy, CAST(sum(z * z) AS BIGINT) AS mzz, CAST(sum(x * y) AS BIGINT) AS mxy, CAST(sum(x * z) AS BIGINT) AS mxz, CAST(sum(y * z) AS BIGINT) AS myz FROM balls JOIN bone ON bone.s = balls.s AND abs(x - cx) <= 4 AND abs(y - cy) <= 4 AND abs(z - cz) <= 4 GROUP BY ALL"),
    "grid_representatives": _with(_BASE, "p AS (SELECT s, x, y, z, floor((x + 0.5) / 4) AS a, floor((y + 0.5) / 4) AS b, floor((z + 0.5) / 4) AS c FROM bone)", select="SELECT s AS specimen, x, y, z FROM p QUALIFY row_number() OVER (PARTITION BY s, a, b, c ORDER BY power((x + 0.5) / 4 - a - 0.5, 2) + power((y + 0.5) / 4 - b - 0.5, 2) + power((z + 0.5) / 4 - c - 0.5, 2), z, y, x) = 1"),
    "misorientation": _with(
        _BASE, "v AS (SELECT s, ball, cx AS x, cy AS y, cz AS z, cx - 11.5 AS ux, cy - 11.5 AS uy, cz - 11.5 AS uz FROM balls)", "a AS (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS n FROM v)",
        select="SELECT specimen, round(avg(m), 3) AS misorientation, count(*) AS centers FROM (SELECT p.s AS specimen, p.ball, avg(degrees(acos(least(abs(p.ux * q.ux + p.uy * q.uy + p.uz * q.uz) / (p.n * q.n), 1)))) AS m FROM a p JOIN a q ON p.s = q.s AND p.ball <> q.ball AND power(p.x - q.x, 2) + power(p.y - q.y, 2) + power(p.z - q.z, 2) <= 64 GROUP BY ALL) GROUP BY specimen",
    ),
    "orthogonality": _with(
        _BASE, "v AS (SELECT s, ball, r, cx AS x, cy AS y, cz AS z, cx - 11.5 AS ux, cy - 11.5 AS uy, cz - 11.5 AS uz FROM balls)", "a AS (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS n FROM v)",
        "pair AS (SELECT p.s, p.ball AS pb, q.ball AS qb, degrees(asin(least(abs(p.ux * q.ux + p.uy * q.uy + p.uz * q.uz) / (p.n * q.n), 1))) AS m FROM a p JOIN a q ON p.s = q.s AND p.r = 2 AND q.r > 2 AND power(p.x - q.x, 2) + power(p.y - q.y, 2) + power(p.z - q.z, 2) <= 64)",
        select="SELECT s AS specimen, round(0.5 * (a.m + b.m), 3) AS deviation FROM (SELECT s, avg(m) AS m FROM (SELECT s, pb, avg(m) AS m FROM pair GROUP BY ALL) GROUP BY s) a JOIN (SELECT s, avg(m) AS m FROM (SELECT s, qb, avg(m) AS m FROM pair GROUP BY ALL) GROUP BY s) b USING (s)",
    ),
    "da_domain": "WITH g AS (SELECT CAST(i AS INT) AS i FROM range(24) t(i)), bad AS (SELECT a.i AS x, b.i AS y FROM g a, g b WHERE (2 * a.i - 23) * (2 * a.i - 23) + (2 * b.i - 23) * (2 * b.i - 23) > 484), sides AS (SELECT i + 1 AS side, (24 - (i + 1)) // 2 AS x0 FROM g) SELECT CAST(max(side) AS INT) AS side FROM sides WHERE NOT EXISTS (SELECT 1 FROM bad WHERE x >= x0 AND x < x0 + side AND y >= x0 AND y < x0 + side)",
    "weighted_quantile": """WITH v AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) / sum(w) OVER (PARTITION BY l_returnflag) AS share FROM v), p AS (SELECT *, lag(v) OVER (PARTITION BY l_returnflag ORDER BY v) AS v0, lag(share) OVER (PARTITION BY l_returnflag ORDER BY v) AS s0 FROM r)
SELECT l_returnflag, q, round(CASE WHEN v0 IS NULL THEN v ELSE v0 + (v - v0) * (q - s0) / (share - s0) END, 4) AS value FROM p, (VALUES (0.1), (0.5), (0.9)) t(q_) , LATERAL (SELECT CAST(q_ AS DOUBLE) AS q) WHERE share >= q AND coalesce(s0, -1) < q""",
    "gini": "SELECT o_orderpriority, count(*) AS n, round(2 * sum(rn * o_totalprice) / (count(*) * sum(o_totalprice)) - (count(*) + 1.0) / count(*), 9) AS gini FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rn FROM orders) GROUP BY o_orderpriority",
    "rep_summary": "SELECT l_suppkey, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(coalesce(stddev_samp(l_extendedprice), 0), 4) AS sd, round(abs(coalesce(stddev_samp(l_extendedprice), 0) / avg(l_extendedprice)), 6) AS cv, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY l_suppkey",
    "convergence_summary": "SELECT o_orderpriority, count(*) AS runs, count(*) FILTER (WHERE o_orderstatus = 'F') AS ok, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS mean, round(stddev_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS sd, round(abs(stddev_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'F') / avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F')), 6) AS cv, min(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS low, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS high, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = count(*) THEN 'PASS' WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM orders GROUP BY o_orderpriority",
    "collapsed_edges": "SELECT least(a, b) AS u, greatest(a, b) AS v, count(*) AS multiplicity, min(w) AS length, round(sum(CASE WHEN w > 0 THEN 1.0 / w ELSE 0 END), 6) AS conductance FROM (SELECT CAST(l_suppkey % 40 AS INT) AS a, CAST(l_partkey % 40 AS INT) AS b, l_quantity AS w FROM lineitem) WHERE a <> b GROUP BY ALL",
    "curvature_summary": "WITH c AS (SELECT l_linestatus, l_discount - 0.05 AS h, (l_tax - 0.04) * 0.01 AS k, l_quantity AS w FROM lineitem) SELECT l_linestatus, round(sum(w * h) / sum(w), 6) AS h_mean, round(sqrt(greatest(sum(w * h * h) / sum(w) - power(sum(w * h) / sum(w), 2), 0)), 6) AS h_sd, round(sum(w * abs(h)) / sum(w), 6) AS h_abs_mean, round(coalesce(sum(w) FILTER (WHERE k < 0), 0) / sum(w), 6) AS saddle, round(coalesce(sum(w) FILTER (WHERE k >= 0 AND h >= 0), 0) / sum(w), 6) AS convex, round(coalesce(sum(w) FILTER (WHERE k >= 0 AND h < 0), 0) / sum(w), 6) AS concave, round(coalesce(sum(w) FILTER (WHERE h * h - k < 0), 0) / sum(w), 6) AS negative_discriminant FROM c GROUP BY l_linestatus",
    "canonical_axis": _with(_BASE, "v AS (SELECT ball, cx - 11.5 AS x, cy - 11.5 AS y, cz - 11.5 AS z FROM balls)", select="SELECT ball, round(k * x / n, 9) AS x, round(k * y / n, 9) AS y, round(k * z / n, 9) AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n, CASE WHEN z > 0 THEN 1 WHEN z < 0 THEN -1 WHEN y > 0 THEN 1 WHEN y < 0 THEN -1 ELSE sign(x) END AS k FROM v)"),
    "axis_angles": _with(_BASE, "v AS (SELECT ball, cx - 11.5 AS x, cy - 11.5 AS y, cz - 11.5 AS z, CASE WHEN cz > 11.5 THEN 1 ELSE -1 END AS k FROM balls)", "t AS (SELECT ball, atan2(k * y, k * x) AS a, acos(least(abs(z) / sqrt(x * x + y * y + z * z), 1)) AS phi FROM v)", select="SELECT ball, round(CASE WHEN a > pi() / 2 THEN a - pi() WHEN a <= -pi() / 2 THEN a + pi() ELSE a END, 9) AS theta, round(phi, 9) AS phi FROM t"),
    "axis_angle": _with(_BASE, "v AS (SELECT s, ball, cx - 11.5 AS x, cy - 11.5 AS y, cz - 11.5 AS z FROM balls)", "u AS (SELECT s, ball, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM v))", select="SELECT p.ball, round(degrees(acos(least(abs(p.x * q.x + p.y * q.y + p.z * q.z), 1))), 6) AS angle FROM u p JOIN u q ON q.ball = p.ball + 1"),
    "ray_box": _with(_BASE, "v AS (SELECT ball, CAST(cx AS DOUBLE) - 30 AS px, cy + 0.25 AS py, cz + 0.25 AS pz, 1.0 AS dx, (r - 2.5) / 4 AS dy, (r - 3.25) / 4 AS dz FROM balls)", "t AS (SELECT ball, greatest(least((0 - px) / dx, (24 - px) / dx), least((0 - py) / dy, (24 - py) / dy), least((0 - pz) / dz, (24 - pz) / dz)) AS n, least(greatest((0 - px) / dx, (24 - px) / dx), greatest((0 - py) / dy, (24 - py) / dy), greatest((0 - pz) / dz, (24 - pz) / dz)) AS f FROM v)", select="SELECT ball, round(CASE WHEN n <= f AND f >= 0 THEN n END, 9) AS entry, round(CASE WHEN n <= f AND f >= 0 THEN f END, 9) AS leave FROM t"),
    "splitmix64": """WITH s AS (SELECT p_partkey AS seed, (CAST(p_partkey AS UHUGEINT) + 11400714819323198485) % 18446744073709551616 AS z FROM part),
a AS (SELECT seed, (CAST(xor(CAST(z AS UBIGINT), CAST(z AS UBIGINT) >> 30) AS UHUGEINT) * 13787848793156543929) % 18446744073709551616 AS z FROM s),
b AS (SELECT seed, (CAST(xor(CAST(z AS UBIGINT), CAST(z AS UBIGINT) >> 27) AS UHUGEINT) * 10723151780598845931) % 18446744073709551616 AS z FROM a)
SELECT seed, CAST(xor(CAST(z AS UBIGINT), CAST(z AS UBIGINT) >> 31) >> 11 AS BIGINT) AS draw FROM b""",
    "unit_scale": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 0.001 WHEN 1 THEN 1.0 WHEN 2 THEN 1000.0 WHEN 3 THEN 10000.0 WHEN 4 THEN 25400.0 END AS um FROM part",
    "spacing_isotropy": "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'not positive' WHEN p_size % 5 = 0 THEN 'xy differ' WHEN p_size % 3 = 0 THEN 'not isotropic' END AS problem FROM part",
    "spacing_table": "SELECT lower(s_name) AS name, 20.0 + s_suppkey % 6 AS h_um, CAST(NULL AS VARCHAR) AS problem FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT lower(s_name), 20.0 + s_suppkey % 6, 'repeated' FROM supplier WHERE s_suppkey % 5 = 0",
    "spacing_join": "SELECT s_name AS filename, CASE WHEN s_suppkey % 4 <> 0 THEN 20.0 + s_suppkey % 6 END AS h_um FROM supplier",
    "roi_match": "SELECT count(*) FILTER (WHERE s_suppkey % 4 <> 0) AS matched, count(*) FILTER (WHERE s_suppkey % 4 = 0) AS missing FROM supplier",
    "specimen_code": "SELECT s_suppkey, upper(s_name) AS code FROM supplier",
    "input_qc": _with(_BASE, select="SELECT s AS specimen, count(*) AS foreground, 13824 - count(*) AS background, true AS both_phases, CAST(NULL AS VARCHAR) AS warning FROM solid GROUP BY s"),
    "header_names": "SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'BV' WHEN 1 THEN 'TV' WHEN 2 THEN 'BV/TV' WHEN 3 THEN 'Tb.Th Mean' WHEN 4 THEN 'Connectivity density' WHEN 5 THEN 'Euler change/correction' WHEN 6 THEN 'Euler characteristic' END AS name FROM supplier",
    "parity_report": "WITH a AS (SELECT s_suppkey, 'QC' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS code, s_acctbal AS v, CASE WHEN s_suppkey % 10 = 0 THEN s_acctbal + 1 ELSE s_acctbal + 1e-9 END AS w FROM supplier) SELECT code, abs(v - w) <= greatest(1e-8, 1e-7 * greatest(abs(v), abs(w))) AS pass FROM a",
    "parity_differences": "WITH a AS (SELECT s_suppkey, 'QC' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS code, s_acctbal AS v, CASE WHEN s_suppkey % 10 = 0 THEN s_acctbal + 1 ELSE s_acctbal + 1e-9 END AS w FROM supplier) SELECT 'v' AS \"column\", count(*) AS compared, count(*) FILTER (WHERE NOT abs(v - w) <= greatest(1e-8, 1e-7 * greatest(abs(v), abs(w)))) AS mismatches, round(max(abs(v - w)), 9) AS max_abs, round(max(abs(v - w) / greatest(abs(w), 1e-30)), 9) AS max_rel FROM a",
    "gaussian_smooth": _with(*_SMOOTH, select="SELECT s AS specimen, count(*) AS n, round(max(v), 4) AS high, round(min(v), 4) AS low, round(sum(v), 2) AS total FROM s3 GROUP BY s"),
    "orientation_kde": _with(
        _BASE, "v AS (SELECT s, ball, cx - 11.5 AS x, cy - 11.5 AS y, cz - 11.5 AS z, CASE WHEN cz > 11.5 THEN 1 ELSE -1 END AS k FROM balls)", "t AS (SELECT s, ball, atan2(k * y, k * x) AS a, acos(least(abs(z) / sqrt(x * x + y * y + z * z), 1)) AS phi FROM v)",
        "m AS (SELECT s, ball, CASE WHEN a > pi() / 2 THEN a - pi() WHEN a <= -pi() / 2 THEN a + pi() ELSE a END AS theta, phi FROM t)", "size AS (SELECT s, count(*) AS n FROM m GROUP BY s)",
        "gt AS (SELECT CAST(i AS INT) AS i, radians(5.0 * i) - pi() / 2 AS g FROM range(37) t(i))", "gp AS (SELECT CAST(i AS INT) AS j, radians(5.0 * i) AS g FROM range(19) t(i))",
        "tv AS (SELECT i, s, ball, exp(-0.5 * power((g - theta) / radians(4.5), 2)) + exp(-0.5 * power((g + pi() + theta) / radians(4.5), 2)) + exp(-0.5 * power((g - pi() + theta) / radians(4.5), 2)) AS a FROM gt, m)",
        "pv AS (SELECT j, s, ball, exp(-0.5 * power((g - phi) / radians(4.5), 2)) + exp(-0.5 * power((g + phi) / radians(4.5), 2)) + exp(-0.5 * power((g - pi() + phi) / radians(4.5), 2)) AS b FROM gp, m)",
        select="SELECT s AS specimen, i, j, round(d / (2 * pi() * power(radians(4.5), 2) * n), 6) AS pdf FROM (SELECT s, i, j, sum(a * b) AS d FROM tv JOIN pv USING (s, ball) GROUP BY s, i, j) JOIN size USING (s)",
    ),
}
_TH_PARTS = (_BASE, _GRID, _D3, _LIMITS, _edt("bone"), _RIDGE_JOIN, _BALLS, _THICK.format(want="bone"))
_SP_PARTS = (_BASE, _GRID, _D3, _LIMITS, "inside AS (SELECT grid.*, disc.x IS NOT NULL AS roi FROM grid LEFT JOIN disc USING (x, y))", _edt("roi AND NOT bone").replace("FROM grid", "FROM inside"), _RIDGE_JOIN, _BALLS, _THICK.format(want="roi AND NOT bone").replace("FROM grid LEFT JOIN cover", "FROM inside AS grid LEFT JOIN cover"))
_RAW = "raw AS (SELECT cover.s, CAST(2 AS FLOAT) * CAST(sqrt(CAST(r2 AS DOUBLE)) AS FLOAT) AS t FROM cover JOIN bone USING (s, x, y, z)), rawscaled AS (SELECT s, t, CAST(t * CAST(25 AS FLOAT) AS DOUBLE) AS v FROM raw)"
ORACLES |= {
    "thickness_clean": _with(*_TH_PARTS, select=_distribution("scaled")),
    "thickness_stats": _with(*_SP_PARTS, select=_distribution("scaled")),
    "thickness_raw": _with(*_TH_PARTS[:-1], _RAW, select=_distribution("rawscaled")),
    "spanning": _with(_BASE, _CELLS, *_BETTI, _SPANS, select="SELECT sp.s AS specimen, coalesce(spans, false) AS spans FROM sp LEFT JOIN span USING (s)", recursive=True),
    "betti_density": _with(_BASE, _CELLS, *_BETTI, _SPANS, select="SELECT s AS specimen, b0 / 144000000.0 AS b0_density, (b0 + coalesce(b2, 0) - euler) / 144000000.0 AS b1_density, coalesce(b2, 0) / 144000000.0 AS b2_density, coalesce(spans, false) AS spans FROM b0 JOIN measures USING (s) LEFT JOIN b2 USING (s) LEFT JOIN span USING (s)", recursive=True),
    "skeleton_topology": "SELECT specimen, b1, b2 FROM (" + ORACLES["betti"] + ")",
    "isosurface": _with(*_SMOOTH, oracle_surfaces.CASE_SQL, oracle_surfaces.LEVEL_SQL, select="SELECT s AS specimen, vertices, triangles, round(area, 2) AS area, round(area, 2) AS vertex_area, round(volume, 0) AS volume FROM surface JOIN points USING (s)", recursive=True),
    "vertex_area": _with(*_SMOOTH, oracle_surfaces.CASE_SQL, oracle_surfaces.LEVEL_SQL, select="SELECT s AS specimen, round(area, 2) AS area, round(area, 2) AS vertex_area FROM surface", recursive=True),
    "curvature_grid": _with(*_SMOOTH, oracle_surfaces.CURVATURE_SQL, select="SELECT s AS specimen, count(*) AS n, round(min(h), 6) AS low, round(max(h), 6) AS high, round(sum(h), 4) AS total, round(sum(h * h), 4) AS squares FROM curved GROUP BY s"),
    "da_domain": _with(_BASE, select="SELECT sp.s AS specimen, CAST((24 - d.side) // 2 AS INT) AS x0, CAST((24 - d.side) // 2 AS INT) AS y0, d.side FROM sp, (" + ORACLES["da_domain"] + ") d"),
    "window_points": _with(_BASE, select="SELECT balls.s AS specimen, ball AS seed, x, y, z FROM balls JOIN bone ON bone.s = balls.s AND abs(x - cx) <= 4 AND abs(y - cy) <= 4 AND abs(z - cz) <= 4"),
    "tiff_roundtrip": _with(_BASE, select="SELECT s AS specimen, CAST(24 AS BIGINT) AS pages, CAST(8 + 24 * (24 * 24 + 2 * ((length('ImageJ=1.53') + length('unit=um') + length('spacing=25.0') + 4 + 1) // 2) + 4 * 4 + 2 + 13 * 12 + 4) AS BIGINT) AS bytes, 25.0 AS h, true AS same, 'OK' AS status, CAST(NULL AS VARCHAR) AS error FROM sp"),
    "radii_check": _with(_BASE, select="SELECT s AS specimen, CAST(i AS INT) AS rep, true AS agree FROM sp, range(5) t(i)"),
    "eigh3": _with(
        _BASE, "m AS (SELECT balls.s, ball, count(*) AS n, sum(x) AS mx, sum(y) AS my, sum(z) AS mz, sum(x * x) AS xx, sum(y * y) AS yy, sum(z * z) AS zz, sum(x * y) AS xy, sum(x * z) AS xz, sum(y * z) AS yz FROM balls JOIN bone ON bone.s = balls.s AND abs(x - cx) <= 4 AND abs(y - cy) <= 4 AND abs(z - cz) <= 4 GROUP BY ALL HAVING count(*) > 1)",
        "c AS (SELECT s, ball, (n * xx - mx * mx) / (n * (n - 1.0)) AS a, (n * yy - my * my) / (n * (n - 1.0)) AS b, (n * zz - mz * mz) / (n * (n - 1.0)) AS c, (n * xy - mx * my) / (n * (n - 1.0)) AS d, (n * xz - mx * mz) / (n * (n - 1.0)) AS e, (n * yz - my * mz) / (n * (n - 1.0)) AS f FROM m)",
        # the three roots of the characteristic polynomial by cosines
        "q AS (SELECT *, (a + b + c) / 3 AS q, sqrt((power(a - (a + b + c) / 3, 2) + power(b - (a + b + c) / 3, 2) + power(c - (a + b + c) / 3, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM c)",
        "r AS (SELECT *, CASE WHEN p > 0 THEN acos(least(greatest(((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - e * f) + e * (d * f - e * (b - q))) / (2 * p * p * p), -1), 1)) / 3 ELSE 0 END AS phi FROM q)",
        select="SELECT s AS specimen, ball AS seed, round(q + 2 * p * cos(phi + 2 * pi() / 3), 6) AS e1, round(3 * q - (q + 2 * p * cos(phi + 2 * pi() / 3)) - (q + 2 * p * cos(phi)), 6) AS e2, round(q + 2 * p * cos(phi), 6) AS e3 FROM r",
    ),
    "orientation_density": _with(
        _BASE, "v AS (SELECT s, ball, cx - 11.5 AS x, cy - 11.5 AS y, cz - 11.5 AS z, CASE WHEN cz > 11.5 THEN 1 ELSE -1 END AS k FROM balls)", "t AS (SELECT s, ball, atan2(k * y, k * x) AS a, acos(least(abs(z) / sqrt(x * x + y * y + z * z), 1)) AS phi FROM v)",
        "m AS (SELECT s, ball, CASE WHEN a > pi() / 2 THEN a - pi() WHEN a <= -pi() / 2 THEN a + pi() ELSE a END AS theta, phi FROM t)", "size AS (SELECT s, count(*) AS n FROM m GROUP BY s)",
        "gt AS (SELECT CAST(i AS INT) AS i, radians(0.5 * i) - pi() / 2 AS g FROM range(361) t(i))", "gp AS (SELECT CAST(i AS INT) AS j, radians(0.5 * i) AS g FROM range(181) t(i))",
        "tv AS (SELECT i, s, ball, exp(-0.5 * power((g - theta) / radians(4.5), 2)) + exp(-0.5 * power((g + pi() + theta) / radians(4.5), 2)) + exp(-0.5 * power((g - pi() + theta) / radians(4.5), 2)) AS a FROM gt, m)",
        "pv AS (SELECT j, s, ball, exp(-0.5 * power((g - phi) / radians(4.5), 2)) + exp(-0.5 * power((g + phi) / radians(4.5), 2)) + exp(-0.5 * power((g - pi() + phi) / radians(4.5), 2)) AS b FROM gp, m)",
        select="SELECT s AS specimen, i, j, round(d / (2 * pi() * power(radians(4.5), 2) * n), 6) AS pdf FROM (SELECT s, i, j, sum(a * b) AS d FROM tv JOIN pv USING (s, ball) GROUP BY s, i, j) JOIN size USING (s)",
    ),
    "descriptor_catalog": "SELECT * FROM (VALUES ('paper', 'bone volume fraction, thickness, separation, connectivity density, anisotropy'), ('skeleton', 'eight normalised skeleton descriptors'), ('mechanical', 'five axial path and transport descriptors of the skeleton graph'), ('soi', 'structural organisation of plates and rods with its quality counts'), ('orientation', 'three local orientation descriptors'), ('minkowski', 'anisotropy of the surface-normal tensor')) t(family, descriptors)",
} | oracle_figures.ORACLES
#: Parts of the result schemas: volumes and topology, thickness, separation, Betti numbers.
_VOLUMES = _with(_BASE, _CELLS, select="SELECT s AS specimen, n * 15625.0 AS bv, 144000000.0 AS tv, round(n / 9216.0, 9) AS bv_tv, CAST(euler AS BIGINT) AS euler, round(euler - correction, 6) AS delta_chi, round(1 - (euler - correction), 6) AS connectivity, round((1 - (euler - correction)) / 144000000.0, 15) AS conn_density, round(breadth * 25, 6) AS breadth FROM measures JOIN (SELECT s, count(*) AS n FROM bone GROUP BY s) USING (s)")
_FACES = "SELECT specimen, bs, round(bs / (n * 15625.0), 9) AS bs_bv, round(bs / 144000000.0, 9) AS bs_tv FROM (" + ORACLES["interface_faces"] + ") JOIN (" + _with(_BASE, select="SELECT s AS specimen, count(*) AS n FROM bone GROUP BY s") + ") USING (specimen)"
_B = "SELECT specimen, b0, b1, b2, round(b0 / 144000000.0, 15) AS b0_density, round(b1 / 144000000.0, 15) AS b1_density, round(b2 / 144000000.0, 15) AS b2_density FROM (" + ORACLES["betti"] + ")"


def _schema(columns: str) -> str:
    named = lambda p, key: f"SELECT specimen, {', '.join(f'{c} AS {p}_{c}' for c in ('mean', 'sd', 'max', 'p10', 'p25', 'median', 'p75', 'p90', 'iqr', 'cv'))} FROM ({ORACLES[key]})"
    parts = {"v": _VOLUMES, "f": _FACES, "b": _B, "th": named("th", "thickness_clean"), "sp": named("sp", "thickness_stats")}
    return f"SELECT specimen, {columns} FROM " + " JOIN ".join(f"({q}) {n}" if n == "v" else f"({q}) {n} USING (specimen)" for n, q in parts.items())


_SIX = "th_mean, th_sd, th_max, sp_mean, sp_sd, sp_max"
ORACLES |= {
    "schema_bonej": _schema(f"bv, tv, bv_tv, euler, delta_chi, connectivity, conn_density, {_SIX}"),
    "schema_classic": _schema(f"{_SIX}, bv, tv, bv_tv, euler, b1, b1_density"),
    "schema_refined": _schema(f"{_SIX}, bv, tv, bv_tv, euler, b1, b1_density, bs, breadth"),
    "schema_experimental": _schema("bv, tv, bv_tv, th_median, th_p10, th_p90, th_cv, sp_median, sp_p10, sp_p90, sp_cv, b0_density, b1_density, b2_density, bs, bs_bv, bs_tv, breadth"),
}
for _k in ("b0", "b1", "b2"):
    ORACLES["beta" + _k[1]] = f"SELECT specimen, {_k} FROM ({ORACLES['betti']})"
#: Slabs give what whole volumes give.
for _k, _of in (("betti_slabs", "betti"), ("spanning_slabs", "spanning"), ("edt_slabs", "edt_squared"), ("ridge_ball_slabs", "ridge_ball"), ("tb_th_slabs", "tb_th"), ("surface_cases_slabs", "surface_cases"), ("mesh_surface_area_slabs", "mesh_surface_area")):
    ORACLES[_k] = ORACLES[_of]
_SQUARE = intercepts.domain(fixtures.region())
_FEW = (_BASE, oracle_lines._STREAM, oracle_lines.ray_sql((*_SQUARE[:2], 0), (_SQUARE[0] + _SQUARE[2], _SQUARE[1] + _SQUARE[2], fixtures.N), intercepts._diagonal(_SQUARE, fixtures.N)))
ORACLES["mil_points_few"] = _with(*_FEW, select=oracle_lines.SELECT, recursive=True)
ORACLES["quadric_fit_few"] = _with(*_FEW, oracle_lines.QUADRIC, select=oracle_lines.FITS, recursive=True)
ORACLES["degree_of_anisotropy_few"] = _with(*_FEW, oracle_lines.QUADRIC, select=oracle_lines.DEGREES, recursive=True)
