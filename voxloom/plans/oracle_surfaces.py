"""DuckDB SQL of surfaces: the triangles of each lattice case, found in SQL from the faces of a cube.

The rule is that of the engine (segments cut off each run of marked corners along a face, closed
loops of segments are cut into fans from their lowest edge), the way to it is not: faces are literal
corner rings, loops are followed by recursion, and areas come from the coordinates.
"""

from __future__ import annotations

#: Needs recursion. Corner i is (i & 1, i >> 1 & 1, i >> 2 & 1); bit i of a case marks corner i.
CASE_SQL = """
ring(f, k, i) AS (VALUES (0,0,1),(0,1,3),(0,2,7),(0,3,5),(1,0,4),(1,1,6),(1,2,2),(1,3,0),(2,0,2),(2,1,6),(2,2,7),(2,3,3),(3,0,1),(3,1,5),(3,2,4),(3,3,0),(4,0,4),(4,1,5),(4,2,7),(4,3,6),(5,0,2),(5,1,3),(5,2,1),(5,3,0)),
edge AS (SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INT) AS e, a, b FROM (SELECT CAST(p.i AS INT) AS a, CAST(q.i AS INT) AS b FROM range(8) p(i), range(8) q(i) WHERE p.i < q.i AND xor(p.i, q.i) IN (1, 2, 4))),
around AS (SELECT cs, r.f, r.k, e.e, (cs >> r.i) & 1 AS here, (cs >> s.i) & 1 AS there FROM (SELECT CAST(i AS INT) AS cs FROM range(256) t(i)), ring r JOIN ring s ON s.f = r.f AND s.k = (r.k + 1) % 4 JOIN edge e ON e.a = least(r.i, s.i) AND e.b = greatest(r.i, s.i)),
seg AS (SELECT p.cs, p.e AS enter, arg_min(q.e, (q.k - p.k + 4) % 4) AS leave FROM around p JOIN around q ON q.cs = p.cs AND q.f = p.f AND p.here = 0 AND p.there = 1 AND q.here = 1 AND q.there = 0 GROUP BY p.cs, p.f, p.e),
walk(cs, e0, e, n) AS (SELECT cs, enter, enter, 0 FROM seg UNION ALL SELECT w.cs, w.e0, s.leave, w.n + 1 FROM walk w JOIN seg s ON s.cs = w.cs AND s.enter = w.e WHERE s.leave <> w.e0),
lowest AS (SELECT cs, e0 FROM walk GROUP BY cs, e0 HAVING min(e) = e0),
loops AS (SELECT walk.* FROM walk JOIN lowest USING (cs, e0)),
tri AS (SELECT p.cs, p.e0 AS ea, p.e AS eb, q.e AS ec FROM loops p JOIN loops q ON q.cs = p.cs AND q.e0 = p.e0 AND q.n = p.n + 1 AND p.n >= 1)"""


def areas(snap: str) -> str:
    """areas(c, a): triangle area of each case, vertices at the middle of their edges or at their unmarked
    (bone) corners."""
    coordinate = {"middle": "((a >> {k} & 1) + (b >> {k} & 1)) / 2.0", "foreground": "CAST((CASE WHEN (cs >> a) & 1 = 1 THEN b ELSE a END) >> {k} & 1 AS DOUBLE)"}[snap]
    cols = ", ".join(coordinate.format(k=k) + f" AS {c}" for k, c in enumerate("xyz"))
    return f"""
spot AS (SELECT cs, e, {cols} FROM (SELECT CAST(i AS INT) AS cs FROM range(256) t(i)), edge),
side AS (SELECT t.cs, q.x - p.x AS ux, q.y - p.y AS uy, q.z - p.z AS uz, r.x - p.x AS vx, r.y - p.y AS vy, r.z - p.z AS vz FROM tri t JOIN spot p ON p.cs = t.cs AND p.e = ea JOIN spot q ON q.cs = t.cs AND q.e = eb JOIN spot r ON r.cs = t.cs AND r.e = ec),
areas AS (SELECT cs AS c, sum(0.5 * sqrt(power(uy * vz - uz * vy, 2) + power(uz * vx - ux * vz, 2) + power(ux * vy - uy * vx, 2))) AS a FROM side GROUP BY cs)"""


#: Level set of ``s3`` (s, x, y, z, v) inside a border of -25, vertices on lattice edges (x, y, z, axis).
LEVEL_SQL = """
border AS (SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS z FROM range(-1, 25) a(i), range(-1, 25) b(i), range(-1, 25) c(i) WHERE a.i IN (-1, 24) OR b.i IN (-1, 24) OR c.i IN (-1, 24)),
lat AS (SELECT s, x, y, z, v FROM s3 UNION ALL SELECT s, x, y, z, -25.0 FROM sp, border),
corner AS (SELECT CAST(a.i AS INT) AS ux, CAST(b.i AS INT) AS uy, CAST(c.i AS INT) AS uz, CAST(a.i + 2 * b.i + 4 * c.i AS INT) AS bit FROM range(2) a(i), range(2) b(i), range(2) c(i)),
cube AS (SELECT s, x - ux AS x, y - uy AS y, z - uz AS z, CAST(sum(1 << bit) AS INT) AS cs FROM lat, corner WHERE v > 0 AND x - ux BETWEEN -1 AND 23 AND y - uy BETWEEN -1 AND 23 AND z - uz BETWEEN -1 AND 23 GROUP BY ALL),
step3 AS (SELECT * FROM (VALUES (0, 1, 0, 0), (1, 0, 1, 0), (2, 0, 0, 1)) t(axis, sx, sy, sz)),
vertex AS (SELECT p.s, p.x, p.y, p.z, axis, p.x + sx * (0 - p.v) / (q.v - p.v) AS vx, p.y + sy * (0 - p.v) / (q.v - p.v) AS vy, p.z + sz * (0 - p.v) / (q.v - p.v) AS vz
  FROM lat p CROSS JOIN step3 JOIN lat q ON q.s = p.s AND q.x = p.x + sx AND q.y = p.y + sy AND q.z = p.z + sz WHERE (p.v > 0) <> (q.v > 0)),
spot AS (SELECT e, (a & 1) AS ox, (a >> 1) & 1 AS oy, (a >> 2) & 1 AS oz, CASE xor(a, b) WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS axis FROM edge),
face AS (SELECT cube.s, cube.x, cube.y, cube.z, row_number() OVER () AS id, ea, eb, ec FROM cube JOIN tri ON tri.cs = cube.cs),
ends3 AS (SELECT id, s, x, y, z, 0 AS k, ea AS e FROM face UNION ALL SELECT id, s, x, y, z, 1, eb FROM face UNION ALL SELECT id, s, x, y, z, 2, ec FROM face),
placed AS (SELECT f.id, f.s, f.k, 25 * vx AS vx, 25 * vy AS vy, 25 * vz AS vz FROM ends3 f JOIN spot USING (e) JOIN vertex v ON v.s = f.s AND v.x = f.x + ox AND v.y = f.y + oy AND v.z = f.z + oz AND v.axis = spot.axis),
shape AS (SELECT p.id, p.s, p.vx AS px, p.vy AS py, p.vz AS pz, q.vx - p.vx AS ux, q.vy - p.vy AS uy, q.vz - p.vz AS uz, r.vx - p.vx AS wx, r.vy - p.vy AS wy, r.vz - p.vz AS wz FROM placed p JOIN placed q ON q.id = p.id AND p.k = 0 AND q.k = 1 JOIN placed r ON r.id = p.id AND r.k = 2),
sized AS (SELECT s, sqrt(power(uy * wz - uz * wy, 2) + power(uz * wx - ux * wz, 2) + power(ux * wy - uy * wx, 2)) / 2 AS area, (px * (uy * wz - uz * wy) + py * (uz * wx - ux * wz) + pz * (ux * wy - uy * wx)) / 6 AS volume FROM shape),
surface AS (SELECT s, count(*) AS triangles, sum(area) AS area, abs(sum(volume)) AS volume FROM sized GROUP BY s),
points AS (SELECT s, count(*) AS vertices FROM vertex GROUP BY s)"""

#: Mean curvature of ``s3``: half the divergence of the outward unit normal, by central differences.
CURVATURE_SQL = """
slope AS (SELECT s, x, y, z, (lead(v) OVER (PARTITION BY s, y, z ORDER BY x) - lag(v) OVER (PARTITION BY s, y, z ORDER BY x)) / 50 AS gx, (lead(v) OVER (PARTITION BY s, x, z ORDER BY y) - lag(v) OVER (PARTITION BY s, x, z ORDER BY y)) / 50 AS gy, (lead(v) OVER (PARTITION BY s, x, y ORDER BY z) - lag(v) OVER (PARTITION BY s, x, y ORDER BY z)) / 50 AS gz FROM s3),
normal AS (SELECT s, x, y, z, -gx / greatest(sqrt(gx * gx + gy * gy + gz * gz), 2.220446049250313e-16) AS nx, -gy / greatest(sqrt(gx * gx + gy * gy + gz * gz), 2.220446049250313e-16) AS ny, -gz / greatest(sqrt(gx * gx + gy * gy + gz * gz), 2.220446049250313e-16) AS nz FROM slope),
bent AS (SELECT s, x, y, z, 0.5 * ((lead(nx) OVER (PARTITION BY s, y, z ORDER BY x) - lag(nx) OVER (PARTITION BY s, y, z ORDER BY x)) / 50 + (lead(ny) OVER (PARTITION BY s, x, z ORDER BY y) - lag(ny) OVER (PARTITION BY s, x, z ORDER BY y)) / 50 + (lead(nz) OVER (PARTITION BY s, x, y ORDER BY z) - lag(nz) OVER (PARTITION BY s, x, y ORDER BY z)) / 50) AS h FROM normal),
curved AS (SELECT s, h FROM bent WHERE x BETWEEN 2 AND 21 AND y BETWEEN 2 AND 21 AND z BETWEEN 2 AND 21)"""
