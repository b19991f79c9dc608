"""DuckDB SQL of the skeleton queries on figures whose skeletons are known beforehand.

Lines, zigzags and rings are their own skeletons; a line with an arm loses the voxel where the arm
begins, and the arm's next voxel becomes the junction. Degrees, branches and axial descriptors follow
from the figures, not from any walk: branch lengths are closed formulas, axial descriptors the laws of
resistors in series and in parallel.
"""

from __future__ import annotations

import re

_FIGURES = """
part_cell AS (SELECT CAST(floor(p_partkey / 40.0) AS INT) AS s, CAST((p_partkey * 7919 + 13) % 24 AS INT) AS cell, p_partkey AS p, CAST(p_size % 5 AS INT) AS kind FROM part),
fig AS (SELECT s, cell, CAST(6 * (cell % 4) + 1 AS INT) AS x0, CAST(4 * (cell // 4) + 1 AS INT) AS y0, CAST(3 + (p * 104729 + 7) % 18 AS INT) AS z0, kind, CAST(2 + p % 15 AS INT) AS len FROM part_cell QUALIFY row_number() OVER (PARTITION BY s, cell ORDER BY p) = 1),
h24 AS (SELECT CAST(i AS INT) AS z FROM range(24) t(i)),
arm AS (SELECT CAST(i AS INT) AS i FROM range(1, 4) t(i)),
around4(dx, dy) AS (VALUES (0, 0), (1, 1), (2, 0), (1, -1)),
sk AS (SELECT s, cell, x0 AS x, y0 AS y, z FROM fig, h24 WHERE kind = 0 OR (kind = 3 AND z <> z0) OR (kind = 2 AND z BETWEEN 3 AND 2 + len)
  UNION ALL SELECT s, cell, CAST(x0 + z % 2 AS INT), y0, z FROM fig, h24 WHERE kind = 1
  UNION ALL SELECT s, cell, x0 + i, y0, z0 FROM fig, arm WHERE kind = 3
  UNION ALL SELECT s, cell, x0 + dx, y0 + dy, z0 FROM fig, around4 WHERE kind = 4),
nearby AS (SELECT a.s, a.cell, a.x, a.y, a.z, count(b.s) - 1 AS degree FROM sk a JOIN sk b ON b.s = a.s AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 AND abs(b.z - a.z) <= 1 GROUP BY ALL),
lone AS (SELECT s, x, y, z, cell, row_number() OVER (PARTITION BY s ORDER BY z, x, y) - 1 AS node FROM nearby WHERE degree <= 1),
crossing AS (SELECT s, x, y, z, cell, (SELECT count(*) FROM lone WHERE lone.s = j.s) + row_number() OVER (PARTITION BY s ORDER BY z, x, y) - 1 AS node FROM nearby j WHERE degree > 2),
loop4 AS (SELECT s, x0 AS x, y0 AS y, z0 AS z, cell, (SELECT count(*) FROM lone WHERE lone.s = f.s) + (SELECT count(*) FROM crossing WHERE crossing.s = f.s) + row_number() OVER (PARTITION BY s ORDER BY z0, x0, y0) - 1 AS node FROM fig f WHERE kind = 4),
limits AS (SELECT s, min(z) AS lo, max(z) AS hi FROM sk GROUP BY s),
node AS (SELECT s, node, x, y, z, cell, 1 AS voxels FROM lone UNION ALL SELECT s, node, x, y, z, cell, 1 FROM crossing UNION ALL SELECT s, node, x, y, z, cell, 4 FROM loop4),
nodes AS (SELECT node.*, z <= lo + 1 AS top, z >= hi - 1 AS bottom FROM node JOIN limits USING (s)),
branch AS (SELECT s, cell, kind, u.node AS u, v.node AS v, false AS pure, CASE kind WHEN 1 THEN sqrt(2) ELSE 1 END * (v.z - u.z) AS steps, sqrt(power(u.x - v.x, 2) + power(u.y - v.y, 2) + power(u.z - v.z, 2)) AS apart, 0 AS side FROM fig JOIN lone u USING (s, cell) JOIN lone v USING (s, cell) WHERE kind IN (0, 1, 2) AND u.z < v.z
  UNION ALL SELECT s, cell, kind, u.node, v.node, false, CASE WHEN u.z = z0 THEN 2 ELSE abs(u.z - z0) - 1 + sqrt(2) END, sqrt(power(u.x - v.x, 2) + power(u.z - v.z, 2)), CASE WHEN u.z = z0 THEN 2 ELSE 1 END FROM fig JOIN lone u USING (s, cell) JOIN crossing v USING (s, cell) WHERE kind = 3
  UNION ALL SELECT s, cell, kind, u.node, u.node, true, 3 * sqrt(2), 0, 0 FROM fig JOIN loop4 u USING (s, cell) WHERE kind = 4),
branches AS (SELECT *, 25 * steps AS length, 25 * apart AS distance, row_number() OVER (PARTITION BY s ORDER BY pure, u) - 1 AS edge FROM branch),
way AS (SELECT s, cell, sum(length) AS length FROM branches WHERE kind IN (0, 1) OR (kind = 3 AND side = 1) GROUP BY s, cell),
loss AS (SELECT s, CASE WHEN kind IN (0, 1) OR (kind = 3 AND side = 1) THEN branches.length / power(way.length, 2) ELSE 0 END AS p FROM branches LEFT JOIN way USING (s, cell)),
spread AS (SELECT s, 2 * sum(rn * p) / (count(*) * sum(p)) - (count(*) + 1.0) / count(*) AS gini FROM (SELECT s, p, row_number() OVER (PARTITION BY s ORDER BY p) AS rn FROM loss) GROUP BY s),
axial AS (SELECT w.s, min(w.length) / (23 * 25) AS tortuosity, sum(w.length) / (SELECT sum(length) FROM branches b WHERE b.s = w.s) AS fraction, sum(23 * 25 / w.length) AS conductance, count(*) AS ways FROM way w GROUP BY w.s),
ends_of AS (SELECT s, CAST(count(*) FILTER (WHERE top) AS BIGINT) AS n_top, CAST(count(*) FILTER (WHERE bottom) AS BIGINT) AS n_bottom, count(*) FILTER (WHERE top AND bottom) AS "both" FROM nodes GROUP BY s),
voxel AS (SELECT s, count(*) AS n, count(*) FILTER (WHERE degree <= 1) AS ends, count(*) FILTER (WHERE degree = 2) AS slabs, count(*) FILTER (WHERE degree > 2) AS crossings FROM nearby GROUP BY s),
figures AS (SELECT s, count(*) AS pieces, count(*) FILTER (WHERE kind = 4) AS rings, count(*) FILTER (WHERE kind = 3) AS arms, bool_or(kind IN (0, 1, 3)) AS spans FROM fig GROUP BY s),
summary AS (SELECT s, count(*) AS branches, avg(length) AS mean_length, max(length) AS max_length, avg(CASE WHEN distance > 0 THEN length / distance END) AS mean_tortuosity FROM branches GROUP BY s)"""
_FIGURES = re.sub(r"^(\w+) AS \(", r"\1 AS MATERIALIZED (", _FIGURES, flags=re.M)
_OK = "'OK' AS status, CAST(NULL AS VARCHAR) AS error"


def _on(select: str) -> str:
    return "WITH " + _FIGURES.strip() + "\n" + select


_SUMMARY = "branches, round(mean_length, 6) AS mean_length, round(max_length, 6) AS max_length, round(mean_tortuosity, 9) AS mean_tortuosity"
_TV = "(13824 * 15625.0 * 1e-9)"
ORACLES: dict[str, str] = {
    "skeleton": _on(f"SELECT s AS specimen, n + arms AS bone_voxels, n AS skeleton_voxels, ends AS endpoint_voxels, slabs AS slab_voxels, crossings AS junction_voxels, pieces AS b0, rings AS b1, CAST(0 AS BIGINT) AS b2, {_OK} FROM voxel JOIN figures USING (s)"),
    "skeleton_degree": _on("SELECT s AS specimen, CAST(degree AS INT) AS degree, count(*) AS voxels FROM nearby GROUP BY s, degree"),
    "junction_clusters": _on("SELECT s AS specimen, crossings AS junction_voxels, arms AS junction_clusters FROM voxel JOIN figures USING (s)"),
    "graph_edges": _on(f"SELECT s AS specimen, CAST(edge AS INT) AS edge, CAST(u AS INT) AS u, CAST(v AS INT) AS v, round(length, 6) AS length, pure AS pure_cycle, round(distance, 6) AS distance, {_OK} FROM branches"),
    "compressed_graph": _on(f"SELECT s AS specimen, CAST(node AS INT) AS node, x, y, z, voxels, top, bottom, {_OK} FROM nodes"),
    "graph_stats": _on(f"SELECT s AS specimen, n AS skeleton_voxels, ends AS endpoint_voxels, slabs AS slab_voxels, crossings AS junction_voxels, arms AS junction_clusters, pieces AS components, rings AS cycle_rank, {_SUMMARY}, spans AS spanning, {_OK} FROM voxel JOIN figures USING (s) JOIN summary USING (s)"),
    "graph_summary": _on(f"SELECT s AS specimen, {_SUMMARY} FROM summary"),
    "skeleton_block": _on(f"SELECT s AS specimen, round(mean_length * branches / 1000 / {_TV}, 6) AS length_density, round(branches / {_TV}, 6) AS branch_density, round(arms / {_TV}, 6) AS junction_density, round(ends / {_TV}, 6) AS endpoint_density, round(rings / {_TV}, 6) AS cycle_density, round(pieces / {_TV}, 6) AS component_density, round(mean_length, 6) AS mean_length, round(mean_tortuosity, 9) AS mean_tortuosity FROM voxel JOIN figures USING (s) JOIN summary USING (s)"),
    "terminals": _on('SELECT s AS specimen, n_top AS top, n_bottom AS bottom, "both" FROM ends_of'),
    "axial_graph": _on(f"SELECT s AS specimen, round(tortuosity, 9) AS axial_tortuosity, round(fraction, 9) AS path_fraction, round(conductance, 6) AS conductance, round(gini, 6) AS dissipation_gini, 0.0 AS energy_error, ways AS edge_connectivity, n_top, n_bottom, {_OK} FROM axial JOIN spread USING (s) JOIN ends_of USING (s)"),
    "axial_shortest_path": _on("SELECT s AS specimen, round(tortuosity, 9) AS axial_tortuosity FROM axial"),
    "edge_connectivity": _on("SELECT s AS specimen, ways AS edge_connectivity, n_top, n_bottom FROM axial JOIN ends_of USING (s)"),
    "cz_fraction": _on("SELECT s AS specimen, round(fraction, 9) AS path_fraction FROM axial"),
    "dissipation_gini": _on("SELECT s AS specimen, round(gini, 6) AS dissipation_gini, round(conductance, 6) AS conductance, 0.0 AS energy_error FROM axial JOIN spread USING (s)"),
    "t50": _on("SELECT s AS specimen, 50.0 AS t50, count(DISTINCT (x // 2, y // 2, z // 2)) AS n_grid_representatives FROM sk GROUP BY s"),
}

#: Windows of 9 x 9 x 9 voxels around the skeleton: covariances as whole numbers times 1 / n (n - 1), which cancels in
#: the ratios of axes. Flat windows have determinant 0. The smallest eigenvalue is the determinant over the others;
#: the square of an axis's z is the characteristic polynomial of the xy minor over the differences of eigenvalues.
_WINDOWS = """
solid_ AS MATERIALIZED (SELECT s, x, y, z FROM sk UNION ALL SELECT s, x0, y0, z0 FROM fig WHERE kind = 3),
sums AS (SELECT k.s, k.x, k.y, k.z, count(*) AS n, sum(b.x - k.x) AS sx, sum(b.y - k.y) AS sy, sum(b.z - k.z) AS sz,
  sum((b.x - k.x) * (b.x - k.x)) AS xx, sum((b.y - k.y) * (b.y - k.y)) AS yy, sum((b.z - k.z) * (b.z - k.z)) AS zz,
  sum((b.x - k.x) * (b.y - k.y)) AS xy, sum((b.x - k.x) * (b.z - k.z)) AS xz, sum((b.y - k.y) * (b.z - k.z)) AS yz
  FROM sk k JOIN solid_ b ON b.s = k.s AND abs(b.x - k.x) <= 4 AND abs(b.y - k.y) <= 4 AND abs(b.z - k.z) <= 4 GROUP BY ALL HAVING count(*) >= 6),
cov AS (SELECT s, n * xx - sx * sx AS a, n * yy - sy * sy AS b, n * zz - sz * sz AS c, n * xy - sx * sy AS d, n * xz - sx * sz AS e, n * yz - sy * sz AS f FROM sums),
full_ AS (SELECT *, a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e) AS det, (a + b + c) / 3.0 AS q FROM cov),
scale_ AS (SELECT *, sqrt((power(a - q, 2) + power(b - q, 2) + power(c - q, 2) + 2.0 * (d * d + e * e + f * f)) / 6) AS p FROM full_ WHERE det > 0),
turn AS (SELECT *, acos(greatest(-1.0, least(1.0, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / power(p, 3) / 2))) / 3 AS phi FROM scale_),
two AS (SELECT *, q + 2 * p * cos(phi) AS l3, q + 2 * p * cos(phi + 2 * pi() / 3) AS l0 FROM turn),
three AS (SELECT *, 3 * q - l0 - l3 AS l2 FROM two),
lam AS (SELECT *, det / (l2 * l3) AS l1 FROM three),
ef AS (SELECT s, greatest(-1.0, least(1.0, sqrt(l1 / l2) - sqrt(l2 / l3))) AS ef, ((a - l1) * (b - l1) - d * d) / ((l1 - l2) * (l1 - l3)) AS short_z2, ((a - l3) * (b - l3) - d * d) / ((l3 - l1) * (l3 - l2)) AS long_z2 FROM lam)"""
_SHARES = "avg(CAST(ef < -0.25 AS INT)) AS plate, avg(CAST(ef > 0.25 AS INT)) AS rod"
for _name, _what, _cols in (
    ("ef_stats_wires", f"count(*) AS n, avg(ef) AS mean, coalesce(stddev_samp(ef), 0) AS sd, median(ef) AS median, {_SHARES}", ("mean", "sd", "median", "plate", "rod")),
    ("plate_rod_wires", f"count(*) AS n, {_SHARES}, avg(abs(ef)) AS mean_abs_ef, avg(CASE WHEN ef < -0.25 THEN CAST(short_z2 >= 0.75 AS INT) END) AS plate_axial, avg(CASE WHEN ef > 0.25 THEN CAST(long_z2 >= 0.75 AS INT) END) AS rod_axial", ("plate", "rod", "mean_abs_ef", "plate_axial", "rod_axial")),
):
    _made = f"SELECT s AS specimen, n, {', '.join(f'round({c}, 5) AS {c}' for c in _cols)}, round(1 - plate - rod, 5) AS intermediate, {_OK} FROM (SELECT s, {_what} FROM ef GROUP BY s)"
    ORACLES[_name] = "WITH " + _FIGURES.strip() + "," + re.sub(r"^(\w+) AS \(", r"\1 AS MATERIALIZED (", _WINDOWS, flags=re.M) + "\n" + _made
