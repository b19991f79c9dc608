"""DuckDB SQL of the line sampling: the seeded stream is a list of draws, and recursion follows one line of one
direction after the other, as each line decides how many draws the next one finds used up. One line a cycle, so no
cycle is shuffled.
"""

from __future__ import annotations

from voxloom.functions import intercepts

DIRECTIONS, LINES, REPETITIONS = 60, 3, 2
#: Draws that are listed; some 30 a direction are used.
_DRAWS = 200 * DIRECTIONS
_WRAP = 1 << 64


def _mixed(z: str, shift: int) -> str:
    return f"xor(CAST({z} AS UBIGINT), CAST({z} AS UBIGINT) >> {shift})"


_SEEDS = ", ".join(f"({r}, {intercepts.repetition_seed(intercepts.SEED, r)}::UHUGEINT)" for r in range(REPETITIONS))
_STREAM = f"""
seeds(rep, seed) AS (VALUES {_SEEDS}),
state AS (SELECT rep, k, (seed + k::UHUGEINT * 11400714819323198485) % {_WRAP} AS z FROM seeds, range(1, {_DRAWS + 1}) t(k)),
mix1 AS (SELECT rep, k, (CAST({_mixed('z', 30)} AS UHUGEINT) * 13787848793156543929) % {_WRAP} AS z FROM state),
mix2 AS (SELECT rep, k, (CAST({_mixed('z', 27)} AS UHUGEINT) * 10723151780598845931) % {_WRAP} AS z FROM mix1),
stream AS (SELECT rep, list(CAST(CAST({_mixed('z', 31)} AS UBIGINT) >> 11 AS DOUBLE) * power(2.0, -53) ORDER BY k) AS d FROM mix2 GROUP BY rep)"""

_SIDES = ("x", "y", "z")


def _axis(i: int, j: int) -> str:
    """Entry (i, j) of the rotation by the quaternion (v0, v1, v2, w)."""
    cross = [["0", "-v2", "v1"], ["v2", "0", "-v0"], ["-v1", "v0", "0"]][i][j]
    diagonal = "1 - 2 * (v0 * v0 + v1 * v1 + v2 * v2) + " if i == j else ""
    return f"{diagonal}2 * v{i} * v{j} + 2 * w * ({cross})"


def ray_sql(low: tuple[int, int, int], high: tuple[int, int, int], diagonal: float) -> str:
    turned = ",\n    ".join(f"CASE WHEN open_ THEN r{i}{j} ELSE {_axis(i, j)} END AS t{i}{j}" for i in range(3) for j in range(3))
    points = ", ".join(f"{(low[i] + high[i]) / 2} + (dt - 0.5) * {diagonal!r} * t{i}0 + (du - 0.5) * {diagonal!r} * t{i}1 AS q{i}" for i in range(3))
    near = ", ".join(f"least(({low[i]} - q{i}) / t{i}2, ({high[i]} - q{i}) / t{i}2)" for i in range(3))
    far = ", ".join(f"greatest(({low[i]} - q{i}) / t{i}2, ({high[i]} - q{i}) / t{i}2)" for i in range(3))
    kept = ", ".join(f"t{i}{j}" for i in range(3) for j in range(3))
    none = ", ".join(f"0.0::DOUBLE AS r{i}{j}" for i in range(3) for j in range(3))
    inc = repr(intercepts.INCREMENT)
    return f"""
ray AS (
  SELECT rep, -1 AS dir, 0 AS line, 0::BIGINT AS k, {LINES * diagonal!r}::DOUBLE AS total, {none}, 0.0::DOUBLE AS px, 0.0::DOUBLE AS py, 0.0::DOUBLE AS pz, 0.0::DOUBLE AS start, 0::BIGINT AS n FROM stream
  UNION ALL
  SELECT rep, dir2, line + 1, gone + 2 + CAST(drawn AS BIGINT), so_far + CASE WHEN steps >= 1 THEN b - a ELSE 0 END, {kept}, q0, q1, q2, begin_, steps
  FROM (SELECT *, CASE WHEN drawn THEN a + d[gone + 3] * {inc} ELSE 0 END AS begin_, CASE WHEN drawn THEN CAST(ceil((b - (a + d[gone + 3] * {inc})) / {inc}) AS BIGINT) ELSE 0 END AS steps
  FROM (SELECT *, far > a AND far >= 0 AND b > a AS drawn
  FROM (SELECT *, least(far, a + {LINES * diagonal!r} - so_far) AS b
  FROM (SELECT *, greatest({near}) AS a, least({far}) AS far
  FROM (SELECT *, {points}
  FROM (SELECT *, {turned}
  FROM (SELECT *, sqrt(1 - u0) * sin(2 * pi() * u1) AS v0, sqrt(1 - u0) * cos(2 * pi() * u1) AS v1, sqrt(u0) * sin(2 * pi() * u2) AS v2, sqrt(u0) * cos(2 * pi() * u2) AS w, d[gone + 1] AS du, d[gone + 2] AS dt
  FROM (SELECT *, d[k + 1] AS u0, d[k + 2] AS u1, d[k + 3] AS u2, CASE WHEN open_ THEN k ELSE k + 3 END AS gone, CASE WHEN open_ THEN total ELSE 0 END AS so_far, CASE WHEN open_ THEN dir ELSE dir + 1 END AS dir2
  FROM (SELECT ray.*, stream.d, {LINES * diagonal!r} - total > 1e-12 AS open_ FROM ray JOIN stream USING (rep)))))))))) steps_
  WHERE dir2 < {DIRECTIONS}),
sums AS (SELECT rep, dir, max(total) AS total, any_value(r02) AS ax, any_value(r12) AS ay, any_value(r22) AS az FROM ray WHERE dir >= 0 GROUP BY rep, dir),
sample AS (SELECT rep, dir, line, i, CAST(floor(px + (start + i * {inc}) * r02) AS INT) AS x, CAST(floor(py + (start + i * {inc}) * r12) AS INT) AS y, CAST(floor(pz + (start + i * {inc}) * r22) AS INT) AS z
  FROM (SELECT *, unnest(range(n)) AS i FROM ray WHERE n >= 1)),
held AS (SELECT sp.s, sample.*, bone.s IS NOT NULL AND {' AND '.join(f'sample.{c} >= {low[i]} AND sample.{c} < {high[i]}' for i, c in enumerate(_SIDES))} AS hit
  FROM sp CROSS JOIN sample LEFT JOIN bone ON bone.s = sp.s AND bone.x = sample.x AND bone.y = sample.y AND bone.z = sample.z),
turns AS (SELECT s, rep, dir, sum(CAST(hit <> before AS INT)) AS changes FROM (SELECT *, lag(hit, 1, false) OVER (PARTITION BY s, rep, line ORDER BY i) AS before FROM held) GROUP BY s, rep, dir)"""


SELECT = """SELECT turns.s AS specimen, CAST(rep AS INT) AS rep, CAST(dir AS INT) AS direction, round(ax * total / greatest(changes, 1), 6) AS mx, round(ay * total / greatest(changes, 1), 6) AS my,
  round(az * total / greatest(changes, 1), 6) AS mz FROM turns JOIN sums USING (rep, dir)"""

#: The general quadric by Gauss-Jordan on its nine normal equations, moved to its centre by Cramer's rule; eigenvalues of
#: the centred form by the angle of the characteristic cubic.
QUADRIC = """
feat AS (SELECT s, rep, [x * x, y * y, z * z, 2 * x * y, 2 * x * z, 2 * y * z, 2 * x, 2 * y, 2 * z] AS f
  FROM (SELECT turns.s, rep, ax * total / greatest(changes, 1) AS x, ay * total / greatest(changes, 1) AS y, az * total / greatest(changes, 1) AS z FROM turns JOIN sums USING (rep, dir))),
cell AS (SELECT s, rep, i, j, sum(CASE WHEN j = 10 THEN f[i] ELSE f[i] * f[j] END) AS v FROM feat, range(1, 10) a(i), range(1, 11) b(j) GROUP BY s, rep, i, j),
elim AS (
  SELECT s, rep, 1 AS k, list(v ORDER BY i, j) AS m FROM cell GROUP BY s, rep
  UNION ALL SELECT s, rep, k + 1, list_transform(range(1, 91), lambda t: CASE WHEN (t - 1) // 10 + 1 = k THEN m[t] / m[11 * k - 10] ELSE m[t] - m[(t - 1) // 10 * 10 + k] / m[11 * k - 10] * m[10 * k - 10 + (t - 1) % 10 + 1] END) FROM elim WHERE k < 10),
form AS (SELECT s, rep, m[10] AS a, m[20] AS b, m[30] AS c, m[40] AS d, m[50] AS e, m[60] AS f, m[70] AS g, m[80] AS h, m[90] AS i FROM elim WHERE k = 10),
centred AS (SELECT *, a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e) AS det FROM form),
centre AS (SELECT *, -(g * (b * c - f * f) - d * (h * c - f * i) + e * (h * f - b * i)) / det AS cx, -(a * (h * c - i * f) - g * (d * c - f * e) + e * (d * i - h * e)) / det AS cy, -(a * (b * i - f * h) - d * (d * i - h * e) + g * (d * f - b * e)) / det AS cz FROM centred),
unit_ AS (SELECT *, 1 + a * cx * cx + b * cy * cy + c * cz * cz + 2 * (d * cx * cy + e * cx * cz + f * cy * cz) AS norm FROM centre),
fit AS (SELECT s, rep, a / norm AS a, b / norm AS b, c / norm AS c, d / norm AS d, e / norm AS e, f / norm AS f FROM unit_),
mid AS (SELECT *, (a + b + c) / 3 AS q FROM fit),
scale_ AS (SELECT *, sqrt((power(a - q, 2) + power(b - q, 2) + power(c - q, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM mid),
turned AS (SELECT *, acos(greatest(-1.0, least(1.0, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / power(p, 3) / 2))) / 3 AS phi FROM scale_),
ends AS (SELECT *, q + 2 * p * cos(phi) AS l2, q + 2 * p * cos(phi + 2 * pi() / 3) AS l0 FROM turned),
lam AS (SELECT *, 3 * q - l0 - l2 AS l1 FROM ends),
good AS (SELECT s, rep, 1 - l0 / l2 AS da, degrees(acos(least(1.0, sqrt(greatest(0.0, ((a - l0) * (b - l0) - d * d) / ((l0 - l1) * (l0 - l2))))))) AS angle_deg, 1 / sqrt(l2) AS radius_a, 1 / sqrt(l1) AS radius_b, 1 / sqrt(l0) AS radius_c FROM lam WHERE l0 > 0)"""
FITS = "SELECT s AS specimen, CAST(rep AS INT) AS rep, round(da, 6) AS da, round(angle_deg, 3) AS angle_deg, round(radius_a, 5) AS radius_a, round(radius_b, 5) AS radius_b, round(radius_c, 4) AS radius_c FROM good"
DEGREES = "SELECT s AS specimen, count(*) AS repetitions, round(avg(da), 6) AS da_mean, round(coalesce(stddev_samp(da), 0), 6) AS da_sd, round(min(da), 6) AS da_min, round(max(da), 6) AS da_max, round(avg(angle_deg), 3) AS angle_mean FROM good GROUP BY s"
