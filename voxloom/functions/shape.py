"""Local shape around skeleton voxels, orientation densities and plate/rod organisation."""

from __future__ import annotations

import functools

import numpy as np

from voxloom.functions.voxels import MorphometryError, squared_distance

KAPPA, RADIUS_LEAST, RADIUS_MOST, LEAST_POINTS, LEAST_CLASS = 2.5, 3, 24, 8, 25
EF_SPLIT, PROXY_SPLIT = 0.25, 0.20
BANDWIDTH, GRID = np.radians(4.5), np.radians(0.5)
FIELD_RADIUS = 2.0
NAN = float("nan")


def _rounded(lam: np.ndarray) -> np.ndarray:
    """Eigenvalues with those that are 0 but for round-off as 0: windows whose points lie in a plane or on a line."""
    return np.where(np.abs(lam) <= 1e-13 * np.abs(lam).max(axis=-1, keepdims=True), 0.0, lam)


def window_points(bone: np.ndarray, seed: tuple[int, int, int], r: int, ball: bool) -> np.ndarray:
    """Bone voxels (x, y, z) in the cube or ball of radius r around a seed (z, y, x): what the moments sum."""
    lo = [max(0, c - r) for c in seed]
    hi = [min(n, c + r + 1) for n, c in zip(bone.shape, seed, strict=True)]
    at = np.argwhere(bone[lo[0] : hi[0], lo[1] : hi[1], lo[2] : hi[2]]) + lo
    if ball:
        at = at[((at - np.array(seed)) ** 2).sum(axis=1) <= r * r]
    return at[:, ::-1].astype(float)


def ellipsoid_factor(axes: np.ndarray) -> float:
    """a / b - b / c of ascending semi-axes."""
    return float(axes[0] / axes[1] - axes[1] / axes[2])


#: Pairs of axes whose products are summed, in the order of the six sums.
_PRODUCTS = ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))


def cube_moments(bone: np.ndarray, seeds: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of bone voxels in the cube of radius r around each seed (z, y, x), and sums of their coordinates
    (x, y, z) and of their products, relative to the seed. Each sum is eight look-ups in a volume
    of sums over boxes; one such volume is held at a time. Whole numbers throughout."""
    low = np.maximum(seeds - r, 0)
    high = np.minimum(seeds + r + 1, bone.shape)
    grid = [g.astype(np.int64) for g in np.ogrid[tuple(slice(n) for n in bone.shape)]]

    def total(weight) -> np.ndarray:
        v = np.zeros([n + 1 for n in bone.shape], np.int64)
        v[1:, 1:, 1:] = bone * weight
        for axis in range(3):
            np.cumsum(v, axis=axis, out=v)
        at = lambda z, y, x: v[z[:, 0], y[:, 1], x[:, 2]]
        return at(high, high, high) - at(low, high, high) - at(high, low, high) - at(high, high, low) + at(low, low, high) + at(low, high, low) + at(high, low, low) - at(low, low, low)

    z, y, x = grid
    axes = (x, y, z)
    n = total(np.int64(1))
    first = np.stack([total(a) for a in axes], axis=1)
    second = np.stack([total(axes[i] * axes[j]) for i, j in _PRODUCTS], axis=1)
    c = seeds[:, ::-1].astype(np.int64)
    moved = np.stack([second[:, k] - c[:, i] * first[:, j] - c[:, j] * first[:, i] + n * c[:, i] * c[:, j] for k, (i, j) in enumerate(_PRODUCTS)], axis=1)
    return n, first - n[:, None] * c, moved


#: Rows of balls that are summed at a time.
_ROWS = 1 << 20


def ball_moments(bone: np.ndarray, seeds: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for balls, each seed with its own radius: a ball is rows along x, whose sums are two look-ups
    in running sums along x."""
    x = np.arange(bone.shape[2], dtype=np.int64)
    run = [np.concatenate([np.zeros((*bone.shape[:2], 1), np.int64), np.cumsum(bone * x**k, axis=2)], axis=2) for k in range(3)]
    n, first, second = np.zeros(len(seeds), np.int64), np.zeros((len(seeds), 3), np.int64), np.zeros((len(seeds), 6), np.int64)
    for r in np.unique(radius):
        dz, dy = (g.ravel() for g in np.meshgrid(np.arange(-r, r + 1), np.arange(-r, r + 1), indexing="ij"))
        left = r * r - dz * dz - dy * dy
        dz, dy, left = dz[left >= 0], dy[left >= 0], left[left >= 0]
        half = np.sqrt(left).astype(np.int64)
        half -= half * half > left
        half += (half + 1) ** 2 <= left
        every = np.flatnonzero(radius == r)
        step = max(1, _ROWS // len(half))
        for k in range(0, len(every), step):
            at = every[k : k + step]
            z, y, c = seeds[at, :1] + dz, seeds[at, 1:2] + dy, seeds[at, 2:]
            inside = (z >= 0) & (z < bone.shape[0]) & (y >= 0) & (y < bone.shape[1])
            z, y = np.where(inside, z, 0), np.where(inside, y, 0)
            low, high = np.maximum(c - half, 0), np.minimum(c + half + 1, bone.shape[2])
            s0, s1, s2 = ((v[z, y, high] - v[z, y, low]) * inside for v in run)
            s2 = s2 - 2 * c * s1 + c * c * s0
            s1 = s1 - c * s0
            n[at] = s0.sum(axis=1)
            first[at] = np.stack([s1.sum(axis=1), (dy * s0).sum(axis=1), (dz * s0).sum(axis=1)], axis=1)
            second[at] = np.stack([v.sum(axis=1) for v in (s2, dy * dy * s0, dz * dz * s0, dy * s1, dz * s1, dy * dz * s0)], axis=1)
    return n, first, second


def principal(n: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and eigenvectors of the covariances of many windows of two points at least."""
    cov = np.empty((len(n), 3, 3))
    for k, (i, j) in enumerate(_PRODUCTS):
        cov[:, i, j] = cov[:, j, i] = (second[:, k] - first[:, i] * (first[:, j] / n)) / (n - 1)
    return np.linalg.eigh(cov)


def cube_shapes(bone: np.ndarray, skeleton: np.ndarray, r: int = 4) -> list[dict]:
    """Ellipsoid factor (clamped to +-1) and axes of the cube window of each skeleton voxel with at
    least six bone voxels and positive axes."""
    n, first, second = cube_moments(bone, np.argwhere(skeleton), r)
    many = n >= 6
    lam, vec = principal(n[many], first[many], second[many])
    axes = np.sqrt(np.maximum(_rounded(lam), 0))
    fit = (axes > 0).all(axis=1)
    axes, vec = axes[fit], vec[fit]
    ef = np.clip(axes[:, 0] / axes[:, 1] - axes[:, 1] / axes[:, 2], -1, 1)
    return [{"ef": e, "short": v[:, 0], "long": v[:, 2]} for e, v in zip(ef.tolist(), vec, strict=True)]


def ef_stats(shapes: list[dict]) -> dict[str, float]:
    ef = np.array([s["ef"] for s in shapes])
    if not len(ef):
        return {"n": 0, "mean": NAN, "sd": NAN, "median": NAN, "plate": NAN, "rod": NAN, "intermediate": NAN}
    plate, rod = float((ef < -EF_SPLIT).mean()), float((ef > EF_SPLIT).mean())
    return {"n": len(ef), "mean": float(ef.mean()), "sd": float(ef.std(ddof=1)) if len(ef) > 1 else 0.0, "median": float(np.median(ef)), "plate": plate, "rod": rod, "intermediate": 1 - plate - rod}


def plate_rod(shapes: list[dict], cone_deg: float = 30.0) -> dict[str, float]:
    """Shares of plates and rods, their mean |EF| and how many have their short or long axis
    within a cone around z."""
    limit = np.cos(np.radians(cone_deg))
    plates = [s for s in shapes if s["ef"] < -EF_SPLIT]
    rods = [s for s in shapes if s["ef"] > EF_SPLIT]
    share = lambda part: len(part) / len(shapes) if shapes else NAN
    mean = lambda xs: float(np.mean(xs)) if len(xs) else NAN
    return {
        "n": len(shapes), "plate": share(plates), "rod": share(rods), "intermediate": 1 - share(plates) - share(rods) if shapes else NAN,
        "mean_abs_ef": mean([abs(s["ef"]) for s in shapes]), "plate_axial": mean([abs(s["short"][2]) >= limit for s in plates]), "rod_axial": mean([abs(s["long"][2]) >= limit for s in rods]),
    }


def lifted_axes(lam: np.ndarray) -> np.ndarray:
    """Semi-axes; eigenvalues that are negative by round-off alone count as just positive."""
    scale = max(1.0, float(np.abs(lam).max()))
    return np.sqrt(np.where((lam < 0) & (lam >= -1e-12 * scale), np.finfo(float).eps * scale, lam))


def canonical_axis(v: np.ndarray) -> np.ndarray:
    """The axis with its first of z, y, x that differs from 0 made positive."""
    for c in v[::-1]:
        if abs(c) > 1e-15:
            return v if c > 0 else -v
    return v


def axis_angles(v: np.ndarray) -> tuple[float, float]:
    """theta in (-pi/2, pi/2] around z and phi in [0, pi/2] from z of an unoriented axis."""
    v = canonical_axis(v / np.linalg.norm(v))
    phi = float(np.arccos(np.clip(abs(v[2]), 0, 1)))
    theta = float(np.arctan2(v[1], v[0]))
    theta = (theta + np.pi / 2) % np.pi - np.pi / 2
    if abs(theta + np.pi / 2) <= 1e-14 + 1e-5 * np.pi / 2:
        theta = np.pi / 2
    return theta, phi


def grid_representatives(at: np.ndarray, cell: float, h: float) -> np.ndarray:
    """Points (x, y, z) nearest their grid cell's centre, one a cell; ties by z, y, x."""
    p = (at + 0.5) * h / cell
    c = np.floor(p).astype(int)
    d = (((p - c - 0.5) * cell) ** 2).sum(axis=1)
    order = np.lexsort((at[:, 0], at[:, 1], at[:, 2], d, c[:, 2], c[:, 1], c[:, 0]))
    c = c[order]
    first = np.ones(len(c), bool)
    first[1:] = (c[1:] != c[:-1]).any(axis=1)
    return at[order][first]


def orientation_samples(bone: np.ndarray, skeleton: np.ndarray, h: float) -> tuple[list[dict], float]:
    """Plate and rod samples at grid representatives of the skeleton, and the median thickness."""
    if not bone.any() or not skeleton.any():
        raise MorphometryError("empty bone or skeleton")
    if (skeleton & ~bone).any():
        raise MorphometryError("skeleton outside bone")
    d2 = squared_distance(bone)
    at = np.argwhere(skeleton)[:, ::-1]
    t50 = float(np.median(2 * np.sqrt(d2[skeleton]) * h))
    seeds = grid_representatives(at, t50, h)[:, ::-1]
    thick = 2 * np.sqrt(d2[tuple(seeds.T)])
    radius = np.clip(np.ceil(KAPPA * thick), RADIUS_LEAST, RADIUS_MOST).astype(int)
    n, first, second = ball_moments(bone, seeds, radius)
    many = np.flatnonzero(n >= LEAST_POINTS)
    lam, vec = principal(n[many], first[many], second[many])
    out = []
    for k, values, vectors in zip(many.tolist(), lam, vec, strict=True):
        axes = lifted_axes(values)
        if not np.isfinite(axes).all() or (axes <= 1e-9).any():
            continue
        ef = ellipsoid_factor(axes)
        kind = "plate" if ef < -PROXY_SPLIT else "rod" if ef > PROXY_SPLIT else None
        if kind:
            z, y, x = seeds[k].tolist()
            out.append({"x": x, "y": y, "z": z, "kind": kind, "vector": canonical_axis(vectors[:, 0] if kind == "plate" else vectors[:, 2]), "ef": ef, "thickness_vox": float(thick[k]), "radius_vox": int(radius[k])})
    return out, t50


def density_grid() -> tuple[np.ndarray, np.ndarray]:
    n = int(round(np.pi / GRID)) + 1, int(round(np.pi / 2 / GRID)) + 1
    return np.linspace(-np.pi / 2, np.pi / 2, n[0]), np.linspace(0, np.pi / 2, n[1])


def density(angles: np.ndarray) -> np.ndarray:
    """Gaussian density of (theta, phi) on the grid, reflected at both ends of both axes."""
    theta, phi = density_grid()

    def side(grid: np.ndarray, v: np.ndarray) -> np.ndarray:
        lo, hi = grid[0], grid[-1]
        g = lambda c: np.exp(-0.5 * ((grid[:, None] - c[None, :]) / BANDWIDTH) ** 2) / (BANDWIDTH * np.sqrt(2 * np.pi))
        return g(v) + g(2 * lo - v) + g(2 * hi - v)

    return side(theta, angles[:, 0]) @ side(phi, angles[:, 1]).T / len(angles)


def integral(f: np.ndarray) -> float:
    w = [np.where((np.arange(n) == 0) | (np.arange(n) == n - 1), 0.5, 1.0) for n in f.shape]
    return float(w[0] @ f @ w[1] * GRID * GRID)


UNIFORM = 1 / (np.pi * np.pi / 2)


@functools.lru_cache(maxsize=1)
def vmax() -> float:
    """Organisation of a single direction, before it is divided by itself."""
    return integral(np.maximum(density(np.array([[0.0, np.pi / 4]])) - UNIFORM, 0))


def organisation(f: np.ndarray) -> float:
    return integral(np.maximum(f - UNIFORM, 0)) / vmax()


def soi(samples: list[dict]) -> dict[str, float]:
    """Organisation of plates and rods, overlap of the two, and their product."""
    part = {k: np.array([axis_angles(s["vector"]) for s in samples if s["kind"] == k]).reshape(-1, 2) for k in ("plate", "rod")}
    out = {"n_plate": len(part["plate"]), "n_rod": len(part["rod"])}
    if min(out.values()) < LEAST_CLASS:
        return out | {"p_o": NAN, "r_o": NAN, "pr_o": NAN, "soi": NAN}
    p, r = density(part["plate"]), density(part["rod"])
    clip = lambda v: min(max(v, 0.0), 1.0) if -1e-10 <= v <= 1 + 1e-10 else v
    po, ro, pro = clip(organisation(p)), clip(organisation(r)), clip(1 - 0.5 * integral(np.abs(p - r)))
    return out | {"p_o": po, "r_o": ro, "pr_o": pro, "soi": po * ro * pro}


def near_pairs(a: np.ndarray, b: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (of a, of b) of all pairs of points in the same or in neighbouring cells of side ``reach``: every pair
    within it, and some beyond."""
    if not len(a) or not len(b):
        return np.zeros(0, int), np.zeros(0, int)
    ca, cb = (np.floor(p / reach).astype(np.int64) for p in (a, b))
    low = np.minimum(ca.min(axis=0), cb.min(axis=0)) - 1
    size = np.maximum(ca.max(axis=0), cb.max(axis=0)) + 2 - low
    key = lambda c: ((c[:, 0] - low[0]) * size[1] + c[:, 1] - low[1]) * size[2] + c[:, 2] - low[2]
    order = np.argsort(key(cb), kind="stable")
    held = key(cb)[order]
    left, right = [], []
    for offset in np.ndindex(3, 3, 3):
        at = key(ca + np.array(offset) - 1)
        first, last = np.searchsorted(held, at), np.searchsorted(held, at, "right")
        n = last - first
        left.append(np.repeat(np.arange(len(a)), n))
        right.append(order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)])
    return np.concatenate(left), np.concatenate(right)


def orientation_field(samples: list[dict], h: float, t50: float, radius: float = FIELD_RADIUS) -> dict[str, float]:
    """Mean local misorientation of each kind, and how far plates and rods are from orthogonal,
    over neighbours within ``radius`` median thicknesses."""
    pos = {k: np.array([[s["x"], s["y"], s["z"]] for s in samples if s["kind"] == k], float).reshape(-1, 3) for k in ("plate", "rod")}
    vec = {k: np.array([s["vector"] for s in samples if s["kind"] == k]).reshape(-1, 3) for k in ("plate", "rod")}

    def local(a: str, b: str, angle) -> np.ndarray:
        i, j = near_pairs(pos[a], pos[b], radius * t50 / h)
        near = ((((pos[b][j] - pos[a][i]) * h / t50) ** 2).sum(axis=1) <= radius * radius) & ((i != j) | (a != b))
        i, j = i[near], j[near]
        off = np.degrees(angle(np.minimum(np.abs((vec[b][j] * vec[a][i]).sum(axis=1)), 1)))
        count = np.bincount(i, minlength=len(pos[a]))
        return np.bincount(i, off, len(pos[a]))[count > 0] / count[count > 0]

    mean = lambda v: float(v.mean()) if len(v) else NAN
    pp, rr = local("plate", "plate", np.arccos), local("rod", "rod", np.arccos)
    pr, rp = local("plate", "rod", np.arcsin), local("rod", "plate", np.arcsin)
    return {"plate_misorientation": mean(pp), "rod_misorientation": mean(rr), "orthogonality_deviation": 0.5 * (mean(pr) + mean(rp)) if len(pr) and len(rp) else NAN, "plate_centers": len(pp), "rod_centers": len(rr)}
