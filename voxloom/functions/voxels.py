"""Array kernels on one volume: cubical topology, labelling, distances, local thickness.

Volumes are arrays indexed [z, y, x]. Kernels are pure functions of arrays, run by the operators
inside Arrow batches, one specimen at a time.
"""

from __future__ import annotations

import functools

import numpy as np


class MorphometryError(ValueError):
    """A specimen that cannot be measured; the message says why."""


OFFSETS26 = [(dz, dy, dx) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dz, dy, dx) != (0, 0, 0)]
OFFSETS6 = [o for o in OFFSETS26 if sum(map(abs, o)) == 1]


def shifted(v: np.ndarray, offset: tuple[int, int, int], fill=0) -> np.ndarray:
    """v at p + offset for each voxel p; ``fill`` outside."""
    out = np.full_like(v, fill)
    to, of = [], []
    for n, d in zip(v.shape, offset, strict=True):
        to.append(slice(max(0, -d), n - max(0, d)))
        of.append(slice(max(0, d), n - max(0, -d)))
    out[tuple(to)] = v[tuple(of)]
    return out


def neighbour_counts(v: np.ndarray) -> np.ndarray:
    """Number of set 26-neighbours of each voxel."""
    p = np.pad(v.astype(np.int8), 1)
    for axis in range(3):  # a 3 x 3 x 3 box sum, one axis at a time
        n = p.shape[axis]
        p = sum(np.take(p, range(k, n - 2 + k), axis=axis) for k in range(3))
    return p - v.astype(np.int8)


# --- cubical complex -----------------------------------------------------------------------------


def cells(v: np.ndarray) -> np.ndarray:
    """The closed cubical complex in doubled coordinates: a voxel's 27 cells are at 2 p + {0,1,2};
    odd coordinates are extended, so a cell's dimension is its number of odd ones."""
    out = np.zeros([2 * n + 1 for n in v.shape], bool)
    for k in range(3):
        for j in range(3):
            for i in range(3):
                out[k : k + 2 * v.shape[0] - 1 : 2, j : j + 2 * v.shape[1] - 1 : 2, i : i + 2 * v.shape[2] - 1 : 2] |= v
    return out


def cubical_measures(v: np.ndarray) -> dict[str, float]:
    """Cell counts by dimension, Euler characteristic, mean breadth in lattice units, and the
    stack-edge correction with the corrected characteristic and connectivity."""
    c = cells(v)
    odd = sum(np.ix_(*[np.arange(n) & 1 for n in c.shape]))
    counts = np.bincount(odd[c], minlength=4)
    touch = sum(np.ix_(*[np.isin(np.arange(n), (0, n - 1)).astype(int) for n in c.shape]))
    sign = 1 - 2 * (odd & 1)
    part = [int(sign[c & (touch >= k)].sum()) for k in (1, 2, 3)]
    chi = int(counts[0] - counts[1] + counts[2] - counts[3])
    correction = part[0] / 2 + part[1] / 4 + part[2] / 8
    return {
        "vertices": int(counts[0]), "edges": int(counts[1]), "faces": int(counts[2]), "cubes": int(counts[3]),
        "euler": chi, "breadth": 0.5 * (counts[1] - 2 * counts[2] + 3 * counts[3]),
        "edge_correction": correction, "delta_chi": chi - correction, "connectivity": 1 - (chi - correction),
    }


def interface_faces(bone: np.ndarray, roi: np.ndarray) -> int:
    """Faces between a bone and a marrow voxel, both inside the region of interest."""
    total = 0
    for axis in range(3):
        a = [slice(None)] * 3
        b = list(a)
        a[axis], b[axis] = slice(None, -1), slice(1, None)
        a, b = tuple(a), tuple(b)
        total += int(np.count_nonzero((bone[a] != bone[b]) & roi[a] & roi[b]))
    return total


def boundary_bone_fraction(bone: np.ndarray, roi: np.ndarray) -> float:
    """Share of bone voxels in the region that touch its outside (or the image's) by a face."""
    inside = bone & roi
    n = int(inside.sum())
    if not n:
        return float("nan")
    whole = np.ones_like(roi)
    for o in OFFSETS6:
        whole &= shifted(roi, o, False)
    return int((inside & ~whole).sum()) / n


def label(mask: np.ndarray, connectivity: int) -> tuple[np.ndarray, int]:
    """Components of the set voxels, numbered from 1 in order of their first voxel; 0 elsewhere.
    Minima are hooked along neighbour pairs and pointers doubled until nothing changes."""
    number = np.full(mask.shape, -1, np.int64)
    n = int(mask.sum())
    number[mask] = np.arange(n)
    pairs = []
    for o in [o for o in (OFFSETS6 if connectivity == 6 else OFFSETS26) if o > (0, 0, 0)]:
        other = shifted(number, o, -1)
        at = (number >= 0) & (other >= 0)
        pairs.append(np.stack([number[at], other[at]]))
    edges = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    root = roots(n, edges[0], edges[1])
    names, inverse = np.unique(root, return_inverse=True)
    out = np.zeros(mask.shape, np.int64)
    out[mask] = inverse + 1
    return out, len(names)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component in a graph of n nodes."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return root
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def betti(v: np.ndarray) -> tuple[int, int, int]:
    """Betti numbers: 26-connected pieces, handles by b0 + b2 - euler, and enclosed 6-connected
    cavities that do not reach the image border."""
    b0 = label(v, 26)[1]
    holes, n = label(~v, 6)
    border = np.ones_like(v)
    border[1:-1, 1:-1, 1:-1] = False
    b2 = n - len(np.setdiff1d(np.unique(holes[border]), [0]))
    b1 = b0 + b2 - cubical_measures(v)["euler"]
    if b1 < 0:
        raise MorphometryError("negative first Betti number")
    return b0, b1, b2


def spans(v: np.ndarray) -> bool:
    """Whether one 26-connected piece reaches from the lowest to the highest occupied layer."""
    layers = np.flatnonzero(v.any(axis=(1, 2)))
    if len(layers) < 2 or layers[0] == layers[-1]:
        return False
    names, _ = label(v, 26)
    low, high = names[layers[0]], names[layers[-1]]
    return bool(np.intersect1d(low[low > 0], high[high > 0]).size)


# --- distances -----------------------------------------------------------------------------------

FAR = np.int64(1) << 40


def min_plus(f: np.ndarray, axis: int) -> np.ndarray:
    """min over q of f(q) + (p - q)**2 along an axis; offsets stop once they cannot improve."""
    out = f.copy()
    n = f.shape[axis]
    f, view = np.moveaxis(f, axis, 0), np.moveaxis(out, axis, 0)
    for k in range(1, n):
        if k * k >= view.max():
            break
        moved = f + f.dtype.type(k * k)
        np.minimum(view[k:], moved[:-k], out=view[k:])
        np.minimum(view[:-k], moved[k:], out=view[:-k])
    return out


def _along(selected: np.ndarray, axis: int, far: int) -> np.ndarray:
    """Squared distance of each voxel to the nearest unselected one of its line along an axis, ``far`` without one."""
    n = selected.shape[axis]
    place = np.arange(n, dtype=np.int32).reshape([-1 if a == axis else 1 for a in range(3)])
    before = np.maximum.accumulate(np.where(selected, np.int32(-far), place), axis=axis)
    after = np.flip(np.minimum.accumulate(np.flip(np.where(selected, np.int32(far), place), axis), axis=axis), axis)
    near = np.minimum(place - before, after - place)
    return np.where(near > n, far, near * near)


def squared_distance(selected: np.ndarray) -> np.ndarray:
    """Squared distance of each selected voxel's centre to the nearest unselected one; 0 elsewhere."""
    if selected.all():
        raise MorphometryError("no voxel of the opposite phase")
    if sum(n * n for n in selected.shape) < 1 << 29:  # then four bytes hold all sums, and lines need no offsets
        d = _along(selected, 2, 1 << 30).astype(np.int32)
    else:
        d = min_plus(np.where(selected, FAR, 0).astype(np.int64), 2)
    for axis in (1, 0):
        d = min_plus(d, axis)
    return d.astype(np.int64)


# --- local thickness -----------------------------------------------------------------------------


@functools.lru_cache(maxsize=4096)
def ridge_limits(r2: int) -> tuple[int, int, int]:
    """For a ball of squared radius r2: the squared radius a neighbour over a face, edge or corner
    needs to hold it, as the largest squared norm of a shifted lattice point of the ball."""
    best = [0, 0, 0]
    m = int(np.sqrt(r2)) + 1
    i, j = np.meshgrid(np.arange(m + 1), np.arange(m + 1), indexing="ij")
    left = r2 - i * i - j * j
    i, j, left = i[left >= 0], j[left >= 0], left[left >= 0]
    k = np.floor(np.sqrt(left)).astype(np.int64)
    k -= k * k > left
    k += (k + 1) ** 2 <= left
    for t, (a, b, c) in enumerate(((1, 0, 0), (1, 1, 0), (1, 1, 1))):
        best[t] = int(max(((x + a) ** 2 + (y + b) ** 2 + (z + c) ** 2).max() for x, y, z in ((i, j, k), (k, i, j), (j, k, i))))
    return tuple(best)


def distance_ridge(d2: np.ndarray) -> np.ndarray:
    """Voxels whose ball no neighbour's ball holds."""
    limit = np.zeros((3, *d2.shape), np.int64)
    values, inverse = np.unique(d2, return_inverse=True)
    table = np.array([ridge_limits(int(v)) if v else (0, 0, 0) for v in values])
    limit = table[inverse.reshape(d2.shape)]
    keep = d2 > 0
    for o in OFFSETS26:
        keep &= shifted(d2, o, -1) < limit[..., sum(map(abs, o)) - 1]
    return keep & (d2 > 0)


@functools.lru_cache(maxsize=1024)
def _ball(r2: int) -> np.ndarray:
    r = int(np.sqrt(r2))
    g = np.arange(-r, r + 1) ** 2
    return g[:, None, None] + g[None, :, None] + g[None, None, :] <= r2


def propagate(d2: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Largest squared radius of the ridge balls that cover each voxel, boundary included."""
    out = np.zeros_like(d2)
    at = np.argwhere(ridge)
    order = np.argsort(d2[ridge], kind="stable")
    for z, y, x in at[order]:
        r2 = int(d2[z, y, x])
        ball = _ball(r2)
        r = ball.shape[0] // 2
        lo = [max(0, c - r) for c in (z, y, x)]
        hi = [min(n, c + r + 1) for n, c in zip(out.shape, (z, y, x), strict=True)]
        box = out[lo[0] : hi[0], lo[1] : hi[1], lo[2] : hi[2]]
        part = ball[lo[0] - z + r : hi[0] - z + r, lo[1] - y + r : hi[1] - y + r, lo[2] - x + r : hi[2] - x + r]
        box[part] = r2  # ascending order: a later ball is never smaller
    return out


def clean_surface(t: np.ndarray) -> np.ndarray:
    """Surface voxels (beside an unset one inside the image) take the mean of their neighbours
    that are set and no surface voxels; those without such neighbours keep their value. The last three axes are
    those of an image, before them there may be one of images."""
    near = np.pad(t == 0, [(0, 0)] * (t.ndim - 3) + [(1, 1)] * 3)
    for axis in (-3, -2, -1):  # the 3 x 3 x 3 box of the unset voxels, one axis at a time
        n = near.shape[axis]
        near = np.take(near, range(n - 2), axis) | np.take(near, range(1, n - 1), axis) | np.take(near, range(2, n), axis)
    surface = (t > 0) & near
    inner = np.pad(np.where((t > 0) & ~surface, t, np.float32(0)).astype(np.float32), [(0, 0)] * (t.ndim - 3) + [(1, 1)] * 3)
    flat, steps = inner.reshape(-1), np.array(inner.strides) // inner.itemsize
    at = np.stack(np.nonzero(surface))
    at[-3:] += 1
    at = steps @ at
    total, count = np.zeros(len(at), np.float32), np.zeros(len(at), np.int32)
    for o in OFFSETS26:  # in this order: sums of 32 bits depend on it
        s = flat[at + int(np.dot(o, steps[-3:]))]
        total += s
        count += s > 0
    mean = total / np.maximum(count, 1).astype(np.float32)
    out = t.astype(np.float32)
    out[surface] = np.where(count > 0, mean, out[surface])
    return out


def local_thickness(selected: np.ndarray, clean: bool = True) -> np.ndarray:
    """Diameters (voxels, 32-bit) of the largest inscribed balls over the selected phase."""
    d2 = squared_distance(selected)
    raw = (np.float32(2) * np.sqrt(propagate(d2, distance_ridge(d2)).astype(np.float64)).astype(np.float32)).astype(np.float32)
    t = clean_surface(raw) if clean else raw
    return np.where(selected, t, np.float32(0))


def phase(bone: np.ndarray, roi: np.ndarray, want: bool) -> np.ndarray:
    """Voxels of a phase inside the region; outside it everything is the other phase."""
    return (bone == want) & roi


def distribution(values: np.ndarray, scale: float, quantiles: bool = True) -> dict[str, float]:
    """Statistics of the finite positive values, scaled in 32 bits and summed in 64."""
    raw = values[np.isfinite(values) & (values > 0)].astype(np.float32)
    if not len(raw):
        raise MorphometryError("no positive value")
    v = (raw * np.float32(scale)).astype(np.float64)
    mean = float(v.mean())
    sd = float(v.std(ddof=1)) if len(v) > 1 else 0.0
    out = {"mean": mean, "sd": sd, "max": float(v.max())}
    p = (0.1, 0.25, 0.5, 0.75, 0.9)
    q = [float(np.float32(x) * np.float32(scale)) for x in np.quantile(raw.astype(np.float64), p)] if quantiles else [float("nan")] * 5
    out |= dict(zip(("p10", "p25", "median", "p75", "p90"), q, strict=True))
    return out | {"iqr": q[3] - q[1], "cv": sd / mean if quantiles else float("nan")}
