"""Array kernels on a part of a volume: some layers in a row, or some lines.

A slab is an array [z, y, x] of consecutive layers, the first ``below`` of them (0 or 1) belonging to the slab
before it. What two slabs share is that layer, whose voxels both see.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from voxloom.functions.surfaces import corner_cases
from voxloom.functions.voxels import OFFSETS26, ridge_limits, roots

#: Squared distance of a voxel whose line or layer holds no voxel of the other phase. Sides may be up to
#: 18,000 voxels: squared distances then stay below it, and sums with them below 2**31.
FAR = 1 << 30
#: Rows beside a row, as (dz, dy), of which each pair is listed once; runs of voxels along x touch over them.
_BESIDE = {26: ((0, 1), (1, -1), (1, 0), (1, 1)), 6: ((0, 1), (1, 0))}


@dataclass(frozen=True)
class Runs:
    """Runs of set voxels along x, in order: layer, row, first and last x, and the number of each run's component
    in the slab, from 0."""

    z: np.ndarray
    y: np.ndarray
    low: np.ndarray
    high: np.ndarray
    part: np.ndarray
    parts: int

    def of_layer(self, z: int) -> np.ndarray:
        """Components of a layer's runs, in order. Another slab with the same layer has the same runs."""
        return self.part[np.searchsorted(self.z, z) : np.searchsorted(self.z, z, "right")]

    def outer(self, shape: tuple[int, int, int], first: bool, last: bool) -> np.ndarray:
        """Components that touch the image's border; its lowest and highest layer only where the slab has them."""
        at = (self.y == 0) | (self.y == shape[1] - 1) | (self.low == 0) | (self.high == shape[2] - 1)
        if first:
            at |= self.z == 0
        if last:
            at |= self.z == shape[0] - 1
        return np.unique(self.part[at])


def label_runs(mask: np.ndarray, connectivity: int) -> Runs:
    """Components of the set voxels by runs along x: memory grows with the runs, not with the voxels."""
    d, h, w = mask.shape
    edge = np.zeros((d * h, w + 1), np.int8)
    edge[:, :w] = mask.reshape(d * h, w)
    edge[:, 1:] -= edge[:, :w].copy()
    row, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    del edge
    n, wide = len(row), w + 3
    reach = 1 if connectivity == 26 else 0
    # rows are laid end to end with room for the reach between them
    starts, ends = row * wide + low + 1, row * wide + high + 1
    z, y = row // h, row % h
    pairs = []
    for dz, dy in _BESIDE[connectivity]:
        at = np.flatnonzero((z + dz < d) & (y + dy >= 0) & (y + dy < h))
        step = (dz * h + dy) * wide
        from_ = np.searchsorted(ends, starts[at] + step - reach)
        count = np.searchsorted(starts, ends[at] + step + reach, "right") - from_
        count = np.maximum(count, 0)
        first = np.cumsum(count) - count
        pairs.append(np.stack([np.repeat(at, count), np.arange(count.sum()) - np.repeat(first - from_, count)]))
    a, b = np.concatenate(pairs, axis=1) if n else np.zeros((2, 0), np.int64)
    names, part = np.unique(roots(n, a, b), return_inverse=True)
    return Runs(z, y, low, high, part.astype(np.int32), len(names))


def cell_counts(v: np.ndarray, below: int, last: bool) -> tuple[int, int, int, int]:
    """Vertices, edges, faces and cubes of the closed cells that a slab owns: those of its own layers and of
    the planes below each of them; the highest plane of the image belongs to the last slab."""

    def beside(a: np.ndarray, axis: int) -> np.ndarray:
        """Whether one of the two voxels beside each grid plane across an axis is set."""
        pad = [(0, 0)] * 3
        pad[axis] = (1, 1)
        p = np.pad(a, pad)
        n = p.shape[axis]
        return np.take(p, range(n - 1), axis) | np.take(p, range(1, n), axis)

    own = v[below:]
    planes = own.copy()
    planes[1 - below :] |= v[:-1]
    if last:
        planes = np.concatenate([planes, v[-1:]])
    own_y, planes_y = beside(own, 1), beside(planes, 1)
    count = lambda a: int(np.count_nonzero(a))
    vertices = count(beside(planes_y, 2))
    edges = count(beside(own_y, 2)) + count(planes_y) + count(beside(planes, 2))
    faces = count(planes) + count(own_y) + count(beside(own, 2))
    return vertices, edges, faces, count(own)


def surface_counts(v: np.ndarray, below: int, last: bool) -> tuple[np.ndarray, int]:
    """Cubes of each case and vertices of the surface that a slab owns: the cubes whose upper layer is its own, and
    those above the image's highest layer; the vertices on lattice edges of its own layers and up to them."""
    own = np.pad(v[below:], ((0, 0), (1, 1), (1, 1)))
    flat = sum(int(np.count_nonzero(np.take(own, range(1, n), a) != np.take(own, range(n - 1), a))) for a, n in ((1, own.shape[1]), (2, own.shape[2])))
    whole = np.pad(v, ((1 - below, int(last)), (1, 1), (1, 1)))
    cases = np.zeros(256, np.int64)
    upright = 0
    for z in range(len(whole) - 1):  # a layer of cubes at a time
        cases += np.bincount(corner_cases(~whole[z : z + 2]).ravel(), minlength=256)
        upright += int(np.count_nonzero(whole[z] != whole[z + 1]))
    return cases, flat + upright


def row_distance(selected: np.ndarray, axis: int = -1) -> np.ndarray:
    """Squared distance along an axis to the nearest unselected voxel of the line; FAR without one."""
    n = selected.shape[axis]
    at = np.arange(n, dtype=np.int32).reshape([-1 if k == axis % selected.ndim else 1 for k in range(selected.ndim)])
    far = np.int32(1 << 15)
    left = np.maximum.accumulate(np.where(selected, -far, at), axis=axis)
    right = np.flip(np.minimum.accumulate(np.flip(np.where(selected, far * 2, at), axis), axis=axis), axis)
    near = np.minimum(at - left, right - at)
    return np.where(near >= n, np.int32(FAR), near * near).astype(np.int32)


def envelope(f: np.ndarray) -> np.ndarray:
    """min over q of f(q) + (p - q)**2 along the first axis of (n, lines), for all lines at once: the lower
    envelope of parabolas, as a stack of the parabolas that are lowest somewhere and where each begins.
    Linear in the length of a line; exact in whole numbers."""
    n, lines = f.shape
    f = f.astype(np.int64)
    apex, begin = np.zeros((n, lines), np.int32), np.zeros((n, lines), np.int32)
    top = np.zeros(lines, np.int64)
    every = np.arange(lines)
    for u in range(1, n):
        open_ = every
        while len(open_):  # a parabola that the new one undercuts where it begins is lowest nowhere
            k = top[open_]
            s, t = apex[k, open_].astype(np.int64), begin[k, open_].astype(np.int64)
            under = f[s, open_] + (t - s) ** 2 > f[u, open_] + (t - u) ** 2
            open_ = open_[under]
            top[open_] -= 1
            open_ = open_[top[open_] >= 0]
        empty = top < 0
        top[empty] = 0
        apex[0, empty], begin[0, empty] = u, 0
        at = every[~empty]
        s = apex[top[at], at].astype(np.int64)
        start = 1 + ((f[u, at] + u * u) - (f[s, at] + s * s)) // (2 * (u - s))
        fit = start < n
        at, start = at[fit], start[fit]
        top[at] += 1
        apex[top[at], at], begin[top[at], at] = u, start
    out = np.empty((n, lines), np.int32)
    for u in range(n - 1, -1, -1):
        s = apex[top, every].astype(np.int64)
        out[u] = np.minimum(f[s, every] + (u - s) ** 2, FAR)
        top -= (begin[top, every] == u) & (top > 0)
    return out


#: Offsets that are tried for all lines at once; lines with larger distances are left to the envelope.
OFFSETS = 16


def nearest(f: np.ndarray, axis: int) -> np.ndarray:
    """min over q of f(q) + (p - q)**2 along an axis, f as 32-bit squared distances up to FAR. Offsets stop once they
    cannot improve; after OFFSETS of them the lines that still might be improved are solved by the envelope, so
    the work stays linear in the length of a line."""
    out = f.copy()
    n = f.shape[axis]
    f, view = np.moveaxis(f, axis, 0), np.moveaxis(out, axis, 0)
    for k in range(1, n):
        if k * k >= view.max():
            break
        if k > OFFSETS:
            open_ = view.max(axis=0) > k * k
            view[:, open_] = envelope(f[:, open_])
            break
        moved = f + np.int32(k * k)
        np.minimum(view[k:], moved[:-k], out=view[k:])
        np.minimum(view[:-k], moved[k:], out=view[:-k])
    return out


def ridge_points(d2: np.ndarray, own: slice) -> np.ndarray:
    """Voxels (slab, z, y, x, squared distance) of the distance ridge in the layers ``own`` of slabs [slab, z, y, x] of one
    shape; the layers around them are there where the image has any. Layer by layer, of the slabs together, and a
    neighbour is only looked up for the voxels that none before it has ruled out."""
    values = np.unique(d2)
    limits = np.zeros((3, int(values[-1]) + 1 if len(values) else 1), np.int32)
    for v in values[values > 0].tolist():
        limits[:, v] = ridge_limits(v)
    padded = np.pad(d2, ((0, 0), (1, 1), (1, 1), (1, 1)), constant_values=-1)
    flat, steps = padded.reshape(-1), np.array(padded.strides) // padded.itemsize
    found = []
    for z in range(d2.shape[1])[own]:
        slab, y, x = np.nonzero(d2[:, z] > 0)
        at = slab * steps[0] + (z + 1) * steps[1] + (y + 1) * steps[2] + x + 1
        value = flat[at]
        for o in sorted(OFFSETS26, key=lambda o: sum(map(abs, o))):
            keep = flat[at + int(np.dot(o, steps[1:]))] < limits[sum(map(abs, o)) - 1][value]
            at, value = at[keep], value[keep]
        slab, y, x = at // steps[0], at // steps[2] % padded.shape[2] - 1, at % steps[2] - 1
        found.append(np.stack([slab, np.full(len(at), z), y, x, value], axis=1).astype(np.int32))
    return np.concatenate(found) if found else np.zeros((0, 5), np.int32)


#: Rows of balls that are painted at a time.
PAINTED = 1 << 20


def paint_balls(shape: tuple[int, int, int, int], balls: np.ndarray) -> np.ndarray:
    """Largest squared radius of the balls (slab, z, y, x, squared radius) that cover each voxel [slab, z, y, x]; centres
    may lie outside. Balls of one radius are painted together, as rows of voxels along x that begin and end: a
    step for each radius, not for each ball."""
    out = np.zeros(shape, np.int32)
    slabs, d, h, w = shape
    order = np.argsort(balls[:, 4], kind="stable")
    balls = balls[order]
    number = np.zeros(slabs * d * h, np.int64)
    for r2, at, n in zip(*np.unique(balls[:, 4], return_index=True, return_counts=True), strict=True):
        r = int(np.sqrt(r2))
        r -= r * r > r2
        dz, dy = (a.ravel() for a in np.meshgrid(np.arange(-r, r + 1), np.arange(-r, r + 1), indexing="ij"))
        left = r2 - dz * dz - dy * dy
        dz, dy, left = dz[left >= 0], dy[left >= 0], left[left >= 0]
        half = np.floor(np.sqrt(left)).astype(np.int64)
        half -= half * half > left
        half += (half + 1) ** 2 <= left
        step = max(1, PAINTED // len(half))
        for k in range(at, at + n, step):
            some = balls[k : min(k + step, at + n)]
            z, y = some[:, 1:2] + dz, some[:, 2:3] + dy
            low, high = some[:, 3:4] - half, some[:, 3:4] + half
            fit = (z >= 0) & (z < d) & (y >= 0) & (y < h) & (high >= 0) & (low < w)
            row = ((some[:, :1] * d + z) * h + y)[fit]
            number[row] = 1
            rows = np.flatnonzero(number)
            number[rows] = np.arange(len(rows))
            line = number[row] * (w + 1)
            number[rows] = 0
            ends = len(rows) * (w + 1)
            edge = np.bincount(line + np.maximum(low[fit], 0), minlength=ends) - np.bincount(line + np.minimum(high[fit] + 1, w), minlength=ends)
            covered = np.cumsum(edge.reshape(-1, w + 1)[:, :w], axis=1) > 0
            part = out.reshape(-1, w)[rows]
            part[covered] = r2  # ascending: a later ball is never smaller
            out.reshape(-1, w)[rows] = part
    return out
