"""Topology-preserving thinning to a one-voxel-wide skeleton (Lee, Kashyap and Chu, 1994).

A voxel may go if it lies on the border of the pass, is no line end, leaves the Euler number as
it is and is simple: its 26 neighbours stay in one piece. Candidates of a pass are found for all
voxels at once; only the last test is repeated one by one, in raster order, as earlier deletions
of the pass may have made it false.
"""

from __future__ import annotations

import functools

import numpy as np

from voxloom.functions.voxels import OFFSETS26, shifted

_AT = {o: i for i, o in enumerate(OFFSETS26)}
#: For each neighbour, which of the others touch it, as bits.
_TOUCH = [sum(1 << j for j, b in enumerate(OFFSETS26) if j != i and max(abs(p - q) for p, q in zip(a, b, strict=True)) == 1) for i, a in enumerate(OFFSETS26)]
#: Border directions of the six passes, in order: y-, y+, x+, x-, z+, z-.
_PASSES = [(0, -1, 0), (0, 1, 0), (0, 0, 1), (0, 0, -1), (1, 0, 0), (-1, 0, 0)]


def octant_change(vertex_free: int, edges_free: int, faces_free: int) -> int:
    """Euler contribution, in eighths, of an octant's centre voxel by its free cells."""
    return 8 * vertex_free - 4 * edges_free + 2 * faces_free - 1


def euler_table() -> list[tuple[int, int]]:
    """(octant configuration, contribution) for the 128 octants that hold the centre voxel. Its bit
    is the lowest; then follow the neighbours a, b, ab, c, ac, bc, abc of the octant's axes."""
    names = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), (0, 0, 1), (1, 0, 1), (0, 1, 1), (1, 1, 1)]
    out = []
    for config in range(1, 256, 2):
        out.append((config, octant_of({n for b, n in enumerate(names) if config >> b & 1})))
    return out


def octant_of(present: set[tuple[int, int, int]]) -> int:
    axes = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    faces = sum(a not in present for a in axes)
    edges = sum(not ({a, b, tuple(p + q for p, q in zip(a, b, strict=True))} & present) for a, b in ((axes[0], axes[1]), (axes[0], axes[2]), (axes[1], axes[2])))
    return octant_change(int(not (present - {(0, 0, 0)})), edges, faces)


@functools.lru_cache(maxsize=1 << 18)
def is_simple(mask: int) -> bool:
    """Whether the set neighbours (bits in the order of OFFSETS26) are at most one piece."""
    if not mask:
        return True
    piece = edge = mask & -mask
    while edge:
        grown = 0
        while edge:
            bit = edge & -edge
            grown |= _TOUCH[bit.bit_length() - 1]
            edge ^= bit
        edge = grown & mask & ~piece
        piece |= edge
    return piece == mask


def skeletonize(volume: np.ndarray) -> np.ndarray:
    v = np.pad(volume.astype(bool), 1)
    flat = v.reshape(-1)
    strides = (v.shape[1] * v.shape[2], v.shape[2], 1)
    steps = [sum(o * s for o, s in zip(off, strides, strict=True)) for off in OFFSETS26]
    weights = 1 << np.arange(26, dtype=np.int64)

    candidate = np.zeros_like(flat)

    def neighbours(at: np.ndarray, among: np.ndarray) -> np.ndarray:
        return (among[at[:, None] + np.array(steps)] * weights).sum(axis=1)

    while True:
        changed = False
        for direction in _PASSES:
            border = v & ~shifted(v, direction, False)
            at = np.flatnonzero(border.reshape(-1))
            if not len(at):
                continue
            masks = neighbours(at, flat)
            not_end = np.bitwise_count(masks) != 1
            euler = _euler_at(v, at)
            keep = not_end & (euler == 0)
            at = at[keep]
            masks = masks[keep]
            simple = np.array([is_simple(m) for m in masks.tolist()], bool)
            at, masks = at[simple], masks[simple].tolist()
            # a deletion changes the masks of candidates beside it, and only theirs are read again
            candidate[at] = True
            beside = neighbours(at, candidate).tolist()
            candidate[at] = False
            places = at.tolist()
            number = {p: k for k, p in enumerate(places)}
            gone = []
            for k, p in enumerate(places):
                if is_simple(masks[k]):
                    gone.append(p)
                    near = beside[k]
                    while near:
                        bit = near & -near
                        i = bit.bit_length() - 1
                        masks[number[p + steps[i]]] &= ~(1 << 25 - i)  # the opposite neighbour
                        near ^= bit
            if gone:
                flat[gone] = False
                changed = True
        if not changed:
            return v[1:-1, 1:-1, 1:-1].copy()


def _euler_at(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Change of the Euler number, in eighths, by removing each of some inner voxels."""
    flat = v.reshape(-1)
    strides = (v.shape[1] * v.shape[2], v.shape[2], 1)
    near = {o: flat[at + sum(a * s for a, s in zip(o, strides, strict=True))] for o in OFFSETS26}
    total = np.zeros(len(at), np.int16)
    for sz in (-1, 1):
        for sy in (-1, 1):
            for sx in (-1, 1):
                z, y, x = near[sz, 0, 0], near[0, sy, 0], near[0, 0, sx]
                zy, zx, yx = near[sz, sy, 0], near[sz, 0, sx], near[0, sy, sx]
                faces = (~z).astype(np.int16) + ~y + ~x
                edges = (~(z | y | zy)).astype(np.int16) + ~(z | x | zx) + ~(y | x | yx)
                vertex = ~(z | y | x | zy | zx | yx | near[sz, sy, sx])
                total += 8 * vertex.astype(np.int16) - 4 * edges + 2 * faces - 1
    return total
