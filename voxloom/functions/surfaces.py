"""Marching cubes over lattice cubes, from a case table built by rule.

A cube's crossed edges are joined on each face so that every run of marked corners along the face
is cut off by one segment; following the segments gives closed polygons, which are cut into fans.
Neighbouring cubes cut a shared face alike, so surfaces close.
"""

from __future__ import annotations

import functools

import numpy as np

#: Corners as (x, y, z), edges as corner pairs that differ in one coordinate.
CORNERS = [(i & 1, i >> 1 & 1, i >> 2 & 1) for i in range(8)]
EDGES = [(a, b) for a in range(8) for b in range(a + 1, 8) if (a ^ b) in (1, 2, 4)]


def _faces() -> list[list[int]]:
    """Corner cycles of the six faces, counter-clockwise seen from outside."""
    out = []
    for axis in range(3):
        u, v = (axis + 1) % 3, (axis + 2) % 3
        for side in (0, 1):
            ring = [(0, 0), (1, 0), (1, 1), (0, 1)]
            if not side:
                ring.reverse()
            out.append([side << axis | a << u | b << v for a, b in ring])
    return out


@functools.lru_cache(maxsize=1)
def case_table() -> list[list[tuple[int, int, int]]]:
    """Triangles of each case as edge numbers. Bit i of a case marks corner i; normals point away
    from marked corners."""
    number = {frozenset(e): i for i, e in enumerate(EDGES)}
    faces = _faces()
    table = []
    for case in range(256):
        marked = [bool(case >> i & 1) for i in range(8)]
        after: dict[int, int] = {}
        for ring in faces:
            for k in range(4):
                a, b = ring[k], ring[(k + 1) % 4]
                if marked[a] and not marked[b]:  # a run of marked corners ends here: find where it began
                    m = k
                    while marked[ring[m % 4 - 1]]:
                        m = m % 4 - 1
                    enter = number[frozenset((ring[m % 4 - 1], ring[m % 4]))]
                    after[enter] = number[frozenset((a, b))]
        triangles = []
        while after:
            first = min(after)
            loop, e = [], first
            while e in after:
                loop.append(e)
                e = after.pop(e)
            triangles += [(loop[0], loop[i], loop[i + 1]) for i in range(1, len(loop) - 1)]
        table.append(triangles)
    return table


def corner_cases(marked: np.ndarray) -> np.ndarray:
    """Case of each lattice cube of an array [z, y, x]."""
    case = np.zeros([n - 1 for n in marked.shape], np.int32)
    for i, (x, y, z) in enumerate(CORNERS):
        case |= marked[z : marked.shape[0] - 1 + z, y : marked.shape[1] - 1 + y, x : marked.shape[2] - 1 + x].astype(np.int32) << i
    return case


def _edge_points(case: int, snap: str) -> list[tuple[float, float, float]]:
    out = []
    for a, b in EDGES:
        pa, pb = CORNERS[a], CORNERS[b]
        if snap == "middle":
            out.append(tuple((p + q) / 2 for p, q in zip(pa, pb, strict=True)))
        else:  # the unmarked corner, which is bone
            out.append(pb if case >> a & 1 else pa)
    return out


@functools.lru_cache(maxsize=2)
def case_areas(snap: str = "foreground") -> np.ndarray:
    """Triangle area of each case for unit spacing: vertices at the bone end of their edge, or at
    its middle. Triangles without area add nothing."""
    out = np.zeros(256)
    for case, triangles in enumerate(case_table()):
        at = np.array(_edge_points(case, snap), float)
        for a, b, c in triangles:
            out[case] += 0.5 * np.linalg.norm(np.cross(at[b] - at[a], at[c] - at[a]))
    return out


def case_histogram(bone: np.ndarray) -> np.ndarray:
    """Number of cubes of each case of a bone array with unset padding; unset corners are marked."""
    return np.bincount(corner_cases(~np.pad(bone, 1)).ravel(), minlength=256)


def binary_area(bone: np.ndarray, h: float, snap: str = "foreground") -> float:
    return float(case_histogram(bone) @ case_areas(snap) * h * h)


@functools.lru_cache(maxsize=1)
def _edge_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of the triangles of all cases in a row, each case's first triangle and number of triangles."""
    table = [np.array(t, int).reshape(-1, 3) for t in case_table()]
    n = np.array([len(t) for t in table])
    return np.concatenate(table), np.cumsum(n) - n, n


def isosurface(field: np.ndarray, level: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (x, y, z in lattice units) and triangles of a scalar field's level set. Values
    above the level are marked; vertices are interpolated on lattice edges, once for each."""
    case = corner_cases(field > level)
    at = np.flatnonzero((case > 0) & (case < 255))
    if not len(at):
        return np.zeros((0, 3)), np.zeros((0, 3), np.int64)
    at = at[np.argsort(case.reshape(-1)[at], kind="stable")]
    cases = case.reshape(-1)[at]
    triangles, first, n = _edge_table()
    base = np.ravel_multi_index(np.unravel_index(at, case.shape), field.shape)
    count = n[cases]
    edges = triangles[np.repeat(first[cases] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
    ends = np.array([[CORNERS[a], CORNERS[b]] for a, b in EDGES])[:, :, ::-1] @ np.array([field.shape[1] * field.shape[2], field.shape[2], 1])
    base = np.repeat(base, count)[:, None]
    key = (base + ends[edges, 0]) * field.size + base + ends[edges, 1]  # triangle, vertex
    keys, inverse = np.unique(key, return_inverse=True)
    a, b = keys // field.size, keys % field.size
    fa, fb = field.reshape(-1)[a], field.reshape(-1)[b]
    delta = fb - fa
    t = np.where(np.abs(delta) <= np.finfo(float).eps, 0.5, np.clip((level - fa) / np.where(delta == 0, 1, delta), 0, 1))
    pa = np.stack(np.unravel_index(a, field.shape), axis=1)[:, ::-1]
    pb = np.stack(np.unravel_index(b, field.shape), axis=1)[:, ::-1]
    triangles = inverse.reshape(-1, 3)
    keep = (triangles[:, 0] != triangles[:, 1]) & (triangles[:, 1] != triangles[:, 2]) & (triangles[:, 0] != triangles[:, 2])
    return pa + t[:, None] * (pb - pa), triangles[keep]


def triangle_vectors(vertices: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """Normals of length twice the area."""
    a, b, c = (vertices[triangles[:, k]] for k in range(3))
    return np.cross(b - a, c - a)


def vertex_areas(vertices: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """A third of the area of the triangles around each vertex."""
    area = np.linalg.norm(triangle_vectors(vertices, triangles), axis=1) / 6
    return np.bincount(triangles.ravel(), np.repeat(area, 3), len(vertices))
