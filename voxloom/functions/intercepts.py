"""Mean-intercept-length anisotropy: seeded line sampling and a general quadric fit."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np

from voxloom.functions.voxels import MorphometryError

DIRECTIONS, LINES, INCREMENT, REPETITIONS = 1024, 64, math.sqrt(3), 5
SEED = 4778124954572866625
_MASK = (1 << 64) - 1
_GOLDEN = 0x9E3779B97F4A7C15


class SplitMix64:
    """Steele, Lea and Flood's generator; doubles from the upper 53 bits."""

    def __init__(self, seed: int):
        self.state = seed & _MASK

    def next(self) -> int:
        self.state = (self.state + _GOLDEN) & _MASK
        z = self.state
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _MASK
        z = (z ^ z >> 27) * 0x94D049BB133111EB & _MASK
        return z ^ z >> 31

    def double(self) -> float:
        return (self.next() >> 11) * 2.0**-53


class Doubles:
    """The doubles of ``SplitMix64``, made many at once: its state is a counter."""

    BLOCK = 4096

    def __init__(self, seed: int):
        self.state, self.held = seed & _MASK, iter(())

    def double(self) -> float:
        found = next(self.held, None)
        if found is None:
            at = np.uint64(self.state) + np.arange(self.BLOCK, dtype=np.uint64) * np.uint64(_GOLDEN)
            self.state = (self.state + self.BLOCK * _GOLDEN) & _MASK
            self.held = iter(((first_draws(at) >> np.uint64(11)) * 2.0**-53).tolist())
            found = next(self.held)
        return found


def first_draws(seeds: np.ndarray) -> np.ndarray:
    """First number of the stream of each seed, all at once."""
    z = seeds.astype(np.uint64) + np.uint64(_GOLDEN)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def repetition_seed(seed: int, rep: int) -> int:
    return (seed ^ (rep + 1) * _GOLDEN) & _MASK


def random_rotation(rng: SplitMix64) -> np.ndarray:
    """Uniform rotation matrix of a random unit quaternion (Shoemake, 1992)."""
    a, b, c = rng.double(), rng.double(), rng.double()
    s, t = math.sqrt(1 - a), math.sqrt(a)
    v = np.array([s * math.sin(2 * math.pi * b), s * math.cos(2 * math.pi * b), t * math.sin(2 * math.pi * c)])
    w = t * math.cos(2 * math.pi * c)
    cross = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + 2 * w * cross + 2 * cross @ cross


def domain(roi: np.ndarray) -> tuple[int, int, int]:
    """(x0, y0, side) of the largest centred square inside the region on every slice."""
    flat = roi.all(axis=0)
    h, w = flat.shape
    for side in range(min(h, w), 0, -1):
        x0, y0 = (w - side) // 2, (h - side) // 2
        if flat[y0 : y0 + side, x0 : x0 + side].all():
            return x0, y0, side
    raise MorphometryError("no centred square lies inside the region")


def ray_box(point: np.ndarray, direction: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[float, float] | None:
    """Parameters where a line enters and leaves a box; None if it misses it or the box lies
    wholly behind the point."""
    near, far = -math.inf, math.inf
    for p, d, a, b in zip(point, direction, low, high, strict=True):
        if abs(d) < 1e-12:
            if p < a or p > b:
                return None
            continue
        t, u = sorted(((a - p) / d, (b - p) / d))
        near, far = max(near, t), min(far, u)
    return None if near > far or far < 0 else (near, far)


def _cycles(square: tuple[int, int, int], depth: int, rotation: np.ndarray, rng: SplitMix64, lines: int, increment: float) -> Iterator[tuple[np.ndarray, list[tuple[int, float, int]], float]]:
    """Parallel lines of one direction: (points, used, total) of each cycle, with used lines as (point,
    start, samples) and the length so far. Lines start from strata of a plane as wide as the
    domain's diagonal, in shuffled cycles with one common offset, until they are ``lines`` diagonals
    long in total; the last is cut. No draw depends on the bone."""
    low, high = _box(square, depth)
    diagonal = _diagonal(square, depth)
    centre, along = (low + high) / 2, rotation[:, 2]
    m = math.isqrt(lines)
    target, total = lines * diagonal, 0.0
    order = list(range(m * m))
    rows, columns = (x / m for x in np.divmod(np.arange(m * m), m))
    while target - total > 1e-12:
        for i in range(len(order) - 1, 0, -1):
            j = min(int(rng.double() * (i + 1)), i)
            order[i], order[j] = order[j], order[i]
        du, dt = rng.double() / m, rng.double() / m
        u, t = rows[order], columns[order]
        points = centre + ((t + dt - 0.5) * diagonal)[:, None] * rotation[:, 0] + ((u + du - 0.5) * diagonal)[:, None] * rotation[:, 1]
        near, far = _chords(points, along, low, high)
        # one draw for each chord that is used, in the order of the cycle; sampling is done together
        used: list[tuple[int, float, int]] = []
        hit = np.flatnonzero(far > near)
        for k, a, b in zip(hit.tolist(), near[hit].tolist(), far[hit].tolist(), strict=True):
            if target - total <= 1e-12:
                break
            b = min(b, a + target - total)
            if b <= a:
                continue
            start = a + rng.double() * increment
            n = math.ceil((b - start) / increment)
            if n < 1:
                continue  # the draw is used up, no length is added
            used.append((k, start, n))
            total += b - a
        yield points, used, total


def _box(square: tuple[int, int, int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    x0, y0, side = square
    return np.array([x0, y0, 0.0]), np.array([x0 + side, y0 + side, float(depth)])


def _diagonal(square: tuple[int, int, int], depth: int) -> float:
    return math.sqrt(2 * square[2] * square[2] + depth * depth)


def intercept_length(bone: np.ndarray, square: tuple[int, int, int], rotation: np.ndarray, rng: SplitMix64, lines: int = LINES, increment: float = INCREMENT) -> float | None:
    """Line length for each phase change along the lines of one direction."""
    low, high = _box(square, len(bone))
    total, changes = 0.0, 0
    for points, used, total in _cycles(square, len(bone), rotation, rng, lines, increment):
        changes += _phase_changes(bone, points, rotation[:, 2], low, high, used, increment)
    return total / max(changes, 1) if total > 0 else None


def _chords(points: np.ndarray, along: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ray_box`` for many points; missed boxes have far < near."""
    if (np.abs(along) >= 1e-12).all():
        a, b = (low - points) / along, (high - points) / along
        near, far = np.minimum(a, b).max(axis=1), np.maximum(a, b).min(axis=1)
        return near, np.where(far < 0, -np.inf, far)
    near, far = np.full(len(points), -np.inf), np.full(len(points), np.inf)
    for axis in range(3):
        p, d = points[:, axis], along[axis]
        if abs(d) < 1e-12:
            far = np.where((p < low[axis]) | (p > high[axis]), -np.inf, far)
            continue
        a, b = (low[axis] - p) / d, (high[axis] - p) / d
        near, far = np.maximum(near, np.minimum(a, b)), np.minimum(far, np.maximum(a, b))
    return near, np.where(far < 0, -np.inf, far)


def _samples(points, along, low, high, start, n, increment) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Voxels (x, y, z) of the samples of lines (point, axis, start, number), which of them lie in the box, and each
    line's first."""
    first = np.cumsum(n) - n
    step = np.arange(int(n.sum())) - np.repeat(first, n)
    p = np.floor(np.repeat(points, n, axis=0) + (np.repeat(start, n) + step * increment)[:, None] * np.repeat(along, n, axis=0)).astype(int)
    return p, ((p >= low) & (p < high)).all(axis=1), first


def _phase_changes(bone, points, along, low, high, used, increment) -> int:
    if not used:
        return 0
    line, start, n = (np.array(x) for x in zip(*used, strict=True))
    p, ok, first = _samples(points[line], np.tile(along, (len(line), 1)), low, high, start, n, increment)
    q = np.where(ok[:, None], p, 0)
    on = ok & bone[q[:, 2], q[:, 1], q[:, 0]]
    return int(np.count_nonzero(_changes(on, first)))


def _changes(on: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(on)
    before[1:] = on[:-1]
    before[first] = False  # every line starts outside
    return on != before


#: Samples of a repetition up to which its lines are kept for the next volume with the same domain, and how many
#: repetitions are kept: those of the whole sweep (5 line counts, 3 repetitions), at 2 bytes a sample.
KEPT_SAMPLES, KEPT = 6_000_000, 16


def kept(square: tuple[int, int, int], shape: tuple[int, int, int], directions: int, lines: int, increment: float) -> bool:
    """Whether a repetition is small enough that its lines are kept."""
    return directions * lines * _diagonal(square, shape[0]) / increment <= KEPT_SAMPLES and math.prod(shape) < 1 << 31


@functools.lru_cache(maxsize=KEPT)
def _kept_lines(square: tuple[int, int, int], shape: tuple[int, int, int], seed: int, rep: int, directions: int, lines: int, increment: float) -> tuple[np.ndarray, ...]:
    """All samples of a repetition: flat voxel of each (one past the last if outside), each line's
    first, each direction's first, its axis and its length."""
    rng = Doubles(repetition_seed(seed, rep))
    low, high = _box(square, shape[0])
    outside = int(np.prod(shape))
    kind = np.uint16 if outside < 1 << 16 else np.int32
    at, firsts, starts, axes, lengths, n = [], [], [], [], [], 0
    waiting: list[tuple] = []  # lines of several directions are sampled together
    samples = 0

    def sample() -> None:
        nonlocal n, samples
        if waiting:
            points, along, start, count = (np.concatenate(x) for x in zip(*waiting, strict=True))
            p, ok, first = _samples(points, along, low, high, start, count, increment)
            at.append(np.where(ok, (p[:, 2] * shape[1] + p[:, 1]) * shape[2] + p[:, 0], outside).astype(kind))
            firsts.append(first + n)
            n += len(p)
            waiting.clear()
            samples = 0

    for _ in range(directions):
        rotation = random_rotation(rng)
        total, start = 0.0, n + samples
        for points, used, total in _cycles(square, shape[0], rotation, rng, lines, increment):
            if used:
                line, begin, count = (np.array(x) for x in zip(*used, strict=True))
                waiting.append((points[line], np.tile(rotation[:, 2], (len(line), 1)), begin, count))
                samples += int(count.sum())
        if total > 0:
            starts.append(start)
            axes.append(rotation[:, 2])
            lengths.append(total)
        if samples > 1 << 16:
            sample()
    sample()
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(at, kind), join(firsts, int), np.array(starts, int), np.array(axes).reshape(-1, 3), np.array(lengths)


def cloud(bone: np.ndarray, square: tuple[int, int, int], seed: int, rep: int, directions: int = DIRECTIONS, lines: int = LINES, increment: float = INCREMENT) -> np.ndarray:
    """Points direction * intercept length of one repetition, whose draws come from one stream.
    Lines do not depend on the bone, so those of small volumes are drawn once for all volumes with
    the same domain; the points are the same either way."""
    if kept(square, bone.shape, directions, lines, increment):
        at, first, start, axes, length = _kept_lines(square, bone.shape, seed, rep, directions, lines, increment)
        if not len(start):
            return np.zeros((0, 3))
        changes = np.add.reduceat(_changes(np.append(bone.ravel(), False)[at], first), start, dtype=int)
        return axes * (length / np.maximum(changes, 1))[:, None]
    rng = SplitMix64(repetition_seed(seed, rep))
    out = []
    for _ in range(directions):
        rotation = random_rotation(rng)
        m = intercept_length(bone, square, rotation, rng, lines, increment)
        if m is not None:
            out.append(rotation[:, 2] * m)
    return np.array(out).reshape(-1, 3)


#: Volumes that are sampled together, a bit of a byte each; and a byte's bits as the bytes of a word.
TOGETHER = 8
_SPREAD = np.array([sum((b >> k & 1) << 8 * k for k in range(TOGETHER)) for b in range(256)], np.uint64)
#: Words of changes that are summed at once: as many as stay in a core's cache.
_BLOCK = 1 << 16


def clouds(bits: np.ndarray, n: int, square: tuple[int, int, int], seed: int, rep: int, directions: int = DIRECTIONS, lines: int = LINES, increment: float = INCREMENT) -> list[np.ndarray]:
    """``cloud`` of each of n volumes (up to ``TOGETHER``) of one shape and domain, volume k in bit k of ``bits``. Kept
    lines are followed once for all; their changes are counted in the bytes of a word, piece by piece of
    at most 255 samples, so none runs over. The points are those of ``cloud``."""
    if not kept(square, bits.shape, directions, lines, increment):
        return [cloud(bits >> k & 1 > 0, square, seed, rep, directions, lines, increment) for k in range(n)]
    at, first, start, axes, length = _kept_lines(square, bits.shape, seed, rep, directions, lines, increment)
    if not len(start):
        return [np.zeros((0, 3))] * n
    on = np.append(bits.ravel(), np.uint8(0))[at]
    change = on.copy()
    change[1:] ^= on[:-1]
    change[first] = on[first]  # every line starts outside
    pieces = -(-np.diff(np.append(start, len(at))) // 255)
    of = np.cumsum(pieces) - pieces
    cut = np.repeat(start, pieces) + 255 * (np.arange(int(pieces.sum())) - np.repeat(of, pieces))
    held = np.empty(len(cut), "<u8")
    step = _BLOCK // 255
    for k in range(0, len(cut), step):
        end = cut[k + step] if k + step < len(cut) else len(at)
        held[k : k + step] = np.add.reduceat(_SPREAD[change[cut[k] : end]], cut[k : k + step] - cut[k])
    changes = np.add.reduceat(held.view(np.uint8).reshape(-1, TOGETHER), of, axis=0, dtype=int)
    return [axes * (length / np.maximum(changes[:, k], 1))[:, None] for k in range(n)]


def fit_quadric(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and eigenvectors of the ellipsoid that fits points best, as a general
    quadric of nine parameters moved to its centre and normalised."""
    if len(points) < 9:
        raise MorphometryError("a quadric needs nine points")
    x, y, z = points.T
    rows = np.stack([x * x, y * y, z * z, 2 * x * y, 2 * x * z, 2 * y * z, 2 * x, 2 * y, 2 * z], axis=1)
    try:
        a, b, c, d, e, f, g, h, i = np.linalg.solve(rows.T @ rows, rows.sum(axis=0))
        shape, slope = np.array([[a, d, e], [d, b, f], [e, f, c]]), np.array([g, h, i])
        centre = -np.linalg.solve(shape, slope)
    except np.linalg.LinAlgError as why:
        raise MorphometryError("the quadric is singular") from why
    lam, vec = np.linalg.eigh(shape / (1 + centre @ shape @ centre))
    if not (lam > 0).all():
        raise MorphometryError("the quadric is no ellipsoid")
    return lam, vec


def anisotropy(points: np.ndarray) -> dict[str, float]:
    lam, vec = fit_quadric(points)
    radii = 1 / np.sqrt(lam)
    return {"da": float(1 - lam[0] / lam[2]), "angle_deg": float(np.degrees(np.arccos(min(abs(vec[2, 0]), 1)))), "radius_a": float(radii[2]), "radius_b": float(radii[1]), "radius_c": float(radii[0]), "d1": float(lam[0]), "d2": float(lam[1]), "d3": float(lam[2])}


def over_repetitions(reps: list[dict[str, float]]) -> dict[str, float]:
    """Summary of one specimen's repetitions."""
    da = np.array([x["da"] for x in reps])
    sd = float(da.std(ddof=1)) if len(da) > 1 else 0.0
    mean = {f"{k}_mean" if k == "angle" else k: float(np.mean([x[name] for x in reps])) for k, name in (("angle", "angle_deg"), ("radius_a", "radius_a"), ("radius_b", "radius_b"), ("radius_c", "radius_c"))}
    return {"da_mean": float(da.mean()), "da_sd": sd, "da_cv": sd / abs(da.mean()) if da.mean() else float("nan"), "da_min": float(da.min()), "da_max": float(da.max())} | mean
