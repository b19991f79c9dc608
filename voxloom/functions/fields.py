"""Smoothed signed distance, curvature and the surface-normal tensor of a specimen."""

from __future__ import annotations

import numpy as np

from voxloom.functions import surfaces
from voxloom.functions.voxels import MorphometryError, squared_distance

SUPPORT_SIGMAS = 4.0
W102_SIGMA_UM, W102_MARGIN_UM, W102_LEAST_TRIANGLES = 30.0, 160.0, 1000
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def signed_distance(bone: np.ndarray, h: float) -> np.ndarray:
    """Centre-to-centre distance, positive in bone and negative outside, over the whole image."""
    return h * (np.sqrt(squared_distance(bone)) - np.sqrt(squared_distance(~bone)))


def gaussian_kernel(sigma: float) -> np.ndarray:
    r = int(np.floor(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return k / k.sum()


def smooth(f: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian, axis by axis from x to z, with the border value beyond the border."""
    k = gaussian_kernel(sigma)
    r = len(k) // 2
    for axis in (2, 1, 0):
        n = f.shape[axis]
        padded = np.pad(f, [(r, r) if a == axis else (0, 0) for a in range(3)], mode="edge")
        f = sum(w * np.take(padded, range(i, i + n), axis=axis) for i, w in enumerate(k))
    return f


def curvature(phi: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and Gaussian curvature of the level sets through each voxel; NaN within two voxels of
    the border and where the gradient vanishes.

    Mean curvature is half the divergence of the outward normal -grad / |grad|, all by central
    differences; Gaussian curvature is grad' adj(Hessian) grad / |grad|**4, whose second
    derivatives are central differences of central differences.
    """
    def d(f, axis):
        out = np.full_like(f, np.nan)
        mid = [slice(None)] * 3
        up, down = list(mid), list(mid)
        mid[axis], up[axis], down[axis] = slice(1, -1), slice(2, None), slice(None, -2)
        out[tuple(mid)] = (f[tuple(up)] - f[tuple(down)]) / (2 * h)
        return out

    gz, gy, gx = (d(phi, a) for a in range(3))
    norm = np.sqrt(gx * gx + gy * gy + gz * gz)
    safe = np.maximum(norm, np.finfo(float).eps)
    mean = 0.5 * (d(-gx / safe, 2) + d(-gy / safe, 1) + d(-gz / safe, 0))
    xx, yy, zz = d(gx, 2), d(gy, 1), d(gz, 0)
    xy, xz, yz = d(gx, 1), d(gx, 0), d(gy, 0)
    top = (
        gx * gx * (yy * zz - yz * yz) + gy * gy * (xx * zz - xz * xz) + gz * gz * (xx * yy - xy * xy)
        + 2 * (gx * gy * (xz * yz - xy * zz) + gx * gz * (xy * yz - xz * yy) + gy * gz * (xy * xz - yz * xx))
    )
    gauss = top / np.maximum(norm, np.finfo(float).eps) ** 4
    inner = np.zeros(phi.shape, bool)
    inner[2:-2, 2:-2, 2:-2] = True
    ok = inner & np.isfinite(mean) & np.isfinite(gauss)
    return np.where(ok, mean, np.nan), np.where(ok, gauss, np.nan)


def curvature_samples(bone: np.ndarray, h: float, points: np.ndarray, sigma_um: float = 30.0) -> list[dict[str, float]]:
    """Smoothed distance and both curvatures at given voxels (x, y, z); a point outside the volume or
    without a whole stencil is an error."""
    if not (np.isfinite(sigma_um) and sigma_um > 0):
        raise MorphometryError("sigma must be finite and positive")
    phi = smooth(signed_distance(bone, h), sigma_um / h)
    mean, gauss = curvature(phi, h)
    out = []
    for x, y, z in np.asarray(points, int).reshape(-1, 3).tolist():
        if not (0 <= x < phi.shape[2] and 0 <= y < phi.shape[1] and 0 <= z < phi.shape[0]):
            raise MorphometryError(f"({x}, {y}, {z}) is outside the volume")
        if not (np.isfinite(mean[z, y, x]) and np.isfinite(gauss[z, y, x])):
            raise MorphometryError(f"({x}, {y}, {z}) has no curvature stencil")
        out.append({"x": x, "y": y, "z": z, "phi": float(phi[z, y, x]), "mean": float(mean[z, y, x]), "gauss": float(gauss[z, y, x])})
    return out


def trilinear(f: np.ndarray, at: np.ndarray, outside: float) -> np.ndarray:
    """f (array [z, y, x]) at points (x, y, z); ``outside`` beyond the lattice. NaN corners with a
    weight make the value NaN."""
    size = np.array(f.shape[::-1])
    ok = np.all((at >= 0) & (at <= size - 1), axis=1) & np.isfinite(at).all(axis=1)
    low = np.minimum(np.floor(np.where(ok[:, None], at, 0)).astype(int), np.maximum(size - 2, 0))
    t = np.where(ok[:, None], at, 0) - low
    total = np.zeros(len(at))
    for x, y, z in surfaces.CORNERS:
        w = np.where(x, t[:, 0], 1 - t[:, 0]) * np.where(y, t[:, 1], 1 - t[:, 1]) * np.where(z, t[:, 2], 1 - t[:, 2])
        v = f[np.minimum(low[:, 2] + z, size[2] - 1), np.minimum(low[:, 1] + y, size[1] - 1), np.minimum(low[:, 0] + x, size[0] - 1)]
        total += np.where(w > 0, w * v, 0)
    return np.where(ok, total, outside)


def weighted_quantiles(v: np.ndarray, w: np.ndarray, q=QUANTILES) -> list[float]:
    """Values interpolated over the share of weight up to and with each point; the first value
    below the first share."""
    order = np.argsort(v, kind="stable")
    v, share = v[order], np.cumsum(w[order])
    return [float(np.interp(p, share / share[-1], v)) for p in q]


def curvature_stats(bone: np.ndarray, roi: np.ndarray, h: float, sigma_um: float = 30.0, margin_sigmas: float = SUPPORT_SIGMAS) -> dict[str, float]:
    """Area-weighted curvature of the smoothed surface inside the region and a margin."""
    phi = smooth(signed_distance(bone, h), sigma_um / h)
    if phi.min() > 0 or phi.max() < 0:
        raise MorphometryError("the smoothed distance has one sign")
    vertices, triangles = surfaces.isosurface(phi)
    if not len(triangles):
        raise MorphometryError("no surface")
    w = surfaces.vertex_areas(vertices * h, triangles)
    size = np.array(phi.shape[::-1])
    edge = np.minimum(vertices, size - 1 - vertices).min(axis=1) * h
    mean_at, gauss_at = (trilinear(f, vertices, np.nan) for f in curvature(phi, h))
    bad = ~np.isfinite(w) | (w <= 0)
    margin = ~bad & (edge < margin_sigmas * sigma_um)
    outside = ~bad & ~margin & (trilinear(roi.astype(float), vertices, 0.0) < 0.5)
    invalid = ~bad & ~margin & ~outside & ~(np.isfinite(mean_at) & np.isfinite(gauss_at))
    use = ~(bad | margin | outside | invalid)
    out = {"n_vertices": len(vertices), "n_used": int(use.sum()), "n_margin": int(margin.sum()), "n_outside": int(outside.sum()), "n_invalid": int(invalid.sum()), "area": float(w.sum()), "area_used": float(w[use].sum())}
    return out | curvature_summary(mean_at[use], gauss_at[use], w[use])


def curvature_summary(mean: np.ndarray, gauss: np.ndarray, w: np.ndarray) -> dict[str, float]:
    """Area-weighted summary of mean (H) and Gaussian (K) curvature; NaN without points."""
    names = ("h_mean", "h_sd", "h_abs_mean", "k_median", "k_iqr", "k_abs_p90", "k_abs_p99", "saddle", "convex", "concave", "negative_discriminant")
    if not len(w):
        return dict.fromkeys(names, float("nan"))
    p = w / w.sum()
    h = float(p @ mean)
    q25, q50, q75 = weighted_quantiles(gauss, w, (0.25, 0.5, 0.75))
    a90, a99 = weighted_quantiles(np.abs(gauss), w, (0.9, 0.99))
    share = lambda at: float(p[at].sum())
    sd = float(np.sqrt(max(p @ mean**2 - h * h, 0)))
    saddle, disc = gauss < 0, mean**2 - gauss < 0
    values = (h, sd, float(p @ np.abs(mean)), q50, q75 - q25, a90, a99, share(saddle), share(~saddle & (mean >= 0)), share(~saddle & (mean < 0)), share(disc))
    return dict(zip(names, values, strict=True))


def w102(bone: np.ndarray, roi: np.ndarray, h: float, sigma_um: float = W102_SIGMA_UM, margin_um: float = W102_MARGIN_UM, least: int = W102_LEAST_TRIANGLES) -> dict[str, float]:
    """Surface-normal tensor, a third of the integral of n n' over the smoothed surface, with its
    anisotropy; triangles near the region's or the image's border are left out."""
    if roi.all() or not roi.any():
        raise MorphometryError("the region is trivial")
    phi = smooth(signed_distance(bone, h), sigma_um / h)
    if not phi.min() < 0 < phi.max():
        raise MorphometryError("the smoothed distance has one sign")
    vertices, triangles = surfaces.isosurface(phi)
    centre = vertices[triangles].mean(axis=1) if len(triangles) else np.zeros((0, 3))
    size = np.array(phi.shape[::-1])
    image = np.minimum(centre, size - 1 - centre).min(axis=1) * h if len(centre) else np.zeros(0)
    inside = trilinear(h * np.sqrt(squared_distance(roi)), centre, 0.0)
    normal = surfaces.triangle_vectors(vertices * h, triangles)
    length = np.linalg.norm(normal, axis=1)
    use = (image >= margin_um) & (inside >= margin_um) & (length > 0)
    if use.sum() < least:
        raise MorphometryError(f"{int(use.sum())} triangles with support; {least} are needed")
    n, area = normal[use] / length[use, None], length[use] / 2
    tensor = np.einsum("i,ij,ik->jk", area, n, n) / 3
    return {"triangles": int(use.sum()), "area": float(area.sum())} | tensor_anisotropy(tensor)


def tensor_anisotropy(tensor: np.ndarray) -> dict[str, float]:
    e = np.sort(np.abs(np.linalg.eigvalsh(tensor)))
    return {"w102_da": float(1 - e[0] / e[2]), "w102_mid_over_max": float(e[1] / e[2])}
