"""Facts that the kernels must reproduce, and properties on random volumes."""

import math

import numpy as np
import pytest

from voxloom.functions import fields, intercepts, networks, shape, surfaces, thinning, voxels
from voxloom.functions.voxels import MorphometryError


def volume(n, points):
    v = np.zeros((n, n, n), bool)
    for x, y, z in points:
        v[z, y, x] = True
    return v


def cube(n, lo, hi):
    v = np.zeros((n, n, n), bool)
    v[lo : hi + 1, lo : hi + 1, lo : hi + 1] = True
    return v


def blobs(seed, n=20, k=25):
    rng = np.random.default_rng(seed)
    g, v = np.indices((n, n, n)), np.zeros((n, n, n), bool)
    for _ in range(k):
        v |= ((g - rng.integers(0, n, 3)[:, None, None, None]) ** 2).sum(0) <= rng.integers(2, 5) ** 2
    return v


def test_single_voxel_and_bar():
    m = voxels.cubical_measures(volume(5, [(2, 2, 2)]))
    assert (m["euler"], m["breadth"]) == (1, 1.5)
    m = voxels.cubical_measures(volume(5, [(1, 1, 1), (2, 1, 1)]))
    assert (m["euler"], m["breadth"]) == (1, 2.0)
    full = np.ones((5, 5, 5), bool)
    assert voxels.interface_faces(volume(5, [(2, 2, 2)]), full) == 6
    assert voxels.interface_faces(volume(5, [(1, 1, 1), (2, 1, 1)]), full) == 10


def test_box_frame():
    edge = [(x, y, z) for x in range(2, 7) for y in range(2, 7) for z in range(2, 7) if sum(c in (2, 6) for c in (x, y, z)) >= 2]
    m = voxels.cubical_measures(volume(9, edge))
    assert (m["euler"], m["connectivity"]) == (-4, 5)


def test_corner_voxel_correction():
    m = voxels.cubical_measures(volume(5, [(0, 0, 0)]))
    assert (m["edge_correction"], m["delta_chi"], m["connectivity"]) == (0.875, 0.125, 0.875)


def test_region_cut():
    roi = cube(5, 1, 3)
    assert voxels.interface_faces(volume(5, [(1, 2, 2)]), roi) == 5
    full = cube(5, 1, 3)
    assert voxels.boundary_bone_fraction(full & ~cube(5, 2, 2), roi) == 1
    assert math.isnan(voxels.boundary_bone_fraction(np.zeros_like(roi), roi))


def test_betti():
    assert voxels.betti(volume(5, [(1, 1, 1), (2, 2, 2)])) == (1, 0, 0)
    assert voxels.betti(volume(5, [(1, 1, 1), (3, 3, 3)]))[0] == 2
    shell = cube(5, 1, 3) & ~cube(5, 2, 2)
    assert voxels.betti(shell) == (1, 0, 1) and voxels.cubical_measures(shell)["euler"] == 2


def test_distance_is_exact():
    for seed in range(3):
        v = blobs(seed, 12, 8)
        d, out = voxels.squared_distance(v), np.argwhere(~v)
        assert all(d[tuple(p)] == ((out - p) ** 2).sum(1).min() for p in np.argwhere(v)[::7])
    with pytest.raises(MorphometryError):
        voxels.squared_distance(np.ones((3, 3, 3), bool))


def test_thickness_facts():
    assert voxels.ridge_limits(1) == (4, 5, 6)
    assert voxels.local_thickness(volume(3, [(1, 1, 1)])).max() == 2
    v = cube(5, 1, 3)
    assert (voxels.local_thickness(v) > 0).sum() == 27
    d = voxels.distribution(np.array([1, 2, 3, 4], np.float32), 2.0)
    assert (d["mean"], d["max"]) == (5.0, 8.0) and d["median"] == 5.0
    q = voxels.distribution(np.array([1, 2, 3, 4], np.float32), 1.0)
    assert [round(q[k], 6) for k in ("p10", "median", "p90")] == [1.3, 2.5, 3.7]
    with pytest.raises(MorphometryError):
        voxels.distribution(np.zeros(3, np.float32), 1.0)


def test_ridge_balls_cover_the_phase():
    v = blobs(4)
    d2 = voxels.squared_distance(v)
    cover = voxels.propagate(d2, voxels.distance_ridge(d2))
    assert (cover[v] >= d2[v]).all()


def test_label_matches_flood():
    v = np.random.default_rng(0).random((9, 9, 9)) < 0.3
    for conn, offsets in ((6, voxels.OFFSETS6), (26, voxels.OFFSETS26)):
        left, n = {tuple(p) for p in np.argwhere(v)}, 0
        while left:
            n, stack = n + 1, [left.pop()]
            while stack:
                p = stack.pop()
                for o in offsets:
                    q = tuple(a + b for a, b in zip(p, o, strict=True))
                    if q in left:
                        left.remove(q)
                        stack.append(q)
        assert voxels.label(v, conn)[1] == n


def test_mesh_areas():
    full = np.ones((3, 3, 3), bool)
    assert surfaces.binary_area(full, 1.0) == pytest.approx(24)
    assert surfaces.binary_area(volume(3, [(1, 1, 1)]), 1.0) == 0
    assert surfaces.case_areas("middle")[1] == pytest.approx(math.sqrt(3) / 8)


def test_isosurface_is_closed():
    f = np.pad(np.random.default_rng(1).normal(size=(9, 9, 9)), 1, constant_values=-1)
    _, t = surfaces.isosurface(f)
    edges = {}
    for tri in t.tolist():
        for k in range(3):
            e = (tri[k], tri[(k + 1) % 3])
            edges[e] = edges.get(e, 0) + 1
    assert all(edges.get((b, a)) == n for (a, b), n in edges.items())


def test_skeleton_keeps_topology():
    for seed in range(3):
        v = blobs(seed)
        s = thinning.skeletonize(v)
        # a small piece whose voxels are all candidates of one pass may vanish; nothing else changes
        a, b = voxels.betti(v), voxels.betti(s)
        assert not (s & ~v).any() and b[1:] == a[1:] and 0 <= a[0] - b[0] <= 1


def test_euler_table():
    t = dict(thinning.euler_table())
    assert [t[k] for k in (1, 105, 129, 233, 255)] == [1, 5, -7, 5, -1]


def test_graph_facts():
    s = networks.Network.of(volume(7, [(3, 2, 3), (4, 3, 3), (3, 4, 3), (2, 3, 3)]), 1.0).stats()
    assert (s["branches"], s["cycle_rank"]) == (1, 1) and s["mean_length"] == pytest.approx(3 * math.sqrt(2))
    c = 10
    y = [(x, c, c) for x in range(5, 16)] + [(c, k, c) for k in range(c, 16)]
    s = networks.Network.of(volume(21, y), 1.0).stats()
    assert (s["branches"], s["cycle_rank"], s["max_length"]) == (3, 0, 6.0) and s["mean_length"] == pytest.approx((14 + math.sqrt(2)) / 3)
    loop = [(c, c - 1, c), (c + 1, c, c), (c, c + 1, c), (c - 1, c, c)] + [(x, c, c) for x in range(c + 1, 17)]
    s = networks.Network.of(volume(21, loop), 1.0).stats()
    assert (s["branches"], s["cycle_rank"]) == (2, 1) and s["mean_length"] == pytest.approx((3 * math.sqrt(2) + 5) / 2)
    s = networks.Network.of(volume(5, [(1, 2, 2), (2, 2, 2), (3, 2, 2)]), 1.0).stats()
    assert (s["mean_length"], s["mean_tortuosity"]) == (2.0, 1.0)


def axial(zs, edges):
    return networks.Axial([[(0, 0, z)] for z in zs], [networks.Edge(*e) for e in edges], [(0, 0, z) for z in zs], 1.0).stats()


def test_axial_facts():
    s = axial([0, 4, 8], [(0, 1, 4.0), (1, 2, 4.0)])
    assert (s["path_fraction"], s["edge_connectivity"], s["axial_tortuosity"]) == (1, 1, 1)
    s = axial([0, 4, 4, 8], [(0, 1, 4.0), (0, 2, 4.0), (1, 3, 4.0), (2, 3, 4.0)])
    assert (s["path_fraction"], s["edge_connectivity"]) == (1, 2) and s["energy_error"] < 1e-12
    assert axial([0, 4, 8, 4], [(0, 1, 4.0), (1, 2, 4.0), (1, 3, 2.0)])["path_fraction"] == pytest.approx(0.8)
    with pytest.raises(MorphometryError):
        axial([0, 4, 8], [(0, 1, 4.0)])


def dense(a):
    """Potentials by elimination."""
    g = np.zeros((a.n, a.n))
    for (u, w), ls in a.pairs.items():
        g[u, w] = g[w, u] = sum(1 / x for x in ls if x > 0)
    lap = np.diag(g.sum(axis=1)) - g
    fixed = np.array([k in a.top or k in a.bottom for k in range(a.n)])
    v = np.array([1.0 if k in a.top else 0.0 for k in range(a.n)])
    v[~fixed] = np.linalg.lstsq(lap[np.ix_(~fixed, ~fixed)], -lap[np.ix_(~fixed, fixed)] @ v[fixed], rcond=None)[0]
    return v


def test_potentials_against_elimination():
    rng = np.random.default_rng(12)
    for _ in range(20):
        n = int(rng.integers(6, 40))
        zs = np.r_[0, rng.integers(3, 30, n - 2), 33].tolist()
        edges = [(k, k + 1, float(rng.uniform(0.5, 9))) for k in range(n - 1)] + [(int(a), int(b), float(x)) for a, b, x in zip(*rng.integers(0, n, (2, 3 * n)), rng.uniform(0.5, 9, 3 * n), strict=True)]
        a = networks.Axial([[(0, 0, z)] for z in zs], [networks.Edge(*e) for e in edges], [(0, 0, z) for z in zs], 1.0)
        np.testing.assert_allclose(a.potentials(), dense(a), atol=1e-9)


def test_potentials_of_pieces_and_loose_ends():
    # a chain through, a piece at the top, one at the bottom, one at neither, a vertex on branches of length 0
    zs = [0, 10, 20, 0, 9, 11, 20, 8, 12, 10]
    edges = [(0, 1, 3.0), (1, 2, 1.0), (3, 4, 1.0), (5, 6, 1.0), (7, 8, 1.0), (1, 9, 0.0)]
    a = networks.Axial([[(0, 0, z)] for z in zs], [networks.Edge(*e) for e in edges], [(0, 0, z) for z in zs], 1.0)
    np.testing.assert_allclose(a.potentials(), [1, 0.25, 0, 1, 1, 0, 0, 0.5, 0.5, 0], atol=1e-12)


def test_ladder_conductance():
    """Two rails of n steps with rungs carry what two rails carry; a rail cut in the middle of each side leaves the way
    over the rungs: by series and parallel branches."""
    n = 12
    node = lambda side, k: side * (n + 1) + k
    zs = [4 * k for _ in (0, 1) for k in range(n + 1)]
    rails = [(node(s, k), node(s, k + 1), 4.0) for s in (0, 1) for k in range(n)]
    rungs = [(node(0, k), node(1, k), 3.0) for k in range(1, n)]
    assert axial(zs, rails + rungs)["conductance"] == pytest.approx(2.0)
    crossed = [e for e in rails if e[:2] not in ((node(0, 5), node(0, 6)), (node(1, 6), node(1, 7)))]
    one = [(node(0, 5), node(1, 5), 3.0), (node(0, 7), node(1, 7), 3.0)]
    # up the right rail to 6, over the rung, on by the left rail; rungs at 5 and 7 let the other rail help at both ends
    got = axial(zs, crossed + [(node(0, 6), node(1, 6), 3.0)])
    assert got["edge_connectivity"] == 1 and got["energy_error"] < 1e-9 and got["conductance"] == pytest.approx(4.0 * n / (20 + 4 + 3 + 4 + 20))
    end = 1 / (1 / 20 + 1 / 23)
    assert axial(zs, crossed + one + [(node(0, 6), node(1, 6), 3.0)])["conductance"] == pytest.approx(4.0 * n / (end + 11 + end))


def test_many_vertices_in_little_memory():
    """A grid of 140 x 140: its dense matrix would take 3 GB. Rows are at one height, so the flow is that of 140 rails."""
    m = 140
    at = lambda r, c: r * m + c
    zs = [3 * r for r in range(m) for _ in range(m)]
    edges = [networks.Edge(at(r, c), at(r + 1, c), 3.0) for r in range(m - 1) for c in range(m)] + [networks.Edge(at(r, c), at(r, c + 1), 2.0) for r in range(m) for c in range(m - 1)]
    a = networks.Axial([[(0, 0, z)] for z in zs], edges, [(0, 0, z) for z in zs], 1.0)
    v = a.potentials()
    np.testing.assert_allclose(v, [1 - r / (m - 1) for r in range(m) for _ in range(m)], atol=1e-8)


def test_window_moments_by_sums():
    """Look-ups in summed volumes and rows of balls against the windows' points themselves."""
    rng = np.random.default_rng(13)
    bone = rng.random((17, 20, 23)) < 0.4
    seeds = np.argwhere(bone)[::37]
    radius = rng.integers(3, 9, len(seeds))
    for ball, (n, first, second) in ((False, shape.cube_moments(bone, seeds, 4)), (True, shape.ball_moments(bone, seeds, radius))):
        lam, vec = shape.principal(n, first, second)
        for k, seed in enumerate(seeds):
            p = shape.window_points(bone, tuple(seed), int(radius[k]) if ball else 4, ball) - seed[::-1]
            assert n[k] == len(p) and first[k].tolist() == p.sum(axis=0).tolist()
            assert second[k].tolist() == [(p[:, i] * p[:, j]).sum() for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))]
            np.testing.assert_allclose(lam[k], np.linalg.eigvalsh(np.cov(p.T)), rtol=1e-9, atol=1e-12)
            np.testing.assert_allclose(np.cov(p.T) @ vec[k], vec[k] * lam[k], atol=1e-9)


def test_flat_windows_have_no_shape():
    v = np.zeros((9, 9, 9), bool)
    v[4, 2:7, 2:7] = True
    assert shape.cube_shapes(v, v, 4) == []
    v[5, 4, 4] = True
    assert len(shape.cube_shapes(v, v, 4)) == 26


def test_near_pairs_miss_none():
    rng = np.random.default_rng(14)
    for n, m in ((50, 70), (1, 30), (0, 5), (40, 0)):
        a, b = rng.integers(-20, 30, (n, 3)).astype(float), rng.integers(-20, 30, (m, 3)).astype(float)
        i, j = shape.near_pairs(a, b, 7.5)
        got = set(zip(i.tolist(), j.tolist(), strict=True))
        assert len(got) == len(i)
        assert {(x, y) for x in range(n) for y in range(m) if ((a[x] - b[y]) ** 2).sum() <= 7.5**2} <= got


def test_fewer_directions_are_the_first_ones():
    rng = np.random.default_rng(15)
    bone = rng.random((12, 10, 10)) < 0.4
    square = (1, 1, 8)
    for lines in (1, 5, 9):
        many = intercepts.cloud(bone, square, 7, 1, 40, lines)
        assert len(many) == 40
        for n in (9, 16, 33):
            assert (intercepts.cloud(bone, square, 7, 1, n, lines) == many[:n]).all()


def test_gini():
    assert math.isnan(networks.gini(np.array([]))) and networks.gini(np.array([0.0, -1.0])) == 0
    assert networks.gini(np.array([1.0, 1.0, 1.0])) == pytest.approx(0)


def test_sphere_curvature():
    g = np.indices((44, 44, 44))
    ball = ((g - 21.5) ** 2).sum(0) <= 144
    c = fields.curvature_stats(ball, np.ones_like(ball), 1.0, 1.5)
    assert c["h_mean"] == pytest.approx(1 / 12, rel=0.2) and c["k_median"] == pytest.approx(1 / 144, rel=0.35) and c["convex"] > 0.9


def test_gaussian_and_quantiles():
    assert fields.gaussian_kernel(1.2).sum() == pytest.approx(1)
    assert np.allclose(fields.smooth(np.full((5, 5, 5), 3.0), 1.0), 3.0)
    assert fields.weighted_quantiles(np.array([0.0, 10.0]), np.array([1.0, 1.0]), (0.5, 0.75)) == [0.0, 5.0]


def test_isotropic_tensor():
    assert fields.tensor_anisotropy(np.eye(3))["w102_da"] == pytest.approx(0)


def test_orientation_facts():
    assert shape.vmax() == pytest.approx(0.954077, abs=5e-5)
    a, b = shape.axis_angles(np.array([0.4, -0.2, 0.9])), shape.axis_angles(np.array([-0.4, 0.2, -0.9]))
    assert np.allclose(a, b)
    assert shape.axis_angles(np.array([0.0, -1.0, 1e-18]))[0] == pytest.approx(math.pi / 2)
    assert (shape.lifted_axes(np.array([-1e-15, 1.0, 2.0])) > 0).all()


def test_quadric_facts():
    d = np.random.default_rng(0).normal(size=(512, 3))
    d /= np.linalg.norm(d, axis=1)[:, None]
    assert intercepts.anisotropy(d)["da"] < 1e-10
    r = intercepts.anisotropy(d * [2, 3, 5] + [1, 2, 3])
    assert [r[k] for k in ("radius_a", "radius_b", "radius_c")] == pytest.approx([2, 3, 5], abs=1e-8)
    with pytest.raises(MorphometryError):
        intercepts.fit_quadric(d[:5])


def test_random_stream_and_rays():
    r = intercepts.SplitMix64(0)
    assert [r.next(), r.next()] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4]
    low, high = np.zeros(3), np.ones(3)
    assert intercepts.ray_box(np.array([-1.0, 0.5, 0.5]), np.array([1.0, 0, 0]), low, high) == (1.0, 2.0)
    assert intercepts.ray_box(np.array([2.0, 0.5, 0.5]), np.array([1.0, 0, 0]), low, high) is None
    assert intercepts.ray_box(np.array([-1.0, 2.0, 0.5]), np.array([1.0, 0, 0]), low, high) is None


def test_anisotropy_depends_on_seed_alone():
    v = blobs(2)
    a = intercepts.cloud(v, (0, 0, 20), 7, 0, 12, 9)
    assert np.array_equal(a, intercepts.cloud(v, (0, 0, 20), 7, 0, 12, 9)) and not np.array_equal(a, intercepts.cloud(v, (0, 0, 20), 7, 1, 12, 9))


def test_networks_of_random_skeletons():
    rng = np.random.default_rng(11)
    for k in range(150):
        n = int(rng.integers(3, 10))
        v = rng.random((n, n, n)) < rng.choice([0.05, 0.1, 0.2, 0.35])
        net = networks.Network.of(v, 1.0)
        up = list(range(len(net.nodes)))

        def find(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        touch = [0] * len(net.nodes)
        for e in net.edges:
            up[find(e.u)] = find(e.v)
            touch[e.u] += 1
            touch[e.v] += 1
            assert e.length >= (0 if e.pure_cycle else net.distance(net.nodes[e.u][0], net.nodes[e.v][0]) * (e.u < net.ends or e.v < net.ends) - 1e-9)
        assert len({find(i) for i in range(len(up))}) == net.pieces
        alone = sum(touch[i] == 0 and i < net.ends for i in range(len(up)))
        assert all(touch[i] <= 1 for i in range(net.ends)) and net.stats()["cycle_rank"] == len(net.edges) - len(net.nodes) + net.pieces
        assert alone <= net.pieces and {p for g in net.nodes for p in g} <= set(net.points)
        turned = networks.Network.of(v[::-1], 1.0)  # branches are the same whichever end is first
        same = lambda m: sorted(round(e.length, 9) for e in m.edges if e.u < m.ends and e.v < m.ends)
        assert same(net) == same(turned)


def test_lines_of_distances_need_no_offsets(monkeypatch):
    calls = []
    held = voxels.min_plus
    monkeypatch.setattr(voxels, "min_plus", lambda f, axis: calls.append((f.dtype.itemsize, axis)) or held(f, axis))
    rng = np.random.default_rng(0)
    for share in (0.1, 0.6, 0.97):
        v = rng.random((7, 9, 6)) < share
        v[3, 4, 2] = False
        off = np.argwhere(~v)
        want = np.where(v, ((np.indices(v.shape).reshape(3, -1).T[:, None] - off) ** 2).sum(axis=2).min(axis=1).reshape(v.shape), 0)
        assert np.array_equal(voxels.squared_distance(v), want)
    assert set(calls) == {(4, 1), (4, 0)}
