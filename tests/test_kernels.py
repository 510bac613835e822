"""Kernels against analytic cases and sampling."""

import numpy as np
import pytest

from tessera.functions import kernels as K
from tessera.plans.tree import STRATEGIES, build, refit, search

rng = np.random.default_rng(3)


def tri(*points):
    return tuple(np.array([p], float) for p in points)


@pytest.mark.parametrize(
    "s, t, meet",
    [
        (((0, 0, 0), (2, 0, 0), (0, 2, 0)), ((0.5, 0.5, -1), (0.5, 0.5, 1), (1, 1, 1)), True),
        (((0, 0, 0), (2, 0, 0), (0, 2, 0)), ((0.5, 0.5, 0.1), (0.5, 0.5, 1), (1, 1, 1)), False),
        (((0, 0, 0), (2, 0, 0), (0, 2, 0)), ((0.2, 0.2, 0), (3, 0.2, 0), (0.2, 3, 0)), True),  # coplanar
        (((0, 0, 0), (2, 0, 0), (0, 2, 0)), ((3, 3, 0), (4, 3, 0), (3, 4, 0)), False),
        (((0, 0, 0), (2, 0, 0), (0, 2, 0)), ((2, 0, 0), (3, 0, 1), (3, 0, -1)), True),  # touching at a corner
        (((0, 0, 0), (2, 0, 0), (0, 2, 0)), ((0, 0, 1), (2, 0, 1), (0, 2, 1)), False),  # parallel
        (((0, 0, 0), (2, 0, 0), (0, 2, 0)), ((0.5, 0.5, -1), (0.5, 0.5, 1), (0.5, 0.5, 1)), True),  # a segment
    ],
)
def test_triangle_pairs(s, t, meet):
    for a, b in ((s, t), (t, s)):
        got, _, _ = K.triangle_triangle(tri(*a), tri(*b))
        assert bool(got[0]) == meet
        d, p, q = K.triangle_distance(tri(*a), tri(*b))
        assert (d[0] == 0) == meet
        assert np.isclose(np.linalg.norm(p - q), d[0])


def test_intersection_segment_lies_on_both():
    s, t = (tuple(rng.normal(size=(2000, 3)) for _ in range(3)) for _ in range(2))
    meet, a, b = K.triangle_triangle(s, t)
    assert 0 < meet.sum() < 2000
    for p in (a, b):
        for k in (s, t):
            near = K.closest_on_triangle(p[meet], *(x[meet] for x in k))
            assert np.abs(near - p[meet]).max() < 1e-9


def test_triangle_distance_is_least_of_samples():
    s, t = (tuple(rng.normal(size=(50, 3)) for _ in range(3)) for _ in range(2))
    t = tuple(x + [4, 0, 0] for x in t)
    d, _, _ = K.triangle_distance(s, t)
    w = rng.dirichlet([1, 1, 1], size=400)
    p, q = (np.einsum("kw,wnc->nkc", w, np.stack(x)) for x in (s, t))
    sampled = np.linalg.norm(p[:, :, None] - q[:, None], axis=3).min((1, 2))
    assert (d <= sampled + 1e-12).all() and (sampled - d).max() < 0.5


def test_sphere_distance_is_analytic():
    n = 60
    u, v = np.meshgrid(np.linspace(0, np.pi, n), np.linspace(0, 2 * np.pi, 2 * n), indexing="ij")
    grid = np.stack([np.sin(u) * np.cos(v), np.sin(u) * np.sin(v), np.cos(u)], -1)
    a, b, c, e = grid[:-1, :-1], grid[1:, :-1], grid[:-1, 1:], grid[1:, 1:]
    tris = [np.concatenate([x.reshape(-1, 3), y.reshape(-1, 3)]) for x, y in ((a, b), (b, e), (c, c))]
    for p in rng.normal(size=(20, 3)) * 2:
        k = K.closest_on_triangle(np.broadcast_to(p, tris[0].shape), *tris)
        assert abs(np.linalg.norm(k - p, axis=1).min() - abs(1 - np.linalg.norm(p))) < 0.01


def test_box_triangle_matches_distance():
    n = 3000
    mid, half = rng.normal(size=(n, 3)), rng.uniform(0.1, 1, size=(n, 3))
    s = tuple(rng.normal(size=(n, 3)) * 2 for _ in range(3))
    got = K.aligned_box_triangle(mid - half, mid + half, s)
    same = K.box_triangle(np.tile(np.eye(4).ravel(), (n, 1)), mid - half, mid + half, s)
    assert (got == same).all() and 0 < got.sum() < n
    w = rng.dirichlet([1, 1, 1], size=3000)
    inside = (np.abs(np.einsum("kw,wnc->nkc", w, np.stack(s)) - mid[:, None]) <= half[:, None]).all(2).any(1)
    assert not (inside & ~got).any()


def test_box_distance():
    one = np.eye(4).ravel()[None]
    zero, unit = np.zeros((1, 3)), np.ones((1, 3))
    assert K.box_box_distance(one, zero, unit, zero + [3, 0, 0], unit + [3, 0, 0])[0] == 2
    assert K.box_box_distance(one, zero, unit, zero + 0.2, zero + 0.4)[0] == 0


def test_segments_and_points():
    gap2, t, s = K.ray_segment(*tri((0, 0, 0), (1, 0, 0), (5, 1, -1), (5, 1, 1)))
    assert gap2[0] == 1 and t[0] == 5 and s[0] == 0.5
    gap2, t = K.ray_point(*tri((0, 0, 0), (1, 0, 0), (-3, 4, 0)))
    assert gap2[0] == 25 and t[0] == 0


def test_hull():
    p = np.concatenate([rng.uniform(-1, 1, (500, 2)), [[-2, -2], [2, -2], [2, 2], [-2, 2], [0, -2]]])
    assert K.convex_hull(p).tolist() == [[-2, -2], [2, -2], [2, 2], [-2, 2]]
    assert not len(K.convex_hull(p[:2])) and not len(K.convex_hull(np.array([[0, 0], [1, 1], [2, 2.0]])))


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_tree_search_equals_brute_force(strategy):
    low = rng.normal(size=(3000, 3))
    high = low + rng.uniform(0, 0.2, size=(3000, 3))
    t = build(low, high, strategy)
    inner = t.parent >= 0
    assert (t.low[t.parent[inner]] <= t.low[inner]).all() and (t.high[t.parent[inner]] >= t.high[inner]).all()
    q = rng.normal(size=(40, 3))
    found = []
    search(t, 40, lambda i, n: ((t.low[n] <= q[i] + 0.1) & (t.high[n] >= q[i])).all(1), lambda i, p: found.extend(zip(i, p)), most=64)
    hits = {(int(i), int(p)) for i, p in found if (low[p] <= q[i] + 0.1).all() and (high[p] >= q[i]).all()}
    want = {(i, p) for i in range(40) for p in np.flatnonzero((low <= q[i] + 0.1).all(1) & (high >= q[i]).all(1)).tolist()}
    assert hits == want
    refit(t, low + 1, high + 1)
    assert np.allclose(t.low[0], low.min(0) + 1)


def test_identical_boxes_stay_one_leaf():
    t = build(np.zeros((100, 3)), np.ones((100, 3)), "sah")
    assert len(t.right) == 1 and t.count[0] == 100
    assert len(build(np.zeros((0, 3)), np.zeros((0, 3))).right) == 1
