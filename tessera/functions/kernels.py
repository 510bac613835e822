"""Geometry kernels over NumPy batches, for what branches too much for expressions.

All arrays have one row per item; points are n x 3. Expressions in
functions.exact that have a twin here use the same order of operations.
"""

from __future__ import annotations

import numpy as np

TINY = 1e-15


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1] + a[:, 2] * b[:, 2]


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a[:, 1] * b[:, 2] - a[:, 2] * b[:, 1], a[:, 2] * b[:, 0] - a[:, 0] * b[:, 2], a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]], 1)


def _over(a: np.ndarray, b: np.ndarray, zero: float = 0.0) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), zero), where=b != 0)


def ray_box(low: np.ndarray, high: np.ndarray, o: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(t_in, t_out) of lines in boxes; t_in > t_out for a miss."""
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = (low - o) / d, (high - o) / d
    near, far = np.minimum(a, b), np.maximum(a, b)
    flat = d == 0
    if flat.any():
        inside = (low <= o) & (o <= high)
        near = np.where(flat, np.where(inside, -np.inf, np.inf), near)
        far = np.where(flat, np.where(inside, np.inf, -np.inf), far)
    return near.max(1), far.min(1)


def ray_triangle(o, d, a, b, c, side: str = "double"):
    """(hit, t, u, v) of the Moeller-Trumbore test; t in direction lengths."""
    e1, e2, q = b - a, c - a, o - a
    n = cross(e1, e2)
    dn = dot(d, n)
    s = np.where(dn < 0, -1.0, 1.0)
    area = np.abs(dn)
    bu, bv, qn = s * dot(d, cross(q, e2)), s * dot(d, cross(e1, q)), -s * dot(q, n)
    facing = {"front": dn < 0, "back": dn > 0, "double": dn != 0}[side]
    hit = facing & (bu >= 0) & (bv >= 0) & (bu + bv <= area) & (qn >= 0)
    safe = np.where(area == 0, 1.0, area)
    return hit, qn / safe, bu / safe, bv / safe


def ray_point(o, d, p):
    """(squared distance of p from the half line, t in direction lengths)."""
    dd, along = dot(d, d), dot(p - o, d)
    t = np.maximum(_over(along, dd), 0.0)
    gap = p - (o + d * t[:, None])
    return dot(gap, gap), t


def ray_segment(o, d, p, q):
    """(squared distance of half line and segment, t on the ray, s on the segment)."""
    g, r = q - p, o - p
    dd, gg, dg, dr, gr = dot(d, d), dot(g, g), dot(d, g), dot(d, r), dot(g, r)
    det = dd * gg - dg * dg
    s0 = np.where(det > 0, np.minimum(np.maximum(_over(gr * dd - dr * dg, det), 0.0), 1.0), 0.0)
    t = np.maximum(_over(s0 * dg - dr, dd), 0.0)
    s = np.where(gg == 0, 0.0, np.minimum(np.maximum(_over(t * dg + gr, gg), 0.0), 1.0))
    gap = (o + d * t[:, None]) - (p + g * s[:, None])
    return dot(gap, gap), t, s


def aligned_box_triangle(low, high, s) -> np.ndarray:
    """Whether triangles meet axis-aligned boxes; touching counts."""
    center, half = (low + high) / 2, (high - low) / 2
    t = [x - center for x in s]
    edges = [t[1] - t[0], t[2] - t[1], t[0] - t[2]]
    apart = np.zeros(len(center), bool)
    for i in range(3):
        x = np.stack([k[:, i] for k in t])
        apart |= (x.min(0) > half[:, i]) | (x.max(0) < -half[:, i])
    units = [np.broadcast_to(np.eye(3)[i], center.shape) for i in range(3)]
    for axis in [cross(edges[0], edges[1])] + [cross(u, e) for u in units for e in edges]:
        reach = half[:, 0] * np.abs(axis[:, 0]) + half[:, 1] * np.abs(axis[:, 1]) + half[:, 2] * np.abs(axis[:, 2])
        x = np.stack([dot(axis, k) for k in t])
        apart |= (x.min(0) > reach) | (x.max(0) < -reach)
    return ~apart


def closest_on_triangle(p, a, b, c) -> np.ndarray:
    """The point of each triangle closest to p, by Voronoi regions."""
    ab, ac, ap, bp, cp = b - a, c - a, p - a, p - b, p - c
    d1, d2, d3, d4, d5, d6 = dot(ab, ap), dot(ac, ap), dot(ab, bp), dot(ac, bp), dot(ab, cp), dot(ac, cp)
    va, vb, vc = d3 * d6 - d5 * d4, d5 * d2 - d1 * d6, d1 * d4 - d3 * d2
    cases = [(d1 <= 0) & (d2 <= 0), (d3 >= 0) & (d4 <= d3), (vc <= 0) & (d1 >= 0) & (d3 <= 0), (d6 >= 0) & (d5 <= d6), (vb <= 0) & (d2 >= 0) & (d6 <= 0), (va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0)]
    zero, one = np.zeros(len(p)), np.ones(len(p))
    along = _over(d4 - d3, (d4 - d3) + (d5 - d6))
    whole = va + vb + vc
    v = np.select(cases, [zero, one, _over(d1, d1 - d3), zero, zero, 1.0 - along], _over(vb, whole))
    w = np.select(cases, [zero, zero, zero, one, _over(d2, d2 - d6), along], _over(vc, whole))
    return a + (ab * v[:, None] + ac * w[:, None])


def segment_segment(p1, q1, p2, q2) -> tuple[np.ndarray, np.ndarray]:
    """Closest points of two segments (either may be a point)."""
    d1, d2, r = q1 - p1, q2 - p2, p1 - p2
    a, e, f, c, b = dot(d1, d1), dot(d2, d2), dot(d2, r), dot(d1, r), dot(d1, d2)
    det = a * e - b * b
    s = np.where(det > TINY * np.maximum(a * e, TINY), np.clip(_over(b * f - c * e, det), 0, 1), 0.0)
    t = _over(b * s + f, e)
    s = np.where(t < 0, np.clip(_over(-c, a), 0, 1), np.where(t > 1, np.clip(_over(b - c, a), 0, 1), s))
    t = np.clip(t, 0, 1)
    s = np.where(e == 0, np.clip(_over(-c, a), 0, 1), s)
    return p1 + d1 * s[:, None], p2 + d2 * t[:, None]


def segment_triangle(p, q, a, b, c) -> tuple[np.ndarray, np.ndarray]:
    """(whether the closed segment crosses the closed triangle's plane inside it, the point)."""
    d = q - p
    n = cross(b - a, c - a)
    dn, reach = dot(d, n), dot(a - p, n)
    t = _over(reach, dn, np.nan)
    x = p + d * t[:, None]
    with np.errstate(invalid="ignore"):
        inside = (dn != 0) & (t >= 0) & (t <= 1)
        for u, v in ((a, b), (b, c), (c, a)):
            # A point on an edge counts: the sign is snapped at rounding level.
            side = dot(cross(v - u, x - u), n)
            inside &= side >= -1e-12 * dot(n, n)
    return inside, x


def _coplanar_overlap(s, t, n) -> np.ndarray:
    """Whether coplanar triangles (tuples of points) meet: separating axes in the plane."""
    apart = np.zeros(len(n), bool)
    for tri in (s, t):
        for i in range(3):
            axis = cross(n, tri[(i + 1) % 3] - tri[i])
            x, y = (np.stack([dot(axis, p) for p in k]) for k in (s, t))
            apart |= (x.max(0) < y.min(0)) | (y.max(0) < x.min(0))
    return ~apart


def triangle_triangle(s, t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(meet, segment start, segment end) of triangles given as (a, b, c); coplanar pairs get a zero segment."""
    n, m = cross(s[1] - s[0], s[2] - s[0]), cross(t[1] - t[0], t[2] - t[0])
    line = cross(n, m)
    size = np.maximum(dot(n, n) * dot(m, m), 1e-300)
    parallel = dot(line, line) <= TINY * size
    off = np.abs(dot(t[0] - s[0], n))
    thin = (dot(n, n) == 0) | (dot(m, m) == 0)
    flat = parallel & ~thin & (off <= 1e-12 * np.maximum(dot(n, n), 1e-300))
    low, high = np.full(len(n), np.inf), np.full(len(n), -np.inf)
    start, end = np.zeros((len(n), 3)), np.zeros((len(n), 3))
    meet = np.zeros(len(n), bool)
    for x, y in ((s, t), (t, s)):
        for i in range(3):
            hit, p = segment_triangle(x[i], x[(i + 1) % 3], *y)
            hit &= ~flat
            along = np.where(hit, dot(line, np.nan_to_num(p)), 0)
            lower, upper = hit & (along < low), hit & (along > high)
            low[lower], high[upper] = along[lower], along[upper]
            start[lower], end[upper] = p[lower], p[upper]
            meet |= hit
    meet |= flat & _coplanar_overlap(s, t, n)
    # Triangles without an area also meet where their edges do.
    if thin.any():
        k = np.flatnonzero(thin)
        gap, p, _ = _feature_distance(tuple(x[k] for x in s), tuple(x[k] for x in t))
        touch = k[(gap <= TINY) & ~meet[k]]
        start[touch] = end[touch] = p[np.isin(k, touch)]
        meet[touch] = True
    return meet, np.where(meet[:, None], start, 0), np.where(meet[:, None], end, 0)


def _feature_distance(s, t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(squared distance, point of s, point of t) over vertices against faces and edges against edges."""
    best = np.full(len(s[0]), np.inf)
    p, q = np.zeros((len(best), 3)), np.zeros((len(best), 3))

    def offer(x, y):
        d = dot(x - y, x - y)
        less = d < best
        best[less], p[less], q[less] = d[less], x[less], y[less]

    for i in range(3):
        offer(s[i], closest_on_triangle(s[i], *t))
        offer(closest_on_triangle(t[i], *s), t[i])
    for i in range(3):
        for j in range(3):
            offer(*segment_segment(s[i], s[(i + 1) % 3], t[j], t[(j + 1) % 3]))
    return best, p, q


def triangle_distance(s, t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, point of s, point of t); meeting triangles have 0 and the middle of their segment."""
    best, p, q = _feature_distance(s, t)
    meet, a, b = triangle_triangle(s, t)
    best = np.where(meet, 0.0, best)
    middle = (a + b) / 2
    flat = meet & (a == b).all(1) & (a == 0).all(1)  # coplanar: the closest features meet anyway
    use = (meet & ~flat)[:, None]
    return np.sqrt(best), np.where(use, middle, p), np.where(use, middle, q)


def triangle_segment(s, p, q) -> np.ndarray:
    """Least distance of a triangle's edges and face to a segment's edges and ends."""
    best = np.full(len(p), np.inf)
    for i in range(3):
        x, y = segment_segment(s[i], s[(i + 1) % 3], p, q)
        best = np.minimum(best, dot(x - y, x - y))
    for e in (p, q):
        x = closest_on_triangle(e, *s) - e
        best = np.minimum(best, dot(x, x))
    return np.sqrt(best)


def box_triangle(inverse: np.ndarray, low: np.ndarray, high: np.ndarray, s) -> np.ndarray:
    """Whether triangles meet boxes oriented by matrices (inverse: n x 16, column-major); touching counts."""
    m = inverse.reshape(-1, 4, 4)
    center, half = (low + high) / 2, (high - low) / 2
    t = [np.einsum("nji,nj->ni", m[:, :3, :3], x) + m[:, 3, :3] - center for x in s]
    edges = [t[1] - t[0], t[2] - t[1], t[0] - t[2]]
    apart = np.zeros(len(center), bool)
    axes = [np.broadcast_to(np.eye(3)[i], center.shape) for i in range(3)] + [cross(edges[0], edges[1])]
    axes += [cross(np.broadcast_to(np.eye(3)[i], e.shape), e) for i in range(3) for e in edges]
    for axis in axes:
        reach = (half * np.abs(axis)).sum(1)
        shadow = np.stack([dot(axis, x) for x in t])
        apart |= (shadow.min(0) > reach) | (shadow.max(0) < -reach)
    return ~apart


def oriented_axes(world: np.ndarray, low, high) -> np.ndarray:
    """n x 36, what box_box has to know of boxes low..high oriented by matrices (world: n x 16, column-major, local to world).

    Center, half sides and face axes (nine numbers each), and the reach of the box along the fifteen axes.
    """
    m = world.reshape(-1, 4, 4)
    center, half = (low + high) / 2, (high - low) / 2
    sides = [m[:, i, :3] * half[:, i : i + 1] for i in range(3)]  # half sides, in the world
    units = [np.broadcast_to(np.eye(3)[i], center.shape) for i in range(3)]
    # Faces of a sheared box are across its other two sides.
    faces = [cross(sides[1], sides[2]), cross(sides[2], sides[0]), cross(sides[0], sides[1])]
    axes = units + faces + [cross(u, s) for u in units for s in sides]
    at = sum(m[:, i, :3] * center[:, i : i + 1] for i in range(3)) + m[:, 3, :3]
    return np.concatenate([at, *sides, *faces, np.stack([sum(np.abs(dot(axis, s)) for s in sides) for axis in axes], 1)], 1)


def box_box(known, other_low, other_high) -> np.ndarray:
    """Whether oriented boxes meet axis-aligned ones; touching counts. All as columns: known is that of oriented_axes.

    A unit axis or its cross product with a side has one or two components that are not zero: only these are multiplied.
    """
    sides, faces, span = [known[3 + 3 * i : 6 + 3 * i] for i in range(3)], [known[12 + 3 * i : 15 + 3 * i] for i in range(3)], known[21:]
    gap = [known[c] - (other_low[c] + other_high[c]) / 2 for c in range(3)]
    reach = [(other_high[c] - other_low[c]) / 2 for c in range(3)]
    apart = np.abs(gap[0]) > span[0] + reach[0]
    for c in (1, 2):
        apart |= np.abs(gap[c]) > span[c] + reach[c]
    for k, f in enumerate(faces):
        apart |= np.abs(f[0] * gap[0] + f[1] * gap[1] + f[2] * gap[2]) > span[3 + k] + (reach[0] * np.abs(f[0]) + reach[1] * np.abs(f[1]) + reach[2] * np.abs(f[2]))
    size = [[np.abs(x) for x in s] for s in sides]
    for u, (p, q) in enumerate(((1, 2), (0, 2), (0, 1))):  # the cross product has side's q at p, and p at q, of other signs
        for k, (s, z) in enumerate(zip(sides, size)):
            apart |= np.abs(s[q] * gap[p] - s[p] * gap[q]) > span[6 + 3 * u + k] + (reach[p] * z[q] + reach[q] * z[p])
    return ~apart


def box_box_distance(inverse: np.ndarray, low, high, other_low, other_high) -> np.ndarray:
    """Distance of oriented boxes (world to local by `inverse`) to axis-aligned ones, by faces of triangles."""
    m = np.linalg.inv(inverse.reshape(-1, 4, 4).transpose(0, 2, 1))
    best = np.full(len(low), np.inf)
    mine = [np.einsum("nij,nj->ni", m[:, :3, :3], x) + m[:, :3, 3] for x in _corners(low, high)]
    theirs = _corners(other_low, other_high)
    for i, j, k in _FACES:
        for u, v, w in _FACES:
            d, _, _ = triangle_distance((mine[i], mine[j], mine[k]), (theirs[u], theirs[v], theirs[w]))
            best = np.minimum(best, d)
    inside = np.einsum("nji,nj->ni", inverse.reshape(-1, 4, 4)[:, :3, :3], theirs[0]) + inverse.reshape(-1, 4, 4)[:, 3, :3]
    contained = ((low <= inside) & (inside <= high)).all(1) | ((other_low <= mine[0]) & (mine[0] <= other_high)).all(1)
    return np.where(contained, 0.0, best)


def _corners(low, high) -> list[np.ndarray]:
    return [np.stack([(high if (k >> i) & 1 else low)[:, i] for i in range(3)], 1) for k in range(8)]


#: Two triangles for each side of a box, by corner number (bit i: high on axis i).
_FACES = [(0, 2, 4), (2, 6, 4), (1, 3, 5), (3, 7, 5), (0, 1, 4), (1, 5, 4), (2, 3, 6), (3, 7, 6), (0, 1, 2), (1, 3, 2), (4, 5, 6), (5, 7, 6)]


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull of n x 2 points (monotone chain), without collinear points; empty below three."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p[:0]

    def half(seq):
        out: list = []
        for x in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (x[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(x)
        return out[:-1]

    hull = half(p.tolist()) + half(p[::-1].tolist())
    return np.array(hull) if len(hull) > 2 else p[:0]
