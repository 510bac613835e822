"""DuckDB SQL for queries that run through kernels, by other formulas than the kernels use.

Triangles cross where an edge of one goes through the other; distances are
those of corners over faces, of corners to edges and of edges to edges; scenes
are baked to world space before rays are cast; hierarchies grow by a recursive
query over the paths of boxes. Each text holds by brute force.
"""

from __future__ import annotations

from .functions import bounds, exact
from .functions.staged import nested_sql
from .functions.vectors import AXES, Vec, add, affine, cross, dot, scale, sub, vec

CORNERS = ("a", "vb", "c")


def _struct(**vectors: Vec) -> str:
    return "{" + ", ".join(f"'{name}{c}': {x}" for name, v in vectors.items() for c, x in zip(AXES, v)) + "}"


def _exploded(inner: str, keys: str, structs: list[str]) -> str:
    """A row for each struct of each row; the structs' fields are columns."""
    return f"select {keys}, unnest([{', '.join(structs)}], recursive := true) from ({inner}) as x"


def _corner(side: str, p: str) -> Vec:
    return tuple(f"{side}_{p}{c}" for c in AXES)


def sided(tris: str, side: str) -> str:
    """Triangles with their columns and bounds named for one side of a pair."""
    points = [vec(p) for p in CORNERS]
    box = ", ".join(f"{e} as {side}_{n}" for n, e in bounds.of_points(points).items())
    return f"select tri_id as {side}_id, " + ", ".join(f"{p}{c} as {side}_{p}{c}" for p in CORNERS for c in AXES) + f", {box} from ({tris}) as t"


def box_near(left: str, right: str, within: str = "0e0", extra: str = "true") -> str:
    """Pairs of triangles whose boxes are no farther apart than `within` on any axis."""
    on = " and ".join(f"a_min{c} - {within} <= b_max{c} and b_min{c} - {within} <= a_max{c}" for c in AXES)
    return f"select * from ({sided(left, 'a')}) as l, ({sided(right, 'b')}) as r where {on} and {extra}"


def _faces_edges() -> list[str]:
    """Structs of each edge p..q of one triangle with the other as u, v, w."""
    out = []
    for s, t in (("a", "b"), ("b", "a")):
        u, v, w = (_corner(t, p) for p in CORNERS)
        for i in range(3):
            out.append(_struct(p=_corner(s, CORNERS[i]), q=_corner(s, CORNERS[(i + 1) % 3]), u=u, v=v, w=w))
    return out


def crossings(pairs: str) -> str:
    """(a_id, b_id, xx..xz): where edges of one triangle of a pair go through the other."""
    rows = _exploded(pairs, "a_id, b_id", _faces_edges())
    steps = [
        {f"n{c}": e for c, e in zip(AXES, cross(sub(vec("v"), vec("u")), sub(vec("w"), vec("u"))))},
        {"hp": dot(sub(vec("p"), vec("u")), vec("n")), "hq": dot(sub(vec("q"), vec("u")), vec("n"))},
        {f"x{c}": e for c, e in zip(AXES, add(vec("p"), scale(sub(vec("q"), vec("p")), "(hp / (hp - hq))")))},
    ]
    inside = " and ".join(dot(cross(sub(vec(j), vec(i)), sub(vec("x"), vec(i))), vec("n")) + " >= 0e0" for i, j in (("u", "v"), ("v", "w"), ("w", "u")))
    return f"select a_id, b_id, xx, xy, xz from ({nested_sql(rows, steps)}) as y where hp <> hq and hp * hq <= 0e0 and {inside}"


def meeting(pairs: str) -> str:
    """(a_id, b_id, length): meeting triangles and the length of what they share."""
    spread = " + ".join(f"(max(x{c}) - min(x{c})) * (max(x{c}) - min(x{c}))" for c in AXES)
    return f"select a_id, b_id, round(sqrt({spread}), 6) as length from ({crossings(pairs)}) as z group by a_id, b_id"


def _point_to_segment(p: Vec, u: Vec, v: Vec) -> str:
    """Squared distance of a point and a segment."""
    g = sub(v, u)
    t = f"least(greatest({dot(sub(p, u), g)} / nullif({dot(g, g)}, 0e0), 0e0), 1e0)"
    gap = sub(p, add(u, scale(g, f"coalesce({t}, 0e0)")))
    return dot(gap, gap)


def _point_to_triangle() -> tuple[list[dict[str, str]], str]:
    """(steps, squared distance) of p and the triangle u, v, w."""
    steps = [
        {f"n{c}": e for c, e in zip(AXES, cross(sub(vec("v"), vec("u")), sub(vec("w"), vec("u"))))},
        {"nn": dot(vec("n"), vec("n")), "h": dot(sub(vec("p"), vec("u")), vec("n"))},
        {f"x{c}": e for c, e in zip(AXES, sub(vec("p"), scale(vec("n"), "coalesce(h / nullif(nn, 0e0), 0e0)")))},
        {"over": "nn > 0e0 and " + " and ".join(dot(cross(sub(vec(j), vec(i)), sub(vec("x"), vec(i))), vec("n")) + " >= 0e0" for i, j in (("u", "v"), ("v", "w"), ("w", "u")))},
        {f"s{k}": _point_to_segment(vec("p"), vec(i), vec(j)) for k, (i, j) in enumerate((("u", "v"), ("v", "w"), ("w", "u")))},
    ]
    return steps, "case when over then h * h / nn else least(s0, s1, s2) end"


def _lines() -> tuple[list[dict[str, str]], str]:
    """(steps, squared distance) of the segments p..q and u..v where both closest points lie inside them, else null."""
    steps = [
        {f"d{c}": e for c, e in zip(AXES, sub(vec("q"), vec("p")))} | {f"e{c}": e for c, e in zip(AXES, sub(vec("v"), vec("u")))} | {f"r{c}": e for c, e in zip(AXES, sub(vec("u"), vec("p")))},
        {f"m{c}": e for c, e in zip(AXES, cross(vec("d"), vec("e")))},
        {"mm": f"nullif({dot(vec('m'), vec('m'))}, 0e0)"},
        {"s": f"{dot(cross(vec('r'), vec('e')), vec('m'))} / mm", "t": f"{dot(cross(vec('r'), vec('d')), vec('m'))} / mm"},
    ]
    across = dot(vec("r"), vec("m"))
    return steps, f"case when s >= 0e0 and s <= 1e0 and t >= 0e0 and t <= 1e0 then {across} * {across} / mm end"


def distances(pairs: str) -> str:
    """(a_id, b_id, distance) of triangles."""
    corners = []
    for s, t in (("a", "b"), ("b", "a")):
        u, v, w = (_corner(t, p) for p in CORNERS)
        corners += [_struct(p=_corner(s, p), u=u, v=v, w=w) for p in CORNERS]
    edges = [_struct(p=_corner("a", CORNERS[i]), q=_corner("a", CORNERS[(i + 1) % 3]), u=_corner("b", CORNERS[j]), v=_corner("b", CORNERS[(j + 1) % 3])) for i in range(3) for j in range(3)]
    (s1, d1), (s2, d2) = _point_to_triangle(), _lines()
    parts = [f"select a_id, b_id, {d} as d2 from ({nested_sql(_exploded('select * from pairs', 'a_id, b_id', rows), steps)}) as y" for rows, steps, d in ((corners, s1, d1), (edges, s2, d2))]
    parts.append(f"select a_id, b_id, 0e0 as d2 from ({crossings('select * from pairs')}) as y")
    return f"with pairs as materialized ({pairs}) select a_id, b_id, sqrt(min(d2)) as distance from ({' union all '.join(parts)}) as z group by a_id, b_id"


def closest(left: str, right: str) -> str:
    """The closest pair of two tables: candidates are those whose boxes are nearer than the nearest two corners."""
    gap = "(" + " + ".join(f"(l.a_a{c} - r.b_a{c}) * (l.a_a{c} - r.b_a{c})" for c in AXES) + ")"
    boxes = " + ".join(f"greatest(a_min{c} - b_max{c}, b_min{c} - a_max{c}, 0e0) * greatest(a_min{c} - b_max{c}, b_min{c} - a_max{c}, 0e0)" for c in AXES)
    bound = f"select min({gap}) from ({sided(left, 'a')}) as l, ({sided(right, 'b')}) as r"
    pairs = f"select * from ({sided(left, 'a')}) as l, ({sided(right, 'b')}) as r where {boxes} <= ({bound})"
    return f"select a_id, b_id, round(distance, 6) as distance from ({distances(pairs)}) as w order by distance, a_id, b_id limit 1"


def segment_distances(segments: str, tris: str, within: str) -> str:
    """(seg_id, tri_id, distance): ends against faces and the segment against edges."""
    near = " and ".join(f"least({c}0, {c}1) - {within} <= b_max{c} and b_min{c} - {within} <= greatest({c}0, {c}1)" for c in AXES)
    pairs = f"select seg_id as a_id, * from ({segments}) as l, ({sided(tris, 'b')}) as r where {near}"
    ends = [tuple(f"{c}{k}" for c in AXES) for k in (0, 1)]
    u, v, w = (_corner("b", p) for p in CORNERS)
    points = [_struct(p=e, u=u, v=v, w=w) for e in ends]
    # A corner over the segment: the corner against both of its ends' line, as a point against a segment.
    edges = [_struct(p=ends[0], q=ends[1], u=_corner("b", CORNERS[j]), v=_corner("b", CORNERS[(j + 1) % 3])) for j in range(3)]
    (s1, d1), (s2, d2) = _point_to_triangle(), _lines()
    corner = "least(coalesce(" + d2 + ", cast('Infinity' as double)), " + _point_to_segment(vec("u"), vec("p"), vec("q")) + ")"
    parts = [f"select a_id, b_id, {d} as d2 from ({nested_sql(_exploded('select * from pairs', 'a_id, b_id', rows), steps)}) as y" for rows, steps, d in ((points, s1, d1), (edges, s2, corner))]
    return f"with pairs as materialized ({pairs}) select seg_id, tri_id, round(distance, 6) as distance from (select a_id as seg_id, b_id as tri_id, sqrt(min(d2)) as distance from ({' union all '.join(parts)}) as z group by a_id, b_id) as w where distance <= {within}"


def moved(tris: str, matrix: list[float]) -> str:
    """Triangles moved by a column-major matrix."""
    m = [f"cast({float(x)!r} as double)" for x in matrix]
    return "select tri_id, " + ", ".join(f"{e} as {p}{c}" for p in CORNERS for c, e in zip(AXES, affine(m, vec(p)))) + f" from ({tris}) as t"


def box_triangles(boxes: str, tris: str) -> str:
    """(box_id, tri_id) of boxes and triangles in one frame, by separating axes."""
    center, half = tuple(f"((min{c} + max{c}) / 2e0)" for c in AXES), tuple(f"((max{c} - min{c}) / 2e0)" for c in AXES)
    steps, test = exact.triangle_box(center, half)
    near = " and ".join(f"least(a{c}, vb{c}, c{c}) <= max{c} and greatest(a{c}, vb{c}, c{c}) >= min{c}" for c in AXES)
    return f"select box_id, tri_id from ({nested_sql(f'select * from ({boxes}) as b, ({tris}) as t where {near}', steps)}) as x where {test}"


def box_crossings(boxes: str, tris: str) -> str:
    """(box_id, tri_id) of boxes and triangles that meet: an edge of the triangle enters the box, or one of the box goes through the triangle."""
    near = " and ".join(f"least(a{c}, vb{c}, c{c}) <= max{c} and greatest(a{c}, vb{c}, c{c}) >= min{c}" for c in AXES)
    pairs = f"select * from ({boxes}) as b, ({tris}) as t where {near}"

    def corner(k: int) -> Vec:
        return tuple(f"{'max' if (k >> i) & 1 else 'min'}{c}" for i, c in enumerate(AXES))

    a, b, c = (vec(p) for p in CORNERS)
    box = ", ".join(f"min{x}, max{x}" for x in AXES)
    sides = _exploded(pairs, f"box_id, tri_id, {box}", [_struct(p=x, q=y) for x, y in ((a, b), (b, c), (c, a))])
    lows, highs = [], []
    for x in AXES:
        g = f"nullif(q{x} - p{x}, 0e0)"
        inside = f"case when p{x} >= min{x} and p{x} <= max{x} then {{}} else {{}} end"
        lows.append(f"coalesce(least((min{x} - p{x}) / {g}, (max{x} - p{x}) / {g}), {inside.format('0e0', '2e0')})")
        highs.append(f"coalesce(greatest((min{x} - p{x}) / {g}, (max{x} - p{x}) / {g}), {inside.format('1e0', '-1e0')})")
    entered = f"select box_id, tri_id from ({sides}) as s where greatest(0e0, {', '.join(lows)}) <= least(1e0, {', '.join(highs)})"
    edges = [(k, k | 1 << i) for k in range(8) for i in range(3) if not (k >> i) & 1]
    through = _exploded(pairs, "box_id, tri_id", [_struct(p=corner(i), q=corner(j), u=a, v=b, w=c) for i, j in edges])
    steps = [
        {f"n{x}": e for x, e in zip(AXES, cross(sub(vec("v"), vec("u")), sub(vec("w"), vec("u"))))},
        {"hp": dot(sub(vec("p"), vec("u")), vec("n")), "hq": dot(sub(vec("q"), vec("u")), vec("n"))},
        {f"x{x}": e for x, e in zip(AXES, add(vec("p"), scale(sub(vec("q"), vec("p")), "(hp / nullif(hp - hq, 0e0))")))},
    ]
    inside = " and ".join(dot(cross(sub(vec(j), vec(i)), sub(vec("x"), vec(i))), vec("n")) + " >= 0e0" for i, j in (("u", "v"), ("v", "w"), ("w", "u")))
    pierced = f"select box_id, tri_id from ({nested_sql(through, steps)}) as e where hp <> hq and hp * hq <= 0e0 and {inside}"
    return f"select distinct box_id, tri_id from ({entered} union all {pierced}) as m"


def nearest(points: str, tris: str) -> str:
    """(query_id, distance) of points and the nearest triangle."""
    steps, d2 = _point_to_triangle()
    renamed = "select tri_id, " + ", ".join(f"{p}{c} as {n}{c}" for p, n in zip(CORNERS, ("u", "v", "w")) for c in AXES) + f" from ({tris}) as t"
    return f"select query_id, round(sqrt(min({d2})), 6) as distance from ({nested_sql(f'select * from ({points}) as q, ({renamed}) as r', steps)}) as x group by query_id"


def ray_hits(rays: str, tris: str, keys: str = "") -> str:
    """All hits (ray_id, tri_id, t, distance) by plane and barycentric areas; the triangles' columns `keys` stay."""
    steps = [
        {f"n{c}": e for c, e in zip(AXES, cross(sub(vec("vb"), vec("a")), sub(vec("c"), vec("a"))))},
        {"dn": f"nullif({dot(vec('d'), vec('n'))}, 0e0)", "h": dot(sub(vec("a"), vec("o")), vec("n"))},
        {"t": "h / dn"},
        {f"x{c}": e for c, e in zip(AXES, add(vec("o"), scale(vec("d"), "t")))},
    ]
    inside = " and ".join(dot(cross(sub(vec(j), vec(i)), sub(vec("x"), vec(i))), vec("n")) + " >= 0e0" for i, j in (("a", "vb"), ("vb", "c"), ("c", "a")))
    return f"select ray_id, tri_id, t, t * sqrt{dot(vec('d'), vec('d'))} as distance{keys} from ({nested_sql(f'select * from ({rays}) as r, ({tris}) as t', steps)}) as x where t >= 0e0 and {inside}"


def first(hits: str, keys: str, ids: str) -> str:
    """The nearest hit of each key: its ids, which break ties, and distance."""
    return f"select {ids}, round(distance, 6) as distance from (select *, row_number() over (partition by {keys} order by distance, {ids}) as nr from ({hits}) as h) as g where nr = 1"


def nodes(boxes: str, leaf_size: int = 10, max_depth: int = 40) -> str:
    """Definitions of `member` (root_id, path, depth, box_id) and `node` (root_id, node_id, path, depth, is_leaf, count, minx..maxz) of centre-split hierarchies.

    boxes: root_id, box_id, minx..maxz. A path has a letter for each turn; nodes in order of their paths are in pre-order.
    """
    extent = [f"(max(m{c}) over w - min(m{c}) over w)" for c in AXES]
    axis = f"case when {extent[0]} >= {extent[1]} and {extent[0]} >= {extent[2]} then 0 when {extent[1]} >= {extent[2]} then 1 else 2 end"
    middle = " ".join(f"when {i} then (min(m{c}) over w + max(m{c}) over w) / 2e0" for i, c in enumerate(AXES))
    split = f"select *, count(*) over w as n, {axis} as axis from member window w as (partition by root_id, path)"
    placed = f"select *, case axis {middle} end as position, case axis when 0 then mx when 1 then my else mz end as m from ({split}) as s where n > {leaf_size} and depth < {max_depth} window w as (partition by root_id, path)"
    turned = f"select *, case when m < position then 'L' else 'R' end as turn, sum(case when m < position then 1 else 0 end) over (partition by root_id, path) as lefts from ({placed}) as p"
    mids = ", ".join(f"(min{c} + max{c}) / 2e0 as m{c}" for c in AXES)
    union = ", ".join(f"{f}({f}{c}) as {f}{c}" for f in ("min", "max") for c in AXES)
    return (
        f"boxed as materialized (select root_id, box_id, {mids} from ({boxes}) as b), "
        "member as (select root_id, '' as path, 0 as depth, box_id, mx, my, mz from boxed "
        f"union all select root_id, path || turn, depth + 1, box_id, mx, my, mz from ({turned}) as q where lefts > 0 and lefts < n), "
        f"placed as materialized (select root_id, path, depth, box_id, {', '.join(f'{f}{c}' for f in ('min', 'max') for c in AXES)} from member join ({boxes}) as b using (root_id, box_id)), "
        f"grouped as (select root_id, path, any_value(depth) as depth, count(*) as count, {union} from placed group by root_id, path), "
        "node as materialized (select cast(row_number() over (partition by root_id order by path) - 1 as bigint) as node_id, *, not exists (select 1 from grouped as k where k.root_id = g.root_id and k.path = g.path || 'L') as is_leaf from grouped as g)"
    )


def tree(boxes: str, select: str, leaf_size: int = 10) -> str:
    return f"with recursive {nodes(boxes, leaf_size)} {select}"


def hulls(points: str, key: str) -> str:
    """(key, corner, x, y) by wrapping: from each corner to the point of the least turn, the farthest of equal ones. points: k, x, y."""
    turn = "case when t > 2 * pi() - 1e-9 then 0e0 else t end"
    step = "select w.k, w.corner, q.x, q.y, w.x0, w.y0, atan2(q.y - w.y, q.x - w.x) as heading, (atan2(q.y - w.y, q.x - w.x) - w.heading + 4 * pi()) % (2 * pi()) as t, (q.x - w.x) * (q.x - w.x) + (q.y - w.y) * (q.y - w.y) as far from walk as w join p as q on w.k = q.k and (w.x <> q.x or w.y <> q.y)"
    ranked = f"select *, row_number() over (partition by k order by round({turn}, 9), far desc) as nr from ({step}) as s"
    return (
        f"with recursive p as materialized ({points}), "
        "begun as (select k, x, y from (select *, row_number() over (partition by k order by x, y) as nr from p) as f where nr = 1), "
        "walk as (select k, 0 as corner, x, y, x as x0, y as y0, -pi() / 2 as heading from begun "
        f"union all select k, corner + 1, x, y, x0, y0, heading from ({ranked}) as r where nr = 1 and (x <> x0 or y <> y0)) "
        f"select k as {key}, cast(corner as int) as corner, x, y from walk"
    )


def untold(matrix: list[str]) -> list[str]:
    """Inverse of a turn and move, as SQL numbers."""
    m = [float(x) for x in matrix]
    turned = [[m[4 * i + c] for i in range(3)] for c in range(3)]  # columns of the transpose
    back = [-sum(turned[c][r] * m[12 + c] for c in range(3)) for r in range(3)]
    return [f"cast({x!r} as double)" for x in (*turned[0], 0.0, *turned[1], 0.0, *turned[2], 0.0, *back, 1.0)]


def obb_aabb(boxes: str, others: str, world: list[str], local: list[str]) -> str:
    """(box_id, other_id, distance): corners against the other box, edges against edges, 0 if an edge of one enters the other.

    world: matrix from the boxes' frame, rigid; local: its inverse.
    """

    def corner(k: int, prefix: str = "") -> Vec:
        return tuple(f"{prefix}{'max' if (k >> i) & 1 else 'min'}{c}" for i, c in enumerate(AXES))

    pairs = f"select * from ({boxes}) as b, (select other_id, " + ", ".join(f"{f}{c} as o_{f}{c}" for f in ("min", "max") for c in AXES) + f" from ({others}) as o) as o"
    sides = [(k, k | 1 << i) for k in range(8) for i in range(3) if not (k >> i) & 1]

    def to_box(p: Vec, prefix: str) -> str:
        gaps = [f"greatest({prefix}min{c} - {x}, 0e0, {x} - {prefix}max{c})" for c, x in zip(AXES, p)]
        return "(" + " + ".join(f"{g} * {g}" for g in gaps) + ")"

    def enters(prefix: str) -> str:
        step = []
        for c in AXES:
            a, b = f"({prefix}min{c} - p{c})", f"({prefix}max{c} - p{c})"
            g = f"(q{c} - p{c})"
            inside = f"p{c} >= {prefix}min{c} and p{c} <= {prefix}max{c}"
            step.append((f"case when {g} = 0e0 then case when {inside} then 0e0 else 2e0 end else least({a} / {g}, {b} / {g}) end", f"case when {g} = 0e0 then case when {inside} then 1e0 else -1e0 end else greatest({a} / {g}, {b} / {g}) end"))
        return f"greatest(0e0, {', '.join(x for x, _ in step)}) <= least(1e0, {', '.join(x for _, x in step)})"

    mine = [affine(world, corner(k)) for k in range(8)]
    theirs = [corner(k, "o_") for k in range(8)]
    back = [affine(local, t) for t in theirs]
    box, other = ", ".join(f"min{c}, max{c}" for c in AXES), ", ".join(f"o_min{c}, o_max{c}" for c in AXES)
    points = f"select box_id, other_id, least({', '.join([to_box(m, 'o_') for m in mine] + [to_box(b, '') for b in back])}) as d2 from pairs"
    into = [
        f"select box_id, other_id, 0e0 as d2 from ({_exploded('select * from pairs', f'box_id, other_id, {other}', [_struct(p=mine[i], q=mine[j]) for i, j in sides])}) as y where {enters('o_')}",
        f"select box_id, other_id, 0e0 as d2 from ({_exploded('select * from pairs', f'box_id, other_id, {box}', [_struct(p=back[i], q=back[j]) for i, j in sides])}) as y where {enters('')}",
    ]
    steps, d2 = _lines()
    edges = _exploded(_exploded("select * from pairs", f"box_id, other_id, {other}", [_struct(p=mine[i], q=mine[j]) for i, j in sides]), "box_id, other_id, px, py, pz, qx, qy, qz", [_struct(u=theirs[i], v=theirs[j]) for i, j in sides])
    lines = f"select box_id, other_id, {d2} as d2 from ({nested_sql(edges, steps)}) as y"
    return f"with pairs as materialized ({pairs}) select box_id, other_id, round(sqrt(min(d2)), 6) as distance from ({' union all '.join([points, *into, lines])}) as z group by box_id, other_id"
