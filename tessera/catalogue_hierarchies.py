"""Registered queries over hierarchies in tables, brushes, views and kinds of one's own, with DuckDB SQL by brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import oracles
from .catalogue import _FAR2, _NEAR, _ROOTED, _SECOND, _first_sql, _hits_sql, _index, _lengths, _second, query
from .functions import bounds
from .functions.staged import nested_sql
from .functions.vectors import AXES, cross, dot, sub, vec
from .operators import brush, descent, index, primitives, rays, stored, views
from .operators.regions import BOX
from .plans import durable
from .sources import fixtures as fx
from .sources import geometry

#: Primitives of a tile, and boxes of a leaf, in these queries, so that the given tables make several levels and tiles.
FEW, LEAF = 400, 64


# ---- building and reading --------------------------------------------------


@query("build_levels", oracles.tree(_ROOTED, f"select root_id, node_id, depth, is_leaf, count, {', '.join(BOX)} from node"))
def build_levels(spark, d):
    """Nodes above FEW boxes are split level by level, as tables."""
    b = fx.aabbs(spark, d).withColumn("root_id", (F.col("box_id") % 4).cast("int"))
    return index.build_nodes(b, task_rows=FEW)[0].select("root_id", "node_id", "depth", "is_leaf", "count", *BOX)


_ONE = f"select cast(0 as int) as root_id, * from ({fx.AABBS}) as b"


@query("build_levels_order", oracles.tree(_ONE, "select n.node_id, m.box_id from node as n join member as m on n.path = m.path where n.is_leaf"))
def build_levels_order(spark, d):
    """The leaf of every box of one root that no task holds whole."""
    nodes, order = index.build_nodes(fx.aabbs(spark, d).withColumn("root_id", F.lit(0)), task_rows=1000)
    return index.slots_of(nodes.where("is_leaf"), ["root_id", "node_id"]).join(order, ["root_id", "slot"]).select("node_id", "box_id")


def _flat_index(spark, d) -> tuple[DataFrame, DataFrame]:
    """Four hierarchies of LEAF boxes a leaf."""
    b = fx.aabbs(spark, d).withColumn("root_id", (F.col("box_id") % 4).cast("int"))
    return index.build_nodes(b, leaf_size=LEAF)


def _read_back(spark, d) -> tuple[DataFrame, DataFrame]:
    """An index, stored and read."""
    nodes, order, _ = _index(spark, d)
    path = durable.fresh(spark, "index")
    geometry.write_index(nodes, order, path)
    return geometry.read_index(spark, path)


_HIT = "ray_id, tri_id, t, distance, u, v"


@query("stored_all_hits", f"select {_HIT} from ({_hits_sql()}) as x")
def stored_all_hits(spark, d):
    return stored.raycast(fx.rays(spark, d), *_read_back(spark, d), fx.triangles(spark, d), most=FEW)


@query("stored_first_hit", _first_sql())
def stored_first_hit(spark, d):
    return stored.raycast(fx.rays(spark, d), *_read_back(spark, d), fx.triangles(spark, d), first=True, most=FEW)


@query("stored_closest_point", _NEAR)
def stored_closest_point(spark, d):
    return stored.closest_point(fx.query_points(spark, d), *_read_back(spark, d), fx.triangles(spark, d), most=FEW)


_LIFTED = f"select tri_id, {', '.join(f'{p}{c} + (case when tri_id % 3 = 0 then 2e-1 else 0e0 end) as {p}{c}' for p in ('a', 'vb', 'c') for c in AXES)} from ({fx.TRIANGLES}) as t"


@query("stored_refit_first_hit", _first_sql().replace(fx.TRIANGLES, _LIFTED))
def stored_refit_first_hit(spark, d):
    """Triangles move, the stored index is refitted, and rays find them where they are."""
    nodes, order = _read_back(spark, d)
    moved = fx.triangles(spark, d).selectExpr("tri_id", *(f"{x} + (case when tri_id % 3 = 0 then 2e-1 else 0e0 end) as {x}" for x in rays.TRIANGLE))
    boxes = moved.selectExpr("tri_id as box_id", *(f"{f}(a{c}, vb{c}, c{c}) as {n}{c}" for n, f in (("min", "least"), ("max", "greatest")) for c in AXES))
    dirty = index.leaves_of(nodes, order, boxes.where("box_id % 3 = 0"))
    fitted = durable.cut(index.refit(nodes, order, boxes, dirty))  # cut into tiles, and read for them
    return stored.raycast(fx.rays(spark, d), fitted, order, moved, first=True, most=FEW)


@query("first_hits_front_to_back", _first_sql())
def first_hits_front_to_back(spark, d):
    """Rays enter small tiles in order, and leave once their hit is nearer than the next tile."""
    held, tiles = rays.tiled(fx.triangles(spark, d), 100)
    return rays.in_tiles(fx.rays(spark, d), held.select("tile", "tri_id", *rays.TRIANGLE), tiles, rays.grown, "double", True, None)


# ---- walks down ------------------------------------------------------------

_WIDE = f"select sphere_id, px, py, pz, r * 6e0 as r from ({fx.SPHERES}) as s"
_CORNER_IN = " or ".join("(" + " + ".join(f"({p}{c} - p{c}) * ({p}{c} - p{c})" for c in AXES) + ") <= r * r" for p in ("a", "vb", "c"))
_SPHERE_GAP = bounds.sphere_overlaps("", vec("p"), "r")


@query("shapecast_hierarchy", oracles.tree(_ROOTED, f"select sphere_id, box_id as tri_id, contained from (select s.sphere_id, p.box_id, bool_or(({_FAR2}) <= r * r) as contained, any_value({_CORNER_IN}) as met from ({_WIDE}) as s, (select root_id, path, box_id from placed) as p join (select root_id, path, {', '.join(BOX)} from node) as n using (root_id, path) join ({fx.TRIANGLES}) as t on t.tri_id = p.box_id group by all) as x where met", LEAF))
def shapecast_hierarchy(spark, d):
    """Triangles with a corner in a sphere; whole subtrees inside one leave untested."""
    nodes, order = _flat_index(spark, d)
    spheres = fx.spheres(spark, d).withColumn("r", F.col("r") * 6)
    state = F.expr(f"case when {_FAR2} <= r * r then 2 when {_SPHERE_GAP} then 1 else 0 end")
    return stored.shapecast(spheres, nodes, order, fx.triangles(spark, d), "tri_id", state, F.expr(_CORNER_IN)).select("sphere_id", "tri_id", "contained")


@query("ray_by_shapecast", f"select {_HIT} from ({_hits_sql()}) as x")
def ray_by_shapecast(spark, d):
    """All rays by a walk whose condition is that of a ray and a box."""
    nodes, order = _flat_index(spark, d)
    steps = bounds.ray_interval("", vec("o"), vec("d"))
    meets = " and ".join(f"({a}) <= ({b}) + 1e-9" for a in ("0e0", *(steps[0][f"in_{c}"] for c in AXES)) for b in (steps[0][f"out_{c}"] for c in AXES))
    r, t = fx.rays(spark, d), fx.triangles(spark, d)
    met = stored.shapecast(r, nodes, order, t, "tri_id", F.expr(f"case when {meets} then 1 else 0 end"), F.lit(True), rays.TRIANGLE)
    return rays.raycast_pairs(met)


@query("descent_triangle_pairs", oracles.meeting(oracles.box_near(fx.TRIANGLES, _SECOND)))
def descent_triangle_pairs(spark, d):
    """Meeting triangles of two meshes by their two hierarchies."""
    sides = [fx.triangles(spark, d), _second(spark, d)]
    boxes = [t.selectExpr("0 as root_id", "tri_id as box_id", *(f"{f}(a{c}, vb{c}, c{c}) as {n}{c}" for n, f in (("min", "least"), ("max", "greatest")) for c in AXES)) for t in sides]
    return _lengths(descent.triangle_pairs(*sides, *(index.build_nodes(b, leaf_size=LEAF) for b in boxes)))


_MARGIN = 0.01
_LEAVES = "select root_id, depth, count, " + ", ".join(BOX) + " from node where is_leaf"


@query("descent_ranges", oracles.tree(_ROOTED, f"select a.root_id as a_root_id, a.depth as a_depth, b.root_id as b_root_id, b.depth as b_depth, count(*) as n, cast(sum(a.count * b.count) as bigint) as pairs from ({_LEAVES}) as a, ({_LEAVES}) as b where " + " and ".join(f"a.min{c} - {_MARGIN!r}::double <= b.max{c} and b.min{c} <= a.max{c} + {_MARGIN!r}::double" for c in AXES) + " group by all", LEAF))
def descent_ranges(spark, d):
    """Pairs of leaves of four hierarchies with themselves: how many at each depth, and how many pairs they stand for."""
    nodes, _ = _flat_index(spark, d)
    found = descent.range_pairs(nodes, nodes, margin=_MARGIN).groupBy("a_root_id", "a_depth", "b_root_id", "b_depth")
    return found.agg(F.count("*").alias("n"), F.sum(F.col("a_count") * F.col("b_count")).alias("pairs"))


@query("descent_callback", oracles.tree(_ROOTED, "select a.root_id as a_root_id, b.root_id as b_root_id, a.depth + b.depth as depths, cast(sum(a.count * b.count) as bigint) as pairs from (" + _LEAVES + ") as a, (" + _LEAVES + ") as b where " + bounds.overlap("a.", "b.") + " group by all", LEAF))
def descent_callback(spark, d):
    """A function of batches of range pairs."""

    def work(batch):
        import pyarrow as pa

        c = {n: batch.column(n).to_numpy() for n in ("a_count", "b_count", "a_depth", "b_depth")}
        out = [batch.column("a_root_id"), batch.column("b_root_id"), pa.array(c["a_depth"] + c["b_depth"]), pa.array(c["a_count"] * c["b_count"])]
        return pa.RecordBatch.from_arrays(out, names=["a_root_id", "b_root_id", "depths", "pairs"])

    nodes, _ = _flat_index(spark, d)
    found = descent.cast_pairs(nodes, nodes, work, "a_root_id int, b_root_id int, depths int, pairs long")
    return found.groupBy("a_root_id", "b_root_id", "depths").agg(F.sum("pairs").alias("pairs"))


# ---- brushes ---------------------------------------------------------------

_FOURTH = {f"m{c}": f"vb{c} + (c{c} - a{c})" for c in AXES}
#: Each triangle with a second one across an edge, which has two of its corners.
_WEDGES = {f"{p}{c}": f"case when h = 0 then {p}{c} else {e}{c} end" for p, e in (("a", "c"), ("vb", "vb"), ("c", "m")) for c in AXES}
_MESH = "select tri_id * 2 + h as tri_id, " + ", ".join(f"{e} as {n}" for n, e in _WEDGES.items()) + f" from (select *, {', '.join(f'{e} as {n}' for n, e in _FOURTH.items())} from ({fx.TRIANGLES}) as t) as f, (select unnest([0, 1]) as h) as k"


def _mesh(spark, d) -> DataFrame:
    four = fx.triangles(spark, d).selectExpr("*", *(f"{e} as {n}" for n, e in _FOURTH.items()), "explode(array(0, 1)) as h")
    return four.selectExpr("tri_id * 2 + h as tri_id", *(f"{e} as {n}" for n, e in _WEDGES.items()))


def _unit(v: str) -> str:
    return ", ".join(f"coalesce({v}{c} / nullif(sqrt({v}x * {v}x + {v}y * {v}y + {v}z * {v}z), 0e0), 0e0)" + " as {0}" + c for c in AXES)


def _strokes(along: str) -> str:
    """Definitions up to `done`: the mesh after strokes that move vertices by `along`, an expression of near (the distance over the radius) and above."""
    normal = ", ".join(f"{e} as f{c}" for c, e in zip(AXES, cross(sub(vec("vb"), vec("a")), sub(vec("c"), vec("a")))))
    each = ", ".join(f"{{'x': {p}x, 'y': {p}y, 'z': {p}z}}" for p in brush.CORNERS)
    gap = " + ".join(f"({c} - p{c}) * ({c} - p{c})" for c in AXES)
    joins = " ".join(f"left join m as m_{p} on " + " and ".join(f"m_{p}.{c} = t.{p}{c}" for c in AXES) for p in brush.CORNERS)
    moved = ", ".join(f"t.{p}{c} + coalesce(m_{p}.m{c}, 0e0) as {p}{c}" for p in brush.CORNERS for c in AXES)
    return (
        f"t as materialized ({_MESH}), s as ({_WIDE}), "
        f"cr as (select fx, fy, fz, unnest([{each}], recursive := true) from (select *, {normal} from t) as f), "
        "v0 as (select x, y, z, sum(fx) as sx, sum(fy) as sy, sum(fz) as sz from cr group by x, y, z), "
        f"v as materialized (select x, y, z, {_unit('s').replace('{0}', 'n')} from v0), "
        f"h as materialized (select * from s, v where {gap} <= r * r), "
        "b0 as (select sphere_id, sum(nx) as tx, sum(ny) as ty, sum(nz) as tz, avg(x) as qx, avg(y) as qy, avg(z) as qz from h group by sphere_id), "
        f"b as (select sphere_id, qx, qy, qz, {_unit('t').replace('{0}', 'u')} from b0), "
        f"w as (select x, y, z, ux, uy, uz, {along} as along from (select *, 1e0 - sqrt({gap}) / r as near, ux * (x - qx) + uy * (y - qy) + uz * (z - qz) as above from h join b using (sphere_id)) as g), "
        "m as materialized (select x, y, z, sum(ux * along) as mx, sum(uy * along) as my, sum(uz * along) as mz from w group by x, y, z), "
        f"done as (select t.tri_id, {moved}, m_a.x is not null or m_vb.x is not null or m_c.x is not null as moved from t {joins})"
    )


_SHOWN = ", ".join(f"round({x}, 6) as {x}" for x in rays.TRIANGLE)
_ALONG = {"normal": "near * near * 2e-2", "clay": "least(near * near * near * 4e0, 1e0) * 2e-2 - above * least(near * near * near * 4e0, 1e0) * 3e-1", "flatten": "-above * near * near * 60e0 * 5e-3"}


def _sculpted(spark, d, mode: str) -> DataFrame:
    return brush.sculpt(_mesh(spark, d), fx.spheres(spark, d).withColumn("r", F.col("r") * 6), 60.0 if mode == "flatten" else 0.02, mode)


def _rounded(done: DataFrame) -> DataFrame:
    return done.select("tri_id", *(F.round(x, 6).alias(x) for x in rays.TRIANGLE), "moved")


@query("sculpt_brush", f"with {_strokes(_ALONG['normal'])} select tri_id, {_SHOWN}, moved from done")
def sculpt_brush(spark, d):
    return _rounded(_sculpted(spark, d, "normal"))


@query("sculpt_clay", f"with {_strokes(_ALONG['clay'])} select tri_id, {_SHOWN}, moved from done")
def sculpt_clay(spark, d):
    return _rounded(_sculpted(spark, d, "clay"))


@query("sculpt_flatten", f"with {_strokes(_ALONG['flatten'])} select tri_id, {_SHOWN}, moved from done")
def sculpt_flatten(spark, d):
    return _rounded(_sculpted(spark, d, "flatten"))


@query("sculpt_shared_corners", f"with {_strokes(_ALONG['normal'])} select tri_id // 2 as wedge, bool_or(moved) as moved, true as whole from done group by 1")
def sculpt_shared_corners(spark, d):
    """After a stroke the two triangles of an edge still have both of its ends in common."""
    done = _sculpted(spark, d, "normal").withColumn("wedge", F.floor(F.col("tri_id") / 2))
    one, two = (done.where(f"tri_id % 2 = {h}").select("wedge", *(F.col(x).alias(f"{x}{h}") for x in rays.TRIANGLE), F.col("moved").alias(f"moved{h}")) for h in (0, 1))
    whole = " and ".join([*(f"vb{c}0 = vb{c}1" for c in AXES), *(f"c{c}0 = a{c}1" for c in AXES)])
    return one.join(two, "wedge").select("wedge", (F.col("moved0") | F.col("moved1")).alias("moved"), F.expr(whole).alias("whole"))


_MESH_BOXES = "select cast(tri_id % 4 as int) as root_id, tri_id as box_id, " + ", ".join(f"{f}(a{c}, vb{c}, c{c}) as {n}{c}" for n, f in (("min", "least"), ("max", "greatest")) for c in AXES)
_AFTER = "select root_id, path, " + ", ".join(f"{f}({f}{c}) as {f}{c}" for f in ("min", "max") for c in AXES) + " from (select p.root_id, p.path, " + ", ".join(f"{g}(a{c}, vb{c}, c{c}) as {f}{c}" for f, g in (("min", "least"), ("max", "greatest")) for c in AXES) + " from placed as p join done on done.tri_id = p.box_id) as q group by root_id, path"


@query("sculpt_refit", oracles.tree(f"{_MESH_BOXES} from ({_MESH}) as t", f", {_strokes(_ALONG['normal'])} select n.root_id, n.node_id, {', '.join(f'round(h.{x}, 6) as {x}' for x in BOX)} from node as n join ({_AFTER}) as h on n.root_id = h.root_id and n.path = h.path").replace(" , t as materialized", ", t as materialized"))
def sculpt_refit(spark, d):
    """A brush moves vertices; the leaves that hold their triangles, and the nodes above, are refitted."""
    mesh = _mesh(spark, d)
    boxes = lambda t: t.selectExpr("cast(tri_id % 4 as int) as root_id", "tri_id as box_id", *(f"{f}(a{c}, vb{c}, c{c}) as {n}{c}" for n, f in (("min", "least"), ("max", "greatest")) for c in AXES))
    nodes, order = index.build_nodes(boxes(mesh))
    done = durable.cut(_sculpted(spark, d, "normal"))
    fresh = index.refit(nodes, order, boxes(done), index.leaves_of(nodes, order, boxes(done.where("moved"))))
    return fresh.select("root_id", "node_id", *(F.round(x, 6).alias(x) for x in BOX))


# ---- views -----------------------------------------------------------------

#: A perspective view: w depends on where a point lies, and some lie behind.
_VIEW = [1.5, 0.1, 0.0, 0.1, -0.2, 1.4, 0.0, 0.0, 0.05, 0.0, 1.0, 0.9, 0.02, -0.03, 0.0, 0.3]
_LOOP = [(-1.0, -0.8), (1.2, -0.9), (0.6, 0.1), (1.1, 1.0), (-0.9, 0.9)]


def _screen(v: tuple[str, str, str], to: str) -> str:
    row = lambda r: " + ".join([*(f"{_VIEW[4 * i + r]!r}::double * {x}" for i, x in enumerate(v)), f"{_VIEW[12 + r]!r}::double"])
    return f"({row(0)}) / ({row(3)}) as {to}x, ({row(1)}) / ({row(3)}) as {to}y, ({row(3)}) as {to}w"


def _winding(x: str, y: str) -> str:
    """Turns of the lasso around a point."""
    turns = []
    for (x0, y0), (x1, y1) in zip(_LOOP, _LOOP[1:] + _LOOP[:1]):
        left = f"(({x1 - x0!r}::double) * ({y} - {y0!r}::double) - ({x} - {x0!r}::double) * ({y1 - y0!r}::double))"
        turns.append(f"case when {y0!r}::double <= {y} and {y1!r}::double > {y} and {left} > 0 then 1 when {y0!r}::double > {y} and {y1!r}::double <= {y} and {left} < 0 then -1 else 0 end")
    return " + ".join(turns)


_MIDDLE = tuple(f"(a{c} + vb{c} + c{c}) / 3e0" for c in AXES)


@query("camera_lasso", f"select tri_id from (select tri_id, {_screen(_MIDDLE, 's')} from ({fx.TRIANGLES}) as t) as p where sw > 0 and {_winding('sx', 'sy')} <> 0")
def camera_lasso(spark, d):
    """Triangles whose centroids lie in a lasso on the screen, by an index whose subtrees in the lasso leave untested."""
    return views.camera_lasso(fx.triangles(spark, d), _LOOP, _VIEW, index=_flat_index(spark, d))


_SCREENED = f"select tri_id, {_screen(vec('a'), 'a')}, {_screen(vec('vb'), 'k')}, {_screen(vec('c'), 'c')} from ({fx.TRIANGLES}) as t"
_SIDES = ", ".join(f"{{'x0': {p}x, 'y0': {p}y, 'x1': {q}x, 'y1': {q}y}}" for p, q in ("ak", "kc", "ca"))


def _crossing() -> str:
    """A side x0..y1 and one of the lasso's cross: where their lines meet lies inside both."""
    tests = []
    for (u0, v0), (u1, v1) in zip(_LOOP, _LOOP[1:] + _LOOP[:1]):
        e, f = f"{u1 - u0!r}::double", f"{v1 - v0!r}::double"
        det = f"nullif((x1 - x0) * {f} - (y1 - y0) * ({e}), 0)"
        t = f"(({u0!r}::double - x0) * {f} - ({v0!r}::double - y0) * ({e})) / {det}"
        s = f"(({u0!r}::double - x0) * (y1 - y0) - ({v0!r}::double - y0) * (x1 - x0)) / {det}"
        tests.append(f"({t} > 0 and {t} < 1 and {s} > 0 and {s} < 1)")
    return " or ".join(tests)


@query("camera_lasso_touch", f"select distinct tri_id from (select tri_id, unnest([{_SIDES}], recursive := true) from ({_SCREENED}) as p where aw > 0 and kw > 0 and cw > 0) as s where {_winding('x0', 'y0')} <> 0 or {_crossing()}")
def camera_lasso_touch(spark, d):
    """Triangles of which the screen shows some part in the lasso."""
    return views.camera_lasso(fx.triangles(spark, d), _LOOP, _VIEW, "touch")


@query("camera_lasso_indexed_touch", f"select distinct tri_id from (select tri_id, unnest([{_SIDES}], recursive := true) from ({_SCREENED}) as p where aw > 0 and kw > 0 and cw > 0) as s where {_winding('x0', 'y0')} <> 0 or {_crossing()}")
def camera_lasso_indexed_touch(spark, d):
    return views.camera_lasso(fx.triangles(spark, d), _LOOP, _VIEW, "touch", _flat_index(spark, d))


_EDGES = "select tri_id as edge_id, ax as x0, ay as y0, az as z0, vbx as x1, vby as y1, vbz as z1 from ({0}) as e"


def _visible_sql() -> str:
    """Hidden length by the middles between all places where an outline or a plane is crossed."""
    tris = f"select tri_id, ax, ay, az, vbx, vby, vbz, cx, cy, cz, (vbx - ax) * (cy - ay) - (vby - ay) * (cx - ax) as area from ({fx.TRIANGLES}) as t"
    flat = " and ".join(f"least({c}0, {c}1) <= greatest(a{c}, vb{c}, c{c}) and least(a{c}, vb{c}, c{c}) <= greatest({c}0, {c}1)" for c in "xy")
    pairs = f"select * from ({_EDGES.format(fx.TRIANGLES)}) as l, ({tris}) as r where {flat} and area <> 0 and greatest(az, vbz, cz) > least(z0, z1)"

    def bary(t: str) -> tuple[str, str, str]:
        x, y = f"(x0 + (x1 - x0) * ({t}))", f"(y0 + (y1 - y0) * ({t}))"
        u = f"((vbx - {x}) * (cy - {y}) - (vby - {y}) * (cx - {x})) / area"
        v = f"((cx - {x}) * (ay - {y}) - (cy - {y}) * (ax - {x})) / area"
        w = f"((ax - {x}) * (vby - {y}) - (ay - {y}) * (vbx - {x})) / area"
        return u, v, w

    def above(t: str) -> str:
        u, v, w = bary(t)
        return f"({u}) * az + ({v}) * vbz + ({w}) * cz - (z0 + (z1 - z0) * ({t})) - 1e-9"

    # Each of the four is linear in t, so its root comes from its values at both ends.
    ends = [*zip(bary("0e0"), bary("1e0")), (above("0e0"), above("1e0"))]
    roots = ", ".join(f"({a}) / nullif(({a}) - ({b}), 0e0)" for a, b in ends)
    inside = " and ".join(f"({x}) >= 0" for x in bary("m")) + f" and ({above('m')}) > 0"
    return (
        f"with pair as materialized ({pairs}), cut as (select distinct edge_id, t from (select edge_id, unnest([{roots}, 0e0, 1e0]) as t from pair) as x where t >= 0 and t <= 1), "
        "span as (select edge_id, t as lo, lead(t) over (partition by edge_id order by t) as hi from cut), "
        f"hid as (select distinct edge_id, lo, hi from (select edge_id, lo, hi, (lo + hi) / 2e0 as m from span where hi > lo) as s join pair using (edge_id) where {inside}), "
        "own as (select edge_id, sum(hi - lo) as n from hid group by edge_id) "
        f"select edge_id, round(coalesce(n, 0e0), 6) as hidden, round(1e0 - coalesce(n, 0e0), 6) as visible from ({_EDGES.format(fx.TRIANGLES)}) as e left join own using (edge_id)"
    )


@query("edge_visibility", _visible_sql())
def edge_visibility(spark, d):
    """How much of each edge shows from above, and how much triangles hide."""
    t = fx.triangles(spark, d)
    edges = t.selectExpr("tri_id as edge_id", "ax as x0", "ay as y0", "az as z0", "vbx as x1", "vby as y1", "vbz as z1")
    parts = views.edge_parts(edges, t).groupBy("edge_id")
    length = lambda h: F.round(F.coalesce(F.sum(F.when(F.col("hidden") == h, F.col("hi") - F.col("lo"))), F.lit(0.0)), 6)
    return parts.agg(length(True).alias("hidden"), length(False).alias("visible"))


# ---- a kind that the library doesn't know ----------------------------------

_DISC_LENGTH = "sqrt(" + " + ".join(f"n{c} * n{c}" for c in AXES) + ")"


def _disc_text(sql: bool) -> str:
    e = lambda i: fx._element(i, sql)
    inner = "select vec_id as disc_id, " + ", ".join(f"{e(54 + i)} as p{c}, {e(3 + i)} as n{c}" for i, c in enumerate(AXES)) + f", 3e-1 * abs({e(63)}) + 5e-2 as r from embeddings"
    return f"select disc_id, px, py, pz, r, {', '.join(f'n{c} / {_DISC_LENGTH} as n{c}' for c in AXES)} from ({inner}) as x"


def _disc_bounds(s: np.ndarray):
    reach = s[:, 3:4] * np.sqrt(np.maximum(0, 1 - s[:, 4:] ** 2)) * (1 + 1e-12) + 1e-300
    return s[:, :3] - reach, s[:, :3] + reach


def _disc_ray(o, d, s):
    across = (d * s[:, 4:]).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((s[:, :3] - o) * s[:, 4:]).sum(1) / across
        gap = o + d * t[:, None] - s[:, :3]
    return (across != 0) & (t >= 0) & ((gap * gap).sum(1) <= s[:, 3] ** 2), t


def _disc_distance(p, s):
    gap = p - s[:, :3]
    h = (gap * s[:, 4:]).sum(1)
    flat = gap - h[:, None] * s[:, 4:]
    out = np.maximum(np.sqrt((flat * flat).sum(1)) - s[:, 3], 0)
    return np.sqrt(h * h + out * out)


DISC = primitives.Kind("disc_id", ("px", "py", "pz", "r", "nx", "ny", "nz"), _disc_bounds, _disc_ray, _disc_distance)


def _discs(spark, d) -> DataFrame:
    e = lambda i: fx._element(i, False)
    at = fx._embeddings(spark, d, {"disc_id": "vec_id"} | {f"p{c}": e(54 + i) for i, c in enumerate(AXES)} | {f"n{c}": e(3 + i) for i, c in enumerate(AXES)} | {"r": f"3e-1 * abs({e(63)}) + 5e-2"})
    return at.selectExpr("disc_id", "px", "py", "pz", "r", *(f"n{c} / {_DISC_LENGTH} as n{c}" for c in AXES))


_DISC_HITS = nested_sql(f"select * from (select ray_id, ox, oy, oz, dx, dy, dz from ({fx.RAYS}) as r) as r, ({_disc_text(True)}) as s", [
    {"across": dot(vec("d"), vec("n")), "h": dot(sub(vec("p"), vec("o")), vec("n"))},
    {"t": "h / nullif(across, 0e0)"},
    {f"g{c}": f"o{c} + d{c} * t - p{c}" for c in AXES},
])
_DISC_NEAR = nested_sql(f"select * from (select query_id, px as kx, py as ky, pz as kz from ({fx.QUERY_POINTS}) as q) as q, ({_disc_text(True)}) as s", [
    {f"g{c}": f"k{c} - p{c}" for c in AXES},
    {"h": dot(vec("g"), vec("n"))},
    {"flat": "sqrt(" + " + ".join(f"(g{c} - h * n{c}) * (g{c} - h * n{c})" for c in AXES) + ")"},
    {"distance": "sqrt(h * h + greatest(flat - r, 0e0) * greatest(flat - r, 0e0))"},
])


@query("own_kind_first_hit", f"select ray_id, disc_id, round(distance, 6) as distance from (select *, row_number() over (partition by ray_id order by distance, disc_id) as nr from (select ray_id, disc_id, t * sqrt{dot(vec('d'), vec('d'))} as distance from ({_DISC_HITS}) as x where t >= 0e0 and {dot(vec('g'), vec('g'))} <= r * r) as y) as z where nr = 1")
def own_kind_first_hit(spark, d):
    """Rays at discs, by tiles."""
    found = primitives.raycast(fx.rays(spark, d), _discs(spark, d), DISC, first=True, strategy="tiles", tile_rows=100)
    return found.select("ray_id", "disc_id", F.round("distance", 6).alias("distance"))


@query("own_kind_closest", f"select query_id, disc_id, round(distance, 6) as distance from (select *, row_number() over (partition by query_id order by distance, disc_id) as nr from ({_DISC_NEAR}) as y) as z where nr = 1")
def own_kind_closest(spark, d):
    """The nearest disc of each point, by one hierarchy."""
    return primitives.closest(fx.query_points(spark, d), _discs(spark, d), DISC).withColumn("distance", F.round("distance", 6))


@query("own_kind_index", f"select cast(disc_id % 3 as int) as root_id, count(*) as discs, round(min(px - r * sqrt(greatest(0e0, 1e0 - nx * nx))), 6) as minx, round(max(pz + r * sqrt(greatest(0e0, 1e0 - nz * nz))), 6) as maxz from ({_disc_text(True)}) as s group by 1")
def own_kind_index(spark, d):
    """Hierarchies over discs: their roots."""
    boxes = primitives.boxed(_discs(spark, d), DISC).selectExpr("cast(disc_id % 3 as int) as root_id", "disc_id as box_id", *BOX)
    roots = index.build_nodes(boxes)[0].where("depth = 0")
    return roots.select("root_id", F.col("count").alias("discs"), F.round("minx", 6).alias("minx"), F.round("maxz", 6).alias("maxz"))
