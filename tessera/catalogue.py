"""Registered queries over the driver's tables, with DuckDB SQL that computes the same by brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import oracles
from .functions import bounds, exact
from .functions.staged import matching, nested_sql
from .functions.vectors import AXES, Vec, add, affine, cross, determinant, dot, named, scale, sub, vec
from .operators import bake, composite, index, nearest, pairs, rays, regions, scene
from .operators.regions import BOX
from .plans import durable
from .plans import strategy as plan
from .sources import fixtures as fx
from .sources import geometry, textures
from .streaming import maintenance

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


# ---- rays -----------------------------------------------------------------


def _hits_sql(side: str = "double", where: str = "true") -> str:
    steps, hit, after = exact.ray_triangle(side)
    inner = nested_sql(f"select * from ({fx.RAYS}) as r, ({fx.TRIANGLES}) as t", steps)
    return f"select * from ({nested_sql(f'select * from ({inner}) as h where {hit}', after)}) as h where {where}"


def _first_sql(side: str = "double", where: str = "true", extra: str = "") -> str:
    return f"select ray_id, tri_id, t, distance, u, v{extra} from (select *, row_number() over (partition by ray_id order by distance, tri_id) as nr from ({_hits_sql(side, where)}) as a) as b where nr = 1"


_HIT = "ray_id, tri_id, t, distance, u, v"


@query("ray_all_hits", f"select {_HIT} from ({_hits_sql()}) as x")
def ray_all_hits(spark, d):
    return rays.raycast(fx.rays(spark, d), fx.triangles(spark, d))


_ASIDE_RAYS = f"select ray_id, ox + 1e-3 as ox, oy - 2e-3 as oy, oz, dx, dy, dz from ({fx.RAYS}) as r"


@query("ray_hits_by_planes", f"select ray_id, tri_id, round(distance, 6) as distance from ({oracles.ray_hits(_ASIDE_RAYS, fx.TRIANGLES)}) as x")
def ray_hits_by_planes(spark, d):
    """Against planes and areas; the rays are moved a little, as each goes exactly through a corner, where rounding decides."""
    r = fx.rays(spark, d).withColumns({"ox": F.col("ox") + 1e-3, "oy": F.col("oy") - 2e-3})
    return rays.raycast(r, fx.triangles(spark, d)).select("ray_id", "tri_id", F.round("distance", 6).alias("distance"))


@query("ray_all_hits_nested", f"select {_HIT} from ({_hits_sql()}) as x")
def ray_all_hits_nested(spark, d):
    return rays.raycast(fx.rays(spark, d), fx.triangles(spark, d), strategy="nested")


@query("ray_first_hit", _first_sql())
def ray_first_hit(spark, d):
    return rays.raycast(fx.rays(spark, d), fx.triangles(spark, d), first=True)


@query("ray_first_hit_nested", _first_sql())
def ray_first_hit_nested(spark, d):
    return rays.raycast(fx.rays(spark, d), fx.triangles(spark, d), first=True, strategy="nested")


@query("ray_first_hit_tiles", _first_sql())
def ray_first_hit_tiles(spark, d):
    return rays.raycast(fx.rays(spark, d), fx.triangles(spark, d), first=True, strategy="tiles")


@query("ray_first_hit_front", _first_sql("front"))
def ray_first_hit_front(spark, d):
    return rays.raycast(fx.rays(spark, d), fx.triangles(spark, d), "front", first=True)


@query("ray_first_hit_backside", _first_sql("back"))
def ray_first_hit_backside(spark, d):
    return rays.raycast(fx.rays(spark, d), fx.triangles(spark, d), "back", first=True)


@query("ray_hits_near_far", f"select {_HIT} from ({_hits_sql(where='distance >= 5e-1 and distance <= 3e0')}) as x")
def ray_hits_near_far(spark, d):
    return rays.raycast(fx.rays(spark, d), fx.triangles(spark, d), near=0.5, far=3.0)


_BARY = [
    {"n_length": f"sqrt{dot(vec('n'), vec('n'))}"},
    named("unit", tuple(f"{x} / nullif(n_length, 0e0)" for x in vec("n"))),
    {"facing": dot(vec("unit"), vec("d"))},
    named("face", tuple(f"case when facing > 0e0 then -{x} else {x} end" for x in vec("unit"))),
]


@query("ray_hit_barycoord", f"select {_HIT}, w, px, py, pz, unitx, unity, unitz, facex, facey, facez, case when tri_id >= 100 and tri_id < 1100 then 1 when tri_id >= 1000 and tri_id < 2500 then 2 else 0 end as material_index from ({nested_sql(_hits_sql(), _BARY)}) as x")
def ray_hit_barycoord(spark, d):
    r, t = fx.rays(spark, d), fx.triangles(spark, d)
    groups = spark.createDataFrame([(100, 1000, 1), (1000, 1500, 2)], "start long, count long, material_index int")
    return rays.decorate(rays.raycast(r, t, told=True), r, t, groups)


_CORNER_VALUES = {f"uv_u_{k}": f"{p}x + {p}y" for k, p in zip("abc", ("a", "vb", "c"))} | {f"uv_v_{k}": f"{p}z * 2e0" for k, p in zip("abc", ("a", "vb", "c"))}


@query("hit_interpolation", "select ray_id, tri_id, " + ", ".join(f"round(w * ({_CORNER_VALUES[f'{n}_a']}) + u * ({_CORNER_VALUES[f'{n}_b']}) + v * ({_CORNER_VALUES[f'{n}_c']}), 9) as {n}" for n in ("uv_u", "uv_v")) + f" from ({_hits_sql()}) as x")
def hit_interpolation(spark, d):
    """Texture coordinates of all hits from those of the corners."""
    r, t = fx.rays(spark, d), fx.triangles(spark, d)
    hits = rays.decorate(rays.raycast(r, t), r, t)
    values = t.selectExpr("tri_id", *(f"{e} as {n}" for n, e in _CORNER_VALUES.items()))
    return rays.interpolate(hits, values, ["uv_u", "uv_v"]).select("ray_id", "tri_id", F.round("uv_u", 9).alias("uv_u"), F.round("uv_v", 9).alias("uv_v"))


@query("ray_aabb_prune", f"select ray_id, count(*) as n_boxes from ({nested_sql(f'select * from ({fx.RAYS}) as r, ({fx.AABBS}) as b', bounds.ray_interval('', vec('o'), vec('d')))}) as x where {bounds.ray_hits()} group by ray_id")
def ray_aabb_prune(spark, d):
    crossed = plan.cross_small(fx.rays(spark, d), fx.aabbs(spark, d))
    return matching(crossed, bounds.ray_interval("", vec("o"), vec("d")), bounds.ray_hits()).groupBy("ray_id").agg(F.count("*").alias("n_boxes"))


def _points_sql(threshold: str) -> str:
    return f"select ray_id, point_id, t, t * sqrt(dd) as distance from ({nested_sql(f'select * from ({fx.EVENT_RAYS}) as r, ({fx.POINTS}) as p', exact.ray_point())}) as x where gap2 < {threshold} * {threshold}"


@query("point_threshold_raycast", _points_sql("5e0"))
def point_threshold_raycast(spark, d):
    return rays.raycast_points(fx.event_rays(spark, d), fx.points(spark, d), 5.0)


@query("point_first_hit", f"select ray_id, point_id, t, distance from (select *, row_number() over (partition by ray_id order by distance, point_id) as nr from ({_points_sql('5e0')}) as a) as b where nr = 1")
def point_first_hit(spark, d):
    return rays.raycast_points(fx.event_rays(spark, d), fx.points(spark, d), 5.0, first=True)


def _segments_sql(source: str, threshold: str) -> str:
    s = f"select seg_id, x0 as px, y0 as py, z0 as pz, x1 as qx, y1 as qy, z1 as qz from ({source}) as s"
    steps = exact.ray_segment()
    # The step names a column s; DuckDB keeps it apart by position, so it is renamed on the way out.
    return f"select ray_id, seg_id, t, sg as s, t * sqrt(dd) as distance from ({nested_sql(f'select * from ({fx.EVENT_RAYS}) as a, ({s}) as b', steps)}) as x where gap2 <= {threshold} * {threshold}"


@query("segment_threshold_raycast", _segments_sql(fx.SEGMENTS, "2e0"))
def segment_threshold_raycast(spark, d):
    segs = geometry.polyline_segments(fx.polyline_points(spark, d), "user_id", ["ts", "point_id"])
    return rays.raycast_segments(fx.event_rays(spark, d), segs, 2.0)


@query("polyline_loop_raycast", _segments_sql(fx.LOOP, "2e0"))
def polyline_loop_raycast(spark, d):
    segs = geometry.polyline_segments(fx.polyline_points(spark, d), "user_id", ["ts", "point_id"], closed=True)
    return rays.raycast_segments(fx.event_rays(spark, d), segs, 2.0)


# ---- regions --------------------------------------------------------------

_SPHERE_HITS = f"select sphere_id, tri_id, d2 from ({nested_sql(f'select * from ({fx.SPHERES}) as s, ({fx.TRIANGLES}) as t', exact.closest_on_triangle())}) as x where d2 <= r * r"
_CENTER, _HALF = tuple(f"((min{c} + max{c}) / 2e0)" for c in AXES), tuple(f"((max{c} - min{c}) / 2e0)" for c in AXES)
_BOX_STEPS, _BOX_TEST = exact.triangle_box(_CENTER, _HALF)
_BOX_HITS = f"select box_id, tri_id from ({nested_sql(f'select * from ({fx.BOXES}) as b, ({fx.TRIANGLES}) as t', _BOX_STEPS)}) as x where {_BOX_TEST}"


@query("sphere_hits", _SPHERE_HITS)
def sphere_hits(spark, d):
    return regions.sphere_hits(fx.spheres(spark, d), fx.triangles(spark, d))


@query("sphere_hits_cells", _SPHERE_HITS)
def sphere_hits_cells(spark, d):
    return regions.sphere_hits(fx.spheres(spark, d), fx.triangles(spark, d), strategy="cells")


@query("sphere_intersects_tris", f"select sphere_id, sphere_id in (select sphere_id from ({_SPHERE_HITS}) as y) as intersects from ({fx.SPHERES}) as z")
def sphere_intersects_tris(spark, d):
    return regions.intersects_sphere(fx.spheres(spark, d), fx.triangles(spark, d))


@query("box_hits", _BOX_HITS)
def box_hits(spark, d):
    return regions.box_hits(fx.boxes(spark, d), fx.triangles(spark, d))


@query("box_hits_edges", oracles.box_crossings(fx.BOXES, fx.TRIANGLES))
def box_hits_edges(spark, d):
    """The same by separating axes, against edges that go through faces."""
    return regions.box_hits(fx.boxes(spark, d), fx.triangles(spark, d))


@query("box_intersects_tris", f"select box_id, box_id in (select box_id from ({_BOX_HITS}) as y) as intersects from ({fx.BOXES}) as z")
def box_intersects_tris(spark, d):
    return regions.intersects_box(fx.boxes(spark, d), fx.triangles(spark, d))


_TURN = ["8e-1", "-6e-1", "0e0", "0e0", "6e-1", "8e-1", "0e0", "0e0", "0e0", "0e0", "1e0", "0e0", "1e-1", "-2e-1", "5e-2", "1e0"]


@query("obb_contains_points", "select box_id, query_id as point_id from (" + nested_sql(f"select * from ({fx.BOXES}) as b, ({fx.QUERY_POINTS}) as p", [named("l", affine(_TURN, vec("p")))]) + f") as x where {bounds.contains_point('', vec('l'))}")
def obb_contains_points(spark, d):
    b = fx.boxes(spark, d).withColumns({f"m{i}": F.lit(float(x)) for i, x in enumerate(_TURN)})
    return regions.points_in_boxes(fx.query_points(spark, d).withColumnRenamed("query_id", "point_id"), b)


@query("obb_triangle", oracles.box_triangles(fx.BOXES, oracles.moved(fx.TRIANGLES, [float(x) for x in _TURN])))
def obb_triangle(spark, d):
    b = fx.boxes(spark, d).withColumn("inverse", F.array(*(F.lit(float(x)) for x in _TURN)))
    return regions.oriented_box_hits(b, fx.triangles(spark, d))


_FAR2 = " + ".join(f"greatest(abs(p{c} - min{c}), abs(p{c} - max{c})) * greatest(abs(p{c} - min{c}), abs(p{c} - max{c}))" for c in AXES)


_TURNED = f"select box_id, {', '.join(BOX)} from ({fx.BOXES}) as b"
_AABB_OTHERS = f"select box_id as other_id, {', '.join(BOX)} from ({fx.AABBS}) as b"


def _oriented(spark, d) -> DataFrame:
    return fx.boxes(spark, d).withColumn("inverse", F.array(*(F.lit(float(x)) for x in _TURN)))


@query("obb_aabb_overlap", f"select box_id, other_id from ({oracles.obb_aabb(_TURNED, _AABB_OTHERS, oracles.untold(_TURN), _TURN)}) as x where distance = 0e0")
def obb_aabb_overlap(spark, d):
    others = fx.aabbs(spark, d).withColumnRenamed("box_id", "other_id")
    return regions.oriented_box_overlaps(_oriented(spark, d), others)


_IN_BOX = nested_sql(f"select box_id, query_id as point_id, {', '.join(BOX)}, px, py, pz from ({fx.BOXES}) as b, ({fx.QUERY_POINTS}) as p", [named("l", affine(_TURN, vec("p")))])
_TO_BOX = " + ".join(f"greatest(min{c} - l{c}, 0e0, l{c} - max{c}) * greatest(min{c} - l{c}, 0e0, l{c} - max{c})" for c in AXES)


@query("obb_point_distance", f"select * from (select box_id, point_id, round(sqrt({_TO_BOX}), 6) as distance from ({_IN_BOX}) as x) as y where distance <= 2e-1")
def obb_point_distance(spark, d):
    p = fx.query_points(spark, d).withColumnRenamed("query_id", "point_id")
    # The limit is of the rounded distance: what is found a little beyond it may round to it.
    found = regions.oriented_box_point_distances(p, _oriented(spark, d), 0.2 + 1e-6)
    return found.withColumn("distance", F.round("distance", 6)).where("distance <= 2e-1")


@query("contained_vs_intersected", f"select sphere_id, box_id, case when {_FAR2} <= r * r then 2 else 1 end as state from ({fx.SPHERES}) as s, ({fx.AABBS}) as b where {bounds.sphere_overlaps('', vec('p'), 'r')}")
def contained_vs_intersected(spark, d):
    return regions.classify_boxes(fx.aabbs(spark, d), fx.spheres(spark, d))


@query("brush_selection", f"select sphere_id, tri_id from ({_SPHERE_HITS}) as x")
def brush_selection(spark, d):
    return regions.select_region(fx.spheres(spark, d), fx.triangles(spark, d))


@query("shapecast_tiles", f"select tri_id from ({fx.TRIANGLES}) as t where greatest(ax, vbx, cx) >= 0e0 and greatest(ay, vby, cy) >= -1e-1")
def shapecast_tiles(spark, d):
    """Triangles that reach a quarter of space; tiles that lie wholly there skip the test."""
    held, tiles = rays.tiled(fx.triangles(spark, d), 100)
    state = F.expr("case when maxx < 0e0 or maxy < -1e-1 then 0 when minx >= 0e0 and miny >= -1e-1 then 2 else 1 end")
    return regions.shapecast(tiles, held, state, F.expr("greatest(ax, vbx, cx) >= 0e0 and greatest(ay, vby, cy) >= -1e-1")).select("tri_id")


@query("shapecast_points", f"select point_id from ({fx.POINTS}) as p where px + py > 8e1 and pz < 3e2")
def shapecast_points(spark, d):
    """Points beyond a slanted plane and below a height; tiles that lie wholly there skip the test."""
    p = fx.points(spark, d)
    cut, tiles = rays.tiled_boxes(p.withColumns({f"{f}{c}": F.col(f"p{c}") for f in ("min", "max") for c in AXES}), 500)
    state = F.expr("case when maxx + maxy <= 8e1 or minz >= 3e2 then 0 when minx + miny > 8e1 and maxz < 3e2 then 2 else 1 end")
    return regions.shapecast(tiles, cut, state, F.expr("px + py > 8e1 and pz < 3e2")).select("point_id")


@query("shapecast_segments", f"select seg_id, round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) + (z1 - z0) * (z1 - z0)), 6) as length from ({fx.SEGMENTS}) as s where least(y0, y1) > 4e1")
def shapecast_segments(spark, d):
    """Lengths of the segments above a height, by a function of whole tiles."""
    s = geometry.polyline_segments(fx.polyline_points(spark, d), "user_id", ["ts", "point_id"])
    cut, tiles = rays.tiled_boxes(s.withColumns({f"min{c}": F.least(f"{c}0", f"{c}1") for c in AXES} | {f"max{c}": F.greatest(f"{c}0", f"{c}1") for c in AXES}), 500)

    def lengths(table, contained):
        import numpy as np
        import pyarrow as pa

        c = {n: table.column(n).to_numpy() for n in ("x0", "y0", "z0", "x1", "y1", "z1")}
        out = pa.table({"seg_id": table.column("seg_id"), "length": np.sqrt((c["x1"] - c["x0"]) ** 2 + (c["y1"] - c["y0"]) ** 2 + (c["z1"] - c["z0"]) ** 2)})
        return out if contained else out.filter(pa.array(np.minimum(c["y0"], c["y1"]) > 40))

    state = F.expr("case when maxy <= 4e1 then 0 when miny > 4e1 then 2 else 1 end")
    return regions.shapecast_ranges(tiles, cut, state, lengths, "seg_id long, length double").withColumn("length", F.round("length", 6))


# ---- nearest --------------------------------------------------------------

_NEAR = f"select query_id, tri_id, sqrt(d2) as distance, kx, ky, kz from (select *, row_number() over (partition by query_id order by d2, tri_id) as nr from ({nested_sql(f'select * from ({fx.QUERY_POINTS}) as q, ({fx.TRIANGLES}) as t', exact.closest_on_triangle())}) as a) as b where nr = 1"


@query("closest_point_to_triangles", _NEAR)
def closest_point_to_triangles(spark, d):
    return nearest.closest_point(fx.query_points(spark, d), fx.triangles(spark, d))


@query("closest_distance", oracles.nearest(fx.QUERY_POINTS, fx.TRIANGLES))
def closest_distance(spark, d):
    """The distances alone, against feet over faces and points of edges."""
    return nearest.closest_point(fx.query_points(spark, d), fx.triangles(spark, d)).select("query_id", F.round("distance", 6).alias("distance"))


@query("closest_point_nested", _NEAR)
def closest_point_nested(spark, d):
    return nearest.closest_point(fx.query_points(spark, d), fx.triangles(spark, d), strategy="nested")


@query("closest_point_tiles", _NEAR)
def closest_point_tiles(spark, d):
    return nearest.closest_point(fx.query_points(spark, d), fx.triangles(spark, d), strategy="tiles")


@query("closest_within_threshold", f"select * from ({_NEAR}) as n where distance < 1e-1")
def closest_within_threshold(spark, d):
    return nearest.closest_point(fx.query_points(spark, d), fx.triangles(spark, d), farthest=0.1)


_D2 = " + ".join(f"(p{c} - q{c}) * (p{c} - q{c})" for c in AXES)


@query("nearest_point_topk", f"select query_id, point_id, d2, nr as rank from (select query_id, point_id, d2, cast(row_number() over (partition by query_id order by d2, point_id) as int) as nr from (select ray_id as query_id, point_id, {_D2} as d2 from (select ray_id, ox as qx, oy as qy, oz as qz from ({fx.EVENT_RAYS}) as r) as q, ({fx.POINTS}) as p) as a) as b where nr <= 3")
def nearest_point_topk(spark, d):
    q = fx.event_rays(spark, d).selectExpr("ray_id as query_id", "ox as qx", "oy as qy", "oz as qz")
    return nearest.nearest_points(q, fx.points(spark, d), 3)


# ---- pairs ----------------------------------------------------------------

_ON = bounds.overlap("a.", "b.")
_PAIRS = f"with boxed as ({fx.AABBS}) select a.box_id as a_id, b.box_id as b_id from boxed a join boxed b on a.box_id < b.box_id and {_ON}"


@query("aabb_pair_join", _PAIRS)
def aabb_pair_join(spark, d):
    return pairs.box_pairs(fx.aabbs(spark, d))


@query("aabb_pair_join_cells", _PAIRS)
def aabb_pair_join_cells(spark, d):
    return pairs.box_pairs(fx.aabbs(spark, d), strategy="cells")


_GAP = " + ".join(f"(a.p{c} - b.p{c}) * (a.p{c} - b.p{c})" for c in AXES)


@query("sphere_pair_join", f"with s as ({fx.SPHERES}) select a.sphere_id as a_id, b.sphere_id as b_id, sqrt({_GAP}) - (a.r + b.r) as depth from s a join s b on a.sphere_id < b.sphere_id where sqrt({_GAP}) - (a.r + b.r) < 0e0")
def sphere_pair_join(spark, d):
    return pairs.sphere_pairs(fx.spheres(spark, d))


def _corner_of(side: str, p: str) -> Vec:
    return tuple(f"{side}_{p}{c}" for c in AXES)


def _lengths(found: DataFrame) -> DataFrame:
    gap = " + ".join(f"(e{c} - s{c}) * (e{c} - s{c})" for c in AXES)
    return found.select("a_id", "b_id", F.round(F.expr(f"sqrt({gap})"), 6).alias("length"))


@query("tri_tri_pairs", oracles.meeting(oracles.box_near(fx.TRIANGLES, fx.TRIANGLES, extra="a_id < b_id")))
def tri_tri_pairs(spark, d):
    return _lengths(pairs.triangle_pairs(fx.triangles(spark, d)))


_PLACED = [0.8, 0.6, 0.0, 0.0, -0.6, 0.8, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.05, 0.02, -0.03, 1.0]
_SECOND = oracles.moved(fx.TRIANGLES, _PLACED)


def _second(spark, d):
    return pairs.transformed(fx.triangles(spark, d), _PLACED)


@query("intersection_segments", oracles.meeting(oracles.box_near(fx.TRIANGLES, _SECOND)))
def intersection_segments(spark, d):
    return _lengths(pairs.triangle_pairs(fx.triangles(spark, d), _second(spark, d)))


@query("tri_tri_distance", f"select a_id, b_id, round(distance, 6) as distance from ({oracles.distances(oracles.box_near(fx.TRIANGLES, _SECOND, '1e-2'))}) as x where distance <= 1e-2")
def tri_tri_distance(spark, d):
    found = pairs.triangle_distances(fx.triangles(spark, d), _second(spark, d), 0.01)
    return found.select("a_id", "b_id", F.round("distance", 6).alias("distance"))


_ASIDE = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 5.0, 0, 0, 1.0]


_NORMAL_DOT = dot(cross(sub(_corner_of("a", "vb"), _corner_of("a", "a")), sub(_corner_of("a", "c"), _corner_of("a", "a"))), cross(sub(_corner_of("b", "vb"), _corner_of("b", "a")), sub(_corner_of("b", "c"), _corner_of("b", "a"))))


@query("tri_pairs_batches", f"select a_id, b_id, {_NORMAL_DOT} > 0e0 as alike from ({oracles.box_near(fx.TRIANGLES, _SECOND)}) as x")
def tri_pairs_batches(spark, d):
    """A function of candidate pairs: whether two triangles near each other face alike."""

    def facing(batch):
        import numpy as np
        import pyarrow as pa

        def normal(side):
            p, q, r = (np.stack([batch.column(f"{side}_{k}{c}").to_numpy() for c in AXES], 1) for k in ("a", "vb", "c"))
            return np.cross(q - p, r - p)

        return pa.RecordBatch.from_arrays([batch.column("a_id"), batch.column("b_id"), pa.array((normal("a") * normal("b")).sum(1) > 0)], names=["a_id", "b_id", "alike"])

    return pairs.triangle_pairs_with(fx.triangles(spark, d), _second(spark, d), facing, "a_id long, b_id long, alike boolean")


@query("closest_geometry", oracles.closest(fx.TRIANGLES, oracles.moved(fx.TRIANGLES, _ASIDE)))
def closest_geometry(spark, d):
    t = fx.triangles(spark, d)
    return pairs.closest_geometry(t, pairs.transformed(t, _ASIDE)).select("a_id", "b_id", F.round("distance", 6).alias("distance"))


@query("intersects_geometry", f"select count(*) > 0 as intersects from ({oracles.crossings(oracles.box_near(fx.TRIANGLES, _SECOND))}) as x")
def intersects_geometry(spark, d):
    return pairs.intersects_geometry(fx.triangles(spark, d), _second(spark, d))


# ---- scenes ---------------------------------------------------------------

_PLANES = [(1.0, 0.0, 0.0, -50000.0), (-1.0, 0.0, 0.0, 400000.0), (0.0, 0.0, 1.0, -1.5)]


@query("scene_object_bounds", fx.OBJECTS)
def scene_object_bounds(spark, d):
    """Bounds of the orders of each customer, each order a point."""
    at = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey as object_id", "o_totalprice as x", f"{fx.HOURS_SPARK.format(t='o_orderdate')} as y", f"{fx._DIGIT} as z")
    points = at.select("object_id", *(F.col(c).alias(f"{f}{c}") for f in ("min", "max") for c in AXES))
    return index.node_bounds(points, ["object_id"]).select("object_id", *BOX)


_SIDES = [bounds.plane_side("", tuple(f"cast({x!r} as double)" for x in p[:3]), f"cast({p[3]!r} as double)") for p in _PLANES]


@query("frustum_cull_objects", f"select *, case when low < 0 then 0 when low > 0 then 2 else 1 end as state from (select *, least({', '.join(f'({s})' for s in _SIDES)}) as low from ({fx.OBJECTS}) as o) as x where low >= 0".replace("select *, case", "select object_id, minx, miny, minz, maxx, maxy, maxz, case"))
def frustum_cull_objects(spark, d):
    return scene.frustum_cull(fx.objects(spark, d), _PLANES)


def _matrix_text(i: str) -> list[str]:
    """A matrix that depends on the instance: turned, scaled, every third mirrored, and moved."""
    s = f"(1e0 + 5e-1 * {i})"
    mirror = f"case when {i} % 3 = 0 then -1e0 else 1e0 end"
    return [f"8e-1 * {s}", f"6e-1 * {s}", "0e0", "0e0", f"-6e-1 * {s}", f"8e-1 * {s}", "0e0", "0e0", "0e0", "0e0", mirror, "0e0", f"2e0 * {i}", f"-1e0 * {i}", "25e-2", "1e0"]


def _instances(spark) -> DataFrame:
    """Nine instances of three geometries, one of them hidden."""
    m = ", ".join(f"cast({x} as double)" for x in _matrix_text("id"))
    return spark.range(9).selectExpr("id as object_id", "cast(id % 2 as int) as instance_id", "id % 3 as geom_id", f"array({m}) as matrix", "id <> 4 as visible")


_INST = "select i as object_id, cast(i % 2 as int) as instance_id, i % 3 as geom_id, i <> 4 as visible, " + ", ".join(f"cast({x} as double) as m{j}" for j, x in enumerate(_matrix_text("i"))) + " from (select unnest(range(9)) as i) as r"
_M = [f"m{j}" for j in range(16)]
_GEOM_TRIS = f"select tri_id % 3 as geom_id, * from ({fx.TRIANGLES}) as t"


def _geometry_tris(spark, d) -> DataFrame:
    return fx.triangles(spark, d).withColumn("geom_id", F.col("tri_id") % 3)


_CORNERS = [affine(_M, tuple(f"{'max' if (k >> i) & 1 else 'min'}{c}" for i, c in enumerate(AXES))) for k in range(8)]
_GEOM_BOX = f"select geom_id, " + ", ".join(f"{f}({g}(a{c}, vb{c}, c{c})) as {f}{c}" for f, g in (("min", "least"), ("max", "greatest")) for c in AXES) + f" from ({_GEOM_TRIS}) as t group by geom_id"
_WORLD_BOX = "select object_id, instance_id, " + ", ".join(f"{f}({', '.join(k[i] for k in _CORNERS)}) as {n}{c}" for n, f in (("min", "least"), ("max", "greatest")) for i, c in enumerate(AXES)) + f" from ({_INST}) as i join ({_GEOM_BOX}) as g using (geom_id)"


@query("scene_bounds_instances", _WORLD_BOX)
def scene_bounds_instances(spark, d):
    t = _geometry_tris(spark, d)
    box = t.groupBy("geom_id").agg(*(F.expr(f"{f}({g}(a{c}, vb{c}, c{c}))").alias(f"{f}{c}") for f, g in (("min", "least"), ("max", "greatest")) for c in AXES))
    return scene.instance_bounds(_instances(spark), box)


_BAKED = {}
for _p in ("a", "vb", "c"):
    _BAKED |= {f"w{k}": v for k, v in named(_p, affine(_M, vec(_p))).items()}
_BAKE_INNER = nested_sql(f"select * from ({_GEOM_TRIS}) as t join ({_INST}) as i using (geom_id)", [_BAKED | {"det": determinant(_M)}])
_SWAP = ", ".join([f"case when det < 0 then wc{c} else wa{c} end as a{c}" for c in AXES] + [f"wvb{c} as vb{c}" for c in AXES] + [f"case when det < 0 then wa{c} else wc{c} end as c{c}" for c in AXES])


@query("bake_transform", f"select object_id, instance_id, tri_id, {_SWAP} from ({_BAKE_INNER}) as x")
def bake_transform(spark, d):
    return bake.bake_triangles(_geometry_tris(spark, d), _instances(spark))


@query("mirror_winding", "select tri_id, cx as ax, cy as ay, cz as az, vbx, vby, vbz, ax as cx, ay as cy, az as cz from (" + fx.TRIANGLES + ") as t")
def mirror_winding(spark, d):
    return bake.invert_winding(fx.triangles(spark, d))


_WORLD = "select object_id, instance_id, tri_id, " + ", ".join(f"w{p}{c} as {p}{c}" for p in ("a", "vb", "c") for c in AXES) + f" from ({_BAKE_INNER}) as x where visible"
_SCENE_HITS = oracles.ray_hits(fx.RAYS, _WORLD, ", object_id, instance_id")
_PLACE = "ray_id, object_id, instance_id, tri_id"


def _scene_hits(spark, d, first: str | None) -> DataFrame:
    hits = scene.raycast_scene(fx.rays(spark, d), _instances(spark), _geometry_tris(spark, d), first=first)
    return hits.select(*_PLACE.split(", "), F.round("distance", 6).alias("distance"))


@query("scene_raycast_all", f"select {_PLACE}, round(distance, 6) as distance from ({_SCENE_HITS}) as x")
def scene_raycast_all(spark, d):
    return _scene_hits(spark, d, None)


@query("scene_raycast_first", oracles.first(_SCENE_HITS, "ray_id", _PLACE))
def scene_raycast_first(spark, d):
    return _scene_hits(spark, d, "scene")


@query("batched_raycast_first", oracles.first(_SCENE_HITS, "ray_id, object_id, instance_id", _PLACE))
def batched_raycast_first(spark, d):
    return _scene_hits(spark, d, "instance")


_OBJECT = [0.8, 0.6, 0, 0, -0.6, 0.8, 0, 0, 0, 0, 1, 0, 0.1, 0, 0, 1]


@query("object_raycast", oracles.first(oracles.ray_hits(fx.RAYS, oracles.moved(fx.TRIANGLES, _OBJECT)), "ray_id", "ray_id, tri_id"))
def object_raycast(spark, d):
    hits = scene.raycast_object(fx.rays(spark, d), fx.triangles(spark, d), _OBJECT, first=True)
    return hits.select("ray_id", "tri_id", F.round("distance", 6).alias("distance"))


def _scaled_hits(prims: str, steps, keys: str, gap: str) -> str:
    """Hits on an object that is turned, three times as large and moved, found in the world."""
    return f"select {keys}, round(t * sqrt(dd), 6) as distance from ({nested_sql(f'select * from ({fx.EVENT_RAYS}) as r, ({prims}) as p', steps)}) as x where {gap}"


_SCALED = [2.4, 1.8, 0, 0, -1.8, 2.4, 0, 0, 0, 0, 3.0, 0, 10.0, -5.0, 2.0, 1]
_SCALED_TEXT = [f"cast({float(x)!r} as double)" for x in _SCALED]
_SCALED_POINTS = "select point_id, " + ", ".join(f"{e} as p{c}" for c, e in zip(AXES, affine(_SCALED_TEXT, vec("p")))) + f" from ({fx.POINTS}) as p"
_SCALED_SEGMENTS = "select seg_id, " + ", ".join(f"{e} as {n}{c}" for n, k in (("p", 0), ("q", 1)) for c, e in zip(AXES, affine(_SCALED_TEXT, tuple(f"{c}{k}" for c in AXES)))) + f" from ({fx.SEGMENTS}) as s"


@query("object_points_raycast", _scaled_hits(_SCALED_POINTS, exact.ray_point(), "ray_id, point_id", "gap2 < 36e0"))
def object_points_raycast(spark, d):
    hits = scene.raycast_object_points(fx.event_rays(spark, d), fx.points(spark, d), _SCALED, 6.0)
    return hits.select("ray_id", "point_id", F.round("distance", 6).alias("distance"))


@query("object_segments_raycast", _scaled_hits(_SCALED_SEGMENTS, exact.ray_segment(), "ray_id, seg_id", "gap2 <= 9e0"))
def object_segments_raycast(spark, d):
    segs = geometry.polyline_segments(fx.polyline_points(spark, d), "user_id", ["ts", "point_id"])
    hits = scene.raycast_object_segments(fx.event_rays(spark, d), segs, _SCALED, 3.0)
    return hits.select("ray_id", "seg_id", F.round("distance", 6).alias("distance"))


_ANY = " union all ".join([
    f"select 'triangles' as kind, ray_id, tri_id as prim_id, round(distance, 6) as distance from ({oracles.first(oracles.ray_hits(_ASIDE_RAYS, fx.TRIANGLES), 'ray_id', 'ray_id, tri_id')}) as t",
    f"select 'points' as kind, ray_id, point_id as prim_id, round(distance, 6) as distance from ({_points_sql('5e0')}) as p",
    f"select 'segments' as kind, ray_id, seg_id as prim_id, round(distance, 6) as distance from ({_segments_sql(fx.SEGMENTS, '2e0')}) as s",
])


@query("raycast_any", _ANY)
def raycast_any(spark, d):
    """One call for primitives of any kind: first hits of triangles, all of points and segments."""
    aside = fx.rays(spark, d).withColumns({"ox": F.col("ox") + 1e-3, "oy": F.col("oy") - 2e-3})
    segs = geometry.polyline_segments(fx.polyline_points(spark, d), "user_id", ["ts", "point_id"])
    found = {
        "triangles": scene.raycast_any(aside, fx.triangles(spark, d), first=True),
        "points": scene.raycast_any(fx.event_rays(spark, d), fx.points(spark, d), threshold=5.0),
        "segments": scene.raycast_any(fx.event_rays(spark, d), segs, threshold=2.0),
    }
    told = [f.select(F.lit(k).alias("kind"), "ray_id", "prim_id", F.round("distance", 6).alias("distance")) for k, f in found.items()]
    return told[0].unionAll(told[1]).unionAll(told[2])


_GEOM_VERTICES = " union all ".join(f"select tri_id % 3 as geom_id, tri_id * 3 + {i} as vid, " + ", ".join(f"{p}{c} as {c}" for c in AXES) + f" from ({fx.TRIANGLES}) as t" for i, p in enumerate(("a", "vb", "c")))


def _geometry_vertices(spark, d) -> DataFrame:
    corner = ", ".join(f"named_struct('k', {i}, 'x', {p}x, 'y', {p}y, 'z', {p}z)" for i, p in enumerate(("a", "vb", "c")))
    v = fx.triangles(spark, d).selectExpr("tri_id % 3 as geom_id", "tri_id", f"explode(array({corner})) as v")
    return v.selectExpr("geom_id", "tri_id * 3 + v.k as vid", "v.x", "v.y", "v.z")


_MOVED_VERTEX = affine(_M, vec(""))


@query("scene_precise_bounds", "select object_id, instance_id, " + ", ".join(f"{f}({e}) as {f}{c}" for f in ("min", "max") for c, e in zip(AXES, _MOVED_VERTEX)) + f" from ({_INST}) as i join ({_GEOM_VERTICES}) as v using (geom_id) group by 1, 2")
def scene_precise_bounds(spark, d):
    return scene.precise_bounds(_instances(spark), _geometry_vertices(spark, d))


_SHRUNK = ", ".join(f"{g}({f}{c}, {e} {s} radius * {largest}) as {f}{c}" for largest in ["greatest(" + ", ".join("sqrt(" + " + ".join(f"m{4 * j + r} * m{4 * j + r}" for r in range(3)) + ")" for j in range(3)) + ")"] for f, g, s in (("min", "greatest", "-"), ("max", "least", "+")) for c, e in zip(AXES, _MOVED_VERTEX))


@query("scene_sphere_bounds", f"select object_id, instance_id, {_SHRUNK} from ({_WORLD_BOX}) as w join ({_INST}) as i using (object_id, instance_id) join (select *, (minx + maxx) / 2e0 as x, (miny + maxy) / 2e0 as y, (minz + maxz) / 2e0 as z, 1e0 + geom_id / 4e0 as radius from ({_GEOM_BOX}) as b) as g (geom_id, gminx, gminy, gminz, gmaxx, gmaxy, gmaxz, x, y, z, radius) using (geom_id)")
def scene_sphere_bounds(spark, d):
    """Bounds shrunk by bounding spheres (here of made-up radii)."""
    t = _geometry_tris(spark, d)
    box = t.groupBy("geom_id").agg(*(F.expr(f"{f}({g}(a{c}, vb{c}, c{c}))").alias(f"{f}{c}") for f, g in (("min", "least"), ("max", "greatest")) for c in AXES))
    sphere = box.withColumns({f"s{c}": F.expr(f"(min{c} + max{c}) / 2e0") for c in AXES} | {"radius": F.expr("1e0 + geom_id / 4e0")})
    return scene.instance_bounds(_instances(spark), sphere)


_COFACTORS = [cross(tuple(_M[4 * ((j + 1) % 3) + r] for r in range(3)), tuple(_M[4 * ((j + 2) % 3) + r] for r in range(3))) for j in range(3)]
_NORMALS = {f"un{c}": "(" + " + ".join(f"{_COFACTORS[j][r]} * n{k}" for j, k in enumerate(AXES)) + ") / det" for r, c in enumerate(AXES)}
_TANGENTS = {f"ut{c}": "(" + " + ".join(f"{_M[4 * j + r]} * t{k}" for j, k in enumerate(AXES)) + ")" for r, c in enumerate(AXES)}
_FRAMED = "select *, " + ", ".join(f"{e} as n{c}, {g} as t{c}" for c, e, g in zip(AXES, ("x", "z", "-y"), ("y", "-x", "5e-1"))) + ", x + y as u, z as v, 1e0 as tw from ({}) as f"
_BAKED_VERTICES = nested_sql(f"select * from ({_FRAMED.format(_GEOM_VERTICES)}) as v join ({_INST}) as i using (geom_id)", [{"det": determinant(_M)} | {f"w{c}": e for c, e in zip(AXES, _MOVED_VERTEX)}, _NORMALS | _TANGENTS])
_FRAME_OUT = ", ".join([f"round(w{c}, 9) as {c}" for c in AXES] + [f"round(u{k}{c} / sqrt(u{k}x * u{k}x + u{k}y * u{k}y + u{k}z * u{k}z), 9) as {k}{c}" for k in "nt" for c in AXES])


@query("bake_attributes", f"select object_id, instance_id, vid, u, v, tw, {_FRAME_OUT} from ({_BAKED_VERTICES}) as b")
def bake_attributes(spark, d):
    v = _geometry_vertices(spark, d).selectExpr("*", *(f"{e} as n{c}" for c, e in zip(AXES, ("x", "z", "-y"))), *(f"{e} as t{c}" for c, e in zip(AXES, ("y", "-x", "5e-1"))), "x + y as u", "z as v", "1e0 as tw")
    made = bake.bake_vertices(v, _instances(spark))
    return made.select("object_id", "instance_id", "vid", "u", "v", "tw", *(F.round(f"{k}{c}", 9).alias(f"{k}{c}") for k in ("", "n", "t") for c in AXES))


_ORDER_COUNTS = "select o_custkey as geom_id, count(*) as n, cast(sum(count(*)) over (order by o_custkey rows unbounded preceding) - count(*) as bigint) as before, cast(row_number() over (order by o_custkey) - 1 as bigint) as nth from orders group by o_custkey"


@query("merge_groups", f"select before as start, n as count, nth as material_index from ({_ORDER_COUNTS}) as o")
def merge_groups(spark, d):
    n = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("geom_id")).agg(F.count("*").alias("n_vertices"))
    return bake.merge_groups(n)


_SLOTS = "select o_custkey as geom_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as slot from orders"


@query("merge_index", f"select s.geom_id, cast(s.slot + c.before as bigint) as slot, cast((s.slot * 7) % c.n + c.before as bigint) as vid from ({_SLOTS}) as s join ({_ORDER_COUNTS}) as c using (geom_id) where s.geom_id <> 7")
def merge_index(spark, d):
    """Indices of geometries, each row a slot, into one; a geometry that has not changed is skipped."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    counts = o.groupBy(F.col("o_custkey").alias("geom_id")).agg(F.count("*").alias("n_vertices"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    slots = o.select(F.col("o_custkey").alias("geom_id"), (F.row_number().over(w) - 1).cast("long").alias("slot"))
    index_ = slots.join(counts, "geom_id").select("geom_id", "slot", ((F.col("slot") * 7) % F.col("n_vertices")).alias("vid"))
    return bake.merge_index(index_, counts, counts, skip=[7])


@query("scene_collect", "with recursive tree as (select cast(n_nationkey as bigint) as id, cast(n_nationkey / 3 as bigint) - 1 as parent_id, case n_regionkey when 0 then 'mesh' when 1 then 'line' else 'group' end as kind from nation), down as (select cast(0 as bigint) as id union select t.id from tree t join down d on t.parent_id = d.id) select distinct t.id from tree t join down d on t.id = d.id where kind in ('mesh', 'line')".replace("n_nationkey / 3", "n_nationkey // 3"))
def scene_collect(spark, d):
    tree = spark.read.parquet(f"{d}/nation.parquet").selectExpr("cast(n_nationkey as bigint) as id", "cast(n_nationkey div 3 as bigint) - 1 as parent_id", "case n_regionkey when 0 then 'mesh' when 1 then 'line' else 'group' end as kind")
    return scene.collect_objects(tree, spark.range(1), ("mesh", "line", "points"))


@query("scene_visibility", "with recursive tree as (select cast(n_nationkey as bigint) as id, nullif(cast(n_nationkey // 3 as bigint) - 1, -1) as parent_id, n_nationkey % 7 <> 3 as visible from nation), down as (select id, visible as seen from tree where parent_id is null union all select t.id, t.visible and d.seen from tree as t join down as d on t.parent_id = d.id) select id, seen from down")
def scene_visibility(spark, d):
    tree = spark.read.parquet(f"{d}/nation.parquet").selectExpr("cast(n_nationkey as bigint) as id", "nullif(cast(n_nationkey div 3 as bigint) - 1, -1) as parent_id", "n_nationkey % 7 <> 3 as visible")
    return scene.visible_objects(tree)


@query("update_transforms", "select vec_id as object_id, label as instance_id, " + ", ".join(f"cast(embedding[{i + 1}] as double) * case when vec_id % 7 = 2 then 2e0 else 1e0 end as m{i}" for i in range(16)) + ", label <> 3 and vec_id % 5 <> 1 as visible from embeddings")
def update_transforms(spark, d):
    """New matrices for some of the instances, and objects that are no longer seen."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id as object_id", "label as instance_id", "transform(slice(embedding, 1, 16), x -> cast(x as double)) as matrix", "label <> 3 as visible")
    new = e.where("object_id % 7 = 2").withColumn("matrix", F.transform("matrix", lambda x: x * 2))
    out = scene.update_transforms(e, e.selectExpr("object_id as id", "object_id % 5 <> 1 as seen"), new)
    return out.select("object_id", "instance_id", *(F.col("matrix")[i].alias(f"m{i}") for i in range(16)), "visible")


@query("merge_offsets", "select o_custkey as geom_id, count(*) as n_vertices, cast(sum(count(*)) over (order by o_custkey rows unbounded preceding) - count(*) as bigint) as first_vertex from orders group by o_custkey")
def merge_offsets(spark, d):
    n = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("geom_id")).agg(F.count("*").alias("n_vertices"))
    return bake.merge_offsets(n)


def _morph_tables(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = e.selectExpr("cast(label as bigint) as geom_id", "vec_id as vid", *(f"cast(embedding[{i}] as double) as {c}" for i, c in enumerate(AXES)))
    t = e.selectExpr("cast(label as bigint) as geom_id", "vec_id as vid", "embedding", "explode(sequence(0, 1)) as target").selectExpr("geom_id", "vid", "target", "25e-2 * (target + 1) as influence", *(f"cast(embedding[3 + 3 * target + {i}] as double) as {c}" for i, c in enumerate(AXES)))
    return v, t


@query("morph_blend", "select cast(label as bigint) as geom_id, vec_id as vid, " + ", ".join(f"cast(embedding[{i + 1}] as double) + (25e-2 * cast(embedding[{i + 4}] as double) + 5e-1 * cast(embedding[{i + 7}] as double)) as {c}" for i, c in enumerate(AXES)) + " from embeddings")
def morph_blend(spark, d):
    return bake.morph(*_morph_tables(spark, d))


@query("change_detection", f"with s as ({fx.SPHERES}), n as (select case when sphere_id % 5 = 0 then sphere_id + 1000000 else sphere_id end as sphere_id, px, py, pz, case when sphere_id % 7 = 0 then r * 2e0 else r end as r from s) select coalesce(s.sphere_id, n.sphere_id) as sphere_id, case when s.sphere_id is null then 'added' when n.sphere_id is null then 'removed' else 'changed' end as change from s full join n on s.sphere_id = n.sphere_id where s.sphere_id is null or n.sphere_id is null or s.r <> n.r")
def change_detection(spark, d):
    old = fx.spheres(spark, d)
    new = old.withColumns({"r": F.expr("case when sphere_id % 7 = 0 then r * 2e0 else r end"), "sphere_id": F.expr("case when sphere_id % 5 = 0 then sphere_id + 1000000 else sphere_id end")})
    return bake.changed(old, new, "sphere_id")


@query("material_list", "select p_size as mesh_id, cast(nr - 1 as int) as slot, p_brand as material from (select p_size, p_brand, row_number() over (partition by p_size order by p_brand) as nr from (select distinct p_size, p_brand from part) as d) as x")
def material_list(spark, d):
    meshes = spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_size").alias("mesh_id")).agg(F.sort_array(F.collect_set("p_brand")).alias("materials"))
    return bake.materials(meshes).select("mesh_id", "slot", "material")


# ---- index ----------------------------------------------------------------

_UNION = ", ".join(f"{f}({f}{c}) as {f}{c}" for f in ("min", "max") for c in AXES)
_MIDS = ", ".join(f"{f}((min{c} + max{c}) / 2e0) as c{f}{c}" for f in ("min", "max") for c in AXES)
_NODE = f"select {_UNION}, {_MIDS}, count(*) as n from ({fx.AABBS}) as b"


@query("build_bounds", _NODE)
def build_bounds(spark, d):
    return index.node_bounds(fx.aabbs(spark, d))


@query("bounding_box", f"select {_UNION} from ({fx.AABBS}) as b")
def bounding_box(spark, d):
    return index.node_bounds(fx.aabbs(spark, d)).select(*BOX)


@query("center_split", f"select axis, case axis when 0 then (cminx + cmaxx) / 2e0 when 1 then (cminy + cmaxy) / 2e0 else (cminz + cmaxz) / 2e0 end as position, n from (select *, {bounds.longest_axis('c')} as axis from ({_NODE}) as x) as y")
def center_split(spark, d):
    return index.center_split(fx.aabbs(spark, d))


_SUMS = ", ".join(f"sum(cast((min{c} + max{c}) / 2e0 as decimal(28, 6))) as s{c}" for c in AXES)


@query("average_split", f"select axis, cast(case axis when 0 then sx when 1 then sy else sz end as double) / cast(n as double) as position, n from (select *, {bounds.longest_axis()} as axis from (select {_UNION}, {_SUMS}, count(*) as n from ({fx.AABBS}) as b) as x) as y")
def average_split(spark, d):
    return index.average_split(fx.aabbs(spark, d))


_HIST = "select axis, cast(least(31, floor((c - lo) / (hi - lo) * 32)) as int) as bin, count(*) as n, " + _UNION + " from (" + " union all ".join(f"select {i} as axis, (min{c} + max{c}) / 2e0 as c, (select min((min{c} + max{c}) / 2e0) from boxed) as lo, (select max((min{c} + max{c}) / 2e0) from boxed) as hi, {', '.join(BOX)} from boxed" for i, c in enumerate(AXES)) + ") as r group by 1, 2"
_HIST_SQL = f"with boxed as ({fx.AABBS}) {_HIST}"


@query("sah_histogram", _HIST_SQL)
def sah_histogram(spark, d):
    return index.sah_histogram(fx.aabbs(spark, d))


def _running(p: str, frame: str) -> str:
    return ", ".join(f"{f}({f}{c}) over (partition by axis order by bin {frame}) as {p}{f}{c}" for f in ("min", "max") for c in AXES) + f", sum(n) over (partition by axis order by bin {frame}) as {p}n"


_RATIO = f"({bounds.surface_area('l_')} * l_n + {bounds.surface_area('r_')} * r_n) / nullif({bounds.surface_area('w_')}, 0e0)"
_COSTS = f"with boxed as ({fx.AABBS}), h as ({_HIST}), k as (select axis, bin, {_running('l_', 'rows unbounded preceding')}, {_running('r_', 'rows between 1 following and unbounded following')}, {_running('w_', 'rows between unbounded preceding and unbounded following')} from h) select axis, bin, 1e0 + 125e-2 * ({_RATIO}) as cost, cast(w_n as bigint) as n from k where r_n > 0"


@query("sah_costs", _COSTS)
def sah_costs(spark, d):
    return index.sah_costs(index.sah_histogram(fx.aabbs(spark, d)))


@query("sah_best_split", f"select * from ({_COSTS}) as c where cost < 125e-2 * n order by cost, axis, bin limit 1")
def sah_best_split(spark, d):
    return index.sah_best(index.sah_histogram(fx.aabbs(spark, d)))


@query("partition_sides", f"select box_id, case when (minx + maxx) / 2e0 < 25e-3 then 'left' else 'right' end as side from ({fx.AABBS}) as b")
def partition_sides(spark, d):
    return index.partition_sides(fx.aabbs(spark, d), 0, 0.025).select("box_id", "side")


def _index(spark, d, strategy="center"):
    b = fx.aabbs(spark, d).withColumn("root_id", (F.col("box_id") % 4).cast("int"))
    return (*index.build_nodes(b, strategy=strategy), b)


@query("index_coverage", f"select cast(box_id % 4 as int) as root_id, count(*) as primitives, {_UNION} from ({fx.AABBS}) as b group by 1")
def index_coverage(spark, d):
    """Root nodes: bounds and size of each whole hierarchy."""
    nodes, _, _ = _index(spark, d)
    return nodes.where("parent_id < 0").select("root_id", F.col("count").alias("primitives"), *BOX)


_ROOTED = f"select cast(box_id % 4 as int) as root_id, * from ({fx.AABBS}) as b"
_AREA = bounds.surface_area()


@query("build_leaves", oracles.tree(_ROOTED, "select n.root_id, n.node_id, n.depth, m.box_id from node as n join member as m on n.root_id = m.root_id and n.path = m.path where n.is_leaf"))
def build_leaves(spark, d):
    """The leaf of every box."""
    nodes, order, _ = _index(spark, d)
    leaf = nodes.where("is_leaf").select("root_id", "node_id", "depth", F.explode(F.sequence("offset", F.col("offset") + F.col("count") - 1)).alias("slot"))
    return leaf.join(order, ["root_id", "slot"]).select("root_id", "node_id", "depth", "box_id")


@query("build_nodes", oracles.tree(_ROOTED, f"select root_id, node_id, depth, is_leaf, count, {', '.join(BOX)} from node"))
def build_nodes(spark, d):
    return _index(spark, d)[0].select("root_id", "node_id", "depth", "is_leaf", "count", *BOX)


_EXTREMES = (
    "select root_id, count(*) as node_count, count(case when is_leaf then 1 end) as leaf_count, min(case when is_leaf then depth end) as min_depth, max(case when is_leaf then depth end) as max_depth, "
    "min(case when is_leaf then count end) as min_primitives, max(case when is_leaf then count end) as max_primitives, "
    f"round(sum({_AREA} * case when is_leaf then 125e-2 * count else 1e0 end), 6) as area_score from node group by root_id"
)


@query("tree_extremes", oracles.tree(_ROOTED, _EXTREMES))
def tree_extremes(spark, d):
    found = index.tree_extremes(_index(spark, d)[0]).withColumn("area_score", F.round("area_score", 6))
    return found.drop(*(f"splits_{c}" for c in AXES))


@query("tree_extremes_sah", f"select cast(box_id % 4 as int) as root_id, count(*) as primitives, true as cheaper, true as small_leaves from ({fx.AABBS}) as b group by 1")
def tree_extremes_sah(spark, d):
    """Hierarchies by the surface-area heuristic: all boxes lie in leaves, and the area score is below that of centre splits."""
    sah, center = (index.tree_extremes(_index(spark, d, s)[0]).select("root_id", F.col("area_score").alias(f"{s}_score"), F.col("max_primitives").alias(f"{s}_most")) for s in ("sah", "center"))
    leaves = _index(spark, d, "sah")[0].where("is_leaf").groupBy("root_id").agg(F.sum("count").alias("primitives"))
    both = leaves.join(sah, "root_id").join(center, "root_id")
    return both.select("root_id", "primitives", (F.col("sah_score") < F.col("center_score")).alias("cheaper"), (F.col("sah_most") <= 10).alias("small_leaves"))


@query("validate_bounds", f"select cast(box_id % 4 as int) as root_id, count(*) as primitives, cast(0 as bigint) as bad_nodes, cast(0 as bigint) as bad_primitives from ({fx.AABBS}) as b group by 1")
def validate_bounds(spark, d):
    return index.validate_bounds(*_index(spark, d, "average"))


def _refitted(when: str, by: str) -> str:
    """Bounds of all nodes after some boxes moved, by the members of each."""
    moved = ", ".join(f"{f}({f}{c} + case when {when} then {by} else 0e0 end) as {f}{c}" for f in ("min", "max") for c in AXES)
    held = f"select root_id, path, {moved} from placed group by root_id, path"
    return oracles.tree(_ROOTED, f"select n.root_id, n.node_id, {', '.join(f'h.{x}' for x in BOX)} from node as n join ({held}) as h on n.root_id = h.root_id and n.path = h.path")


@query("refit_bounds", _refitted("box_id % 2 = 0", "5e-1"))
def refit_bounds(spark, d):
    nodes, order, b = _index(spark, d)
    moved = b.withColumns({x: F.expr(f"{x} + case when box_id % 2 = 0 then 5e-1 else 0e0 end") for x in BOX})
    return index.refit(nodes, order, moved).select("root_id", "node_id", *BOX)


@query("shift_offsets", f"select cast(box_id % 4 as int) as root_id, box_id + 1000 as box_id from ({fx.AABBS}) as b")
def shift_offsets(spark, d):
    return index.shift_offsets(_index(spark, d)[1], 1000).select("root_id", "box_id")


_CUT = f"select root_id, node_id, count, {', '.join(BOX)} from node as n where (count < 64 or is_leaf) and not exists (select 1 from node as p where p.root_id = n.root_id and p.path <> n.path and starts_with(n.path, p.path) and p.count < 64)"


@query("cluster_cut", oracles.tree(_ROOTED, _CUT))
def cluster_cut(spark, d):
    return index.cluster_cut(_index(spark, d)[0], 64).select("root_id", "node_id", "count", *BOX)


_SHOWN = ", ".join(f"case when (corner >> {i}) & 1 = 1 then max{c} else min{c} end as {c}" for i, c in enumerate(AXES))


@query("tree_wireframe", oracles.tree(_ROOTED, f"select root_id, node_id, cast(corner as int) as corner, {_SHOWN} from node, (select unnest(range(8)) as corner) as k where depth = 3 or is_leaf and depth < 3"))
def tree_wireframe(spark, d):
    return index.wireframe(_index(spark, d)[0], 3)


_LOW, _HIGH = 10, 1500
_RANGES = f"with g as (select p_size % 3 as geom_id, p_partkey as s, p_size % 7 + 1 as n from part where p_size % 4 = 0), c as (select geom_id, greatest(s, {_LOW}) as s, least(s + n, {_HIGH}) as e from g where greatest(s, {_LOW}) < least(s + n, {_HIGH})), p as (select geom_id, s as pos from c union select geom_id, e from c), q as (select geom_id, pos, lead(pos) over (partition by geom_id order by pos) as nxt from p) select cast(geom_id as bigint) as geom_id, cast(pos as bigint) as range_start, cast(nxt as bigint) as range_end from q where nxt is not null and exists (select 1 from c where c.geom_id = q.geom_id and c.s <= q.pos and c.e >= q.nxt)"


@query("group_root_ranges", _RANGES)
def group_root_ranges(spark, d):
    """Overlapping groups of parts, cut at each other's ends."""
    groups = spark.read.parquet(f"{d}/part.parquet").where("p_size % 4 = 0").selectExpr("cast(p_size % 3 as long) as geom_id", "p_partkey as start", "cast(p_size % 7 + 1 as long) as count")
    return geometry.root_ranges(groups, _LOW, _HIGH)


@query("range_filter", f"with r as ({_RANGES}) select t.tri_id, r.range_start from ({fx.TRIANGLES}) as t join r on r.geom_id = 0 and t.tri_id >= r.range_start and t.tri_id < r.range_end")
def range_filter(spark, d):
    t = fx.triangles(spark, d).withColumn("geom_id", F.lit(0).cast("long"))
    return geometry.in_ranges(t, group_root_ranges(spark, d)).select("tri_id", "range_start")


@query("triangle_deref", f"select cast(0 as bigint) as geom_id, tri_id, ax, ay, az, vbx, vby, vbz, cx, cy, cz from ({fx.TRIANGLES}) as t")
def triangle_deref(spark, d):
    t = fx.triangles(spark, d)
    corner = [F.struct(F.lit(i).alias("corner"), *(F.col(f"{p}{c}").alias(c) for c in AXES)) for i, p in enumerate(("a", "vb", "c"))]
    v = t.select("tri_id", F.explode(F.array(*corner)).alias("v")).select(F.lit(0).cast("long").alias("geom_id"), (F.col("tri_id") * 3 + F.col("v.corner")).alias("vid"), "v.x", "v.y", "v.z")
    return geometry.triangles_from_index(v, geometry.ensure_index(v)).select("geom_id", "tri_id", *rays.TRIANGLE)


@query("vertex_counts", "select cast(0 as bigint) as geom_id, cast(count(*) * 21 as bigint) as n_vertices, cast(count(*) * 7 as bigint) as n_triangles from embeddings")
def vertex_counts(spark, d):
    v = fx.triangles(spark, d).select(F.lit(0).cast("long").alias("geom_id"), F.explode(F.array(F.col("tri_id") * 3, F.col("tri_id") * 3 + 1, F.col("tri_id") * 3 + 2)).alias("vid"))
    return geometry.counts(v)


# ---- composites -----------------------------------------------------------

_INTERVALS = "select o_custkey as k, o_orderkey % 1000 as lo, o_orderkey % 1000 + o_orderkey % 17 as hi from orders"


@query("interval_compress", f"select k, min(lo) as lo, max(hi) as hi from (select *, sum(o) over (partition by k order by lo, hi rows unbounded preceding) as i from (select *, case when lo <= max(hi) over (partition by k order by lo, hi rows between unbounded preceding and 1 preceding) then 0 else 1 end as o from ({_INTERVALS}) as a) as b) as c group by k, i")
def interval_compress(spark, d):
    v = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey as k", "o_orderkey % 1000 as lo", "o_orderkey % 1000 + o_orderkey % 17 as hi")
    return composite.compress_intervals(v, "k")


_POLYGON = [(0.0, 0.0), (60.0, 10.0), (90.0, 90.0), (40.0, 40.0), (10.0, 95.0)]
_f = lambda v: f"cast({v!r} as double)"
_CROSS = " + ".join(f"case when ({_f(y0)} > y) <> ({_f(y1)} > y) and x < {_f(x0)} + (y - {_f(y0)}) * (({_f(x1)} - {_f(x0)}) / nullif({_f(y1)} - {_f(y0)}, 0e0)) then 1 else 0 end" for (x0, y0), (x1, y1) in zip(_POLYGON, _POLYGON[1:] + _POLYGON[:1]))


@query("point_in_polygon", f"select event_id as point_id, ({_CROSS}) % 2 = 1 as inside from (select event_id, cast(user_id as double) as x, value as y from events) as p")
def point_in_polygon(spark, d):
    p = fx.points(spark, d).selectExpr("point_id", "px as x", "py as y")
    return composite.points_in_polygon(p, _POLYGON)


@query("segment_crossing", f"with s as (select tri_id as seg_id, ax as x0, ay as y0, vbx as x1, vby as y1 from ({fx.TRIANGLES}) as t) select a.seg_id as a_id, b.seg_id as b_id from s a join s b on a.seg_id < b.seg_id and least(a.x0, a.x1) <= greatest(b.x0, b.x1) and least(b.x0, b.x1) <= greatest(a.x0, a.x1) and least(a.y0, a.y1) <= greatest(b.y0, b.y1) and least(b.y0, b.y1) <= greatest(a.y0, a.y1) where {composite.SEGMENTS_CROSS.replace('a_', 'a.').replace('b_', 'b.')}")
def segment_crossing(spark, d):
    return composite.segment_crossings(fx.triangles(spark, d).selectExpr("tri_id as seg_id", "ax as x0", "ay as y0", "vbx as x1", "vby as y1"))


@query("convex_hull", oracles.hulls("select distinct event_type as k, cast(user_id as double) as x, value as y from events", "event_type"))
def convex_hull(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_type", "cast(user_id as double) as x", "value as y")
    return composite.convex_hulls(e, "event_type")


_HEIGHT = {p: f"(p{p}x * 1e0 + p{p}y * 5e-1 + p{p}z * -25e-2 + 1e-2)" for p in "pq"}
_SIDES_OF = ", ".join("{'k': " + str(i) + ", " + ", ".join(f"'pp{c}': {('a', 'vb', 'c')[i]}{c}, 'pq{c}': {('a', 'vb', 'c')[(i + 1) % 3]}{c}" for c in AXES) + "}" for i in range(3))
_CUTS = f"select tri_id, k, " + ", ".join(f"pp{c} + (pq{c} - pp{c}) * (hp / (hp - hq)) as {c}" for c in AXES) + f" from (select *, {_HEIGHT['p']} as hp, {_HEIGHT['q']} as hq from (select tri_id, unnest([{_SIDES_OF}], recursive := true) from ({fx.TRIANGLES}) as t) as e) as h where (hp <= 0e0) <> (hq <= 0e0)"
_ENDS = ", ".join(f"round(arg_{f}({c}, k), 6) as {c}{i}" for i, f in enumerate(("min", "max")) for c in AXES)


@query("plane_section_edges", f"select tri_id, {_ENDS} from ({_CUTS}) as c group by tri_id having count(*) = 2")
def plane_section_edges(spark, d):
    cut = composite.plane_section(fx.triangles(spark, d), (1.0, 0.5, -0.25), 0.01)
    return cut.select("tri_id", *(F.round(f"{c}{i}", 6).alias(f"{c}{i}") for i in (0, 1) for c in AXES))


_KEYS = {p: "concat_ws('_', " + ", ".join(f"cast(cast(round({p}{c} * 1e4) as bigint) as varchar)" for c in AXES) + ")" for p in ("a", "vb", "c")}
_FACED = f"select tri_id, nx / nn as nx, ny / nn as ny, nz / nn as nz, unnest([{{'p': ka, 'q': kb}}, {{'p': kb, 'q': kc}}, {{'p': kc, 'q': ka}}], recursive := true) from (select *, sqrt{dot(vec('n'), vec('n'))} as nn from (select tri_id, {_KEYS['a']} as ka, {_KEYS['vb']} as kb, {_KEYS['c']} as kc, {', '.join(f'{e} as n{c}' for c, e in zip(AXES, cross(sub(vec('vb'), vec('a')), sub(vec('c'), vec('a')))))} from ({fx.TRIANGLES}) as t) as m) as l where nn > 0e0"
_SHARED = " + ".join(f"arg_min(n{c}, tri_id) * arg_max(n{c}, tri_id)" for c in AXES)


_TOWARDS = (0.2, -0.4, 1.0)
_SEEN = ["sign(" + " + ".join(f"{f}(n{c}, tri_id) * {x!r}::double" for c, x in zip(AXES, _TOWARDS)) + ")" for f in ("arg_min", "arg_max")]
_GRID_SQL = "select i * 2 + h as tri_id, " + ", ".join(f"{e} as {p}{c}" for p, (x, y) in (("a", ("i % 12", "i // 12")), ("vb", ("i % 12 + 1", "i // 12 + h")), ("c", ("i % 12 + 1 - h", "i // 12 + 1"))) for c, e in (("x", f"cast({x} as double)"), ("y", f"cast({y} as double)"), ("z", f"cast((({x}) * ({x}) * 5 + ({y}) * ({y}) * 3) % 7 as double) / 4e0"))) + " from (select unnest(range(144)) as i) as r, (select unnest([0, 1]) as h) as k"


def _faced(tris: str) -> str:
    return _FACED.replace(fx.TRIANGLES, tris)


@query("silhouette_edges", f"select least(p, q) as lo, greatest(p, q) as hi, count(*) as faces from ({_faced(_GRID_SQL)}) as f group by 1, 2 having count(*) <> 2 or {_SHARED} <= 5e-1 or {_SEEN[0]} <> {_SEEN[1]}")
def silhouette_edges(spark, d):
    """Edges of a bumpy grid: its rim, its sharp folds, and where it turns away from the view."""
    grid = spark.range(144).selectExpr("id as i", "explode(array(0, 1)) as h")
    at = {"a": ("i % 12", "i div 12"), "vb": ("i % 12 + 1", "i div 12 + h"), "c": ("i % 12 + 1 - h", "i div 12 + 1")}
    cols = [f"{e} as {p}{c}" for p, (x, y) in at.items() for c, e in (("x", f"cast({x} as double)"), ("y", f"cast({y} as double)"), ("z", f"cast((({x}) * ({x}) * 5 + ({y}) * ({y}) * 3) % 7 as double) / 4e0"))]
    return composite.feature_edges(grid.selectExpr("i * 2 + h as tri_id", *cols), 0.5, direction=_TOWARDS)


@query("feature_edges", f"select least(p, q) as lo, greatest(p, q) as hi, count(*) as faces from ({_FACED}) as f where p <> q group by 1, 2 having count(*) <> 2 or {_SHARED} <= 9998e-4")
def feature_edges(spark, d):
    return composite.feature_edges(fx.triangles(spark, d))


def _cells(n: int) -> str:
    edges = ", ".join(f"wmin{c} + (wmax{c} - wmin{c}) * ((i{c} + {int(k == 'max')}) / {n}e0) as {k}{c}" for k in ("min", "max") for c in AXES)
    whole = ", ".join(f"{f}({g}(a{c}, vb{c}, c{c})) as w{f}{c}" for f, g in (("min", "least"), ("max", "greatest")) for c in AXES)
    return f"select cell as box_id, cell, ix, iy, iz, {edges} from (select i as cell, i // {n * n} as ix, i // {n} % {n} as iy, i % {n} as iz from (select unnest(range({n**3})) as i) as r) as k, (select {whole} from ({fx.TRIANGLES}) as t) as w"


def _inside_cells(n: int) -> str:
    """Cells whose centre's +x ray first meets a back face."""
    rays_ = "select cell as ray_id, " + ", ".join(f"(min{c} + max{c}) / 2e0 as o{c}" for c in AXES) + f", 1e0 as dx, 0e0 as dy, 0e0 as dz from ({_cells(n)}) as g"
    facing = cross(sub(vec("vb"), vec("a")), sub(vec("c"), vec("a")))[0]
    hits = f"select h.*, t.nx from ({oracles.ray_hits(rays_, fx.TRIANGLES)}) as h join (select tri_id, {facing} as nx from ({fx.TRIANGLES}) as t) as t using (tri_id)"
    return f"select ray_id as cell from (select *, row_number() over (partition by ray_id order by distance, tri_id) as nr from ({hits}) as x) as y where nr = 1 and nx > 0e0"


_VOXELS = f"select cell, ix, iy, iz, case when touched then 'surface' else 'inside' end as kind from (select *, cell in (select box_id from ({oracles.box_triangles(_cells(12), fx.TRIANGLES)}) as h) as touched, cell in ({_inside_cells(12)}) as inner from ({_cells(12)}) as c) as v where touched or inner".replace("inner", "inside")


@query("voxel_grid", _VOXELS)
def voxel_grid(spark, d):
    return composite.voxelize(fx.triangles(spark, d), 12)


_CENTRES = "select cell as query_id, " + ", ".join(f"(min{c} + max{c}) / 2e0 as p{c}" for c in AXES) + f" from ({_cells(10)}) as g"
_FIELD = f"select query_id as cell, round(case when query_id in ({_inside_cells(10)}) then -sqrt(d2) else sqrt(d2) end, 6) as distance from (select query_id, min(d2) as d2 from ({nested_sql(f'select * from ({_CENTRES}) as q, ({fx.TRIANGLES}) as t', exact.closest_on_triangle())}) as a group by query_id) as b"


@query("signed_distance_grid", _FIELD)
def signed_distance_grid(spark, d):
    return composite.distance_field(fx.triangles(spark, d), 10).withColumn("distance", F.round("distance", 6))


@query("within_distance", f"select query_id from ({_NEAR}) as n where distance < 5e-2")
def within_distance(spark, d):
    return composite.within_distance(fx.query_points(spark, d), fx.triangles(spark, d), 0.05)


@query("capsule_push_out")
def capsule_push_out(spark, d):
    p = fx.spheres(spark, d).selectExpr("sphere_id as probe_id", "px", "py", "pz", "px as qx", "py as qy", "pz + 1e-1 as qz", "r")
    return composite.push_out(p, fx.triangles(spark, d))


@query("interval_gaps", f"with m as ({ORACLES['interval_compress']}), g as (select k, coalesce(lag(hi) over (partition by k order by lo), 0) as a, lo as b from m union all select k, max(hi), 1100 from m group by k) select k, a as lo, b as hi from g where a < b")
def interval_gaps(spark, d):
    v = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey as k", "o_orderkey % 1000 as lo", "o_orderkey % 1000 + o_orderkey % 17 as hi")
    return composite.gaps_between(v, "k", 0, 1100)


_LASSO = [(-0.3, -0.3), (0.4, -0.2), (0.3, 0.35), (-0.25, 0.3)]
_LASSO_CROSS = " + ".join(f"case when ({_f(y0)} > y) <> ({_f(y1)} > y) and x < {_f(x0)} + (y - {_f(y0)}) * (({_f(x1)} - {_f(x0)}) / nullif({_f(y1)} - {_f(y0)}, 0e0)) then 1 else 0 end" for (x0, y0), (x1, y1) in zip(_LASSO, _LASSO[1:] + _LASSO[:1]))


@query("lasso_centroids", f"select tri_id from (select tri_id, (ax + vbx + cx) / 3e0 as x, (ay + vby + cy) / 3e0 as y from ({fx.TRIANGLES}) as t) as m where ({_LASSO_CROSS}) % 2 = 1")
def lasso_centroids(spark, d):
    return composite.lasso_select(fx.triangles(spark, d), _LASSO)


_LASSO_EDGES = " or ".join(f"({composite.SEGMENTS_CROSS.replace('b_x0', _f(x0)).replace('b_y0', _f(y0)).replace('b_x1', _f(x1)).replace('b_y1', _f(y1))})" for (x0, y0), (x1, y1) in zip(_LASSO, _LASSO[1:] + _LASSO[:1]))
_LASSO_SIDES = ", ".join(f"{{'x': {p}x, 'y': {p}y, 'a_x0': {p}x, 'a_y0': {p}y, 'a_x1': {q}x, 'a_y1': {q}y}}" for p, q in (("a", "vb"), ("vb", "c"), ("c", "a")))
_LASSO_CENTRES = f"select tri_id, x, y, z from (select tri_id, (ax + vbx + cx) / 3e0 as x, (ay + vby + cy) / 3e0 as y, (az + vbz + cz) / 3e0 as z from ({fx.TRIANGLES}) as t) as m where ({_LASSO_CROSS}) % 2 = 1"
_LASSO_RAYS = f"select tri_id as ray_id, 0e0 as ox, 0e0 as oy, 10e0 as oz, x as dx, y as dy, z - 10e0 as dz from ({_LASSO_CENTRES}) as l"


@query("lasso_intersects", f"select distinct tri_id from (select tri_id, unnest([{_LASSO_SIDES}], recursive := true) from ({fx.TRIANGLES}) as t) as s where ({_LASSO_CROSS}) % 2 = 1 or {_LASSO_EDGES}")
def lasso_intersects(spark, d):
    return composite.lasso_select(fx.triangles(spark, d), _LASSO, "intersects")


@query("lasso_visible", f"select tri_id from ({_LASSO_CENTRES}) as l where tri_id not in (select ray_id from ({oracles.ray_hits(_LASSO_RAYS, fx.TRIANGLES)}) as h where tri_id <> ray_id and t < 1e0 - 1e-9)")
def lasso_visible(spark, d):
    return composite.lasso_select(fx.triangles(spark, d), _LASSO, "visible", (0.0, 0.0, 10.0))


_LIGHT = (3.0, -2.0, 4.0)
_FIRST_HIT = f"select h.* from (select *, row_number() over (partition by ray_id order by distance, tri_id) as nr from ({oracles.ray_hits(_ASIDE_RAYS, fx.TRIANGLES)}) as a) as h where nr = 1"
_MET = nested_sql(f"select h.ray_id, h.tri_id, h.t, r.ox, r.oy, r.oz, r.dx, r.dy, r.dz, t.ax, t.ay, t.az, t.vbx, t.vby, t.vbz, t.cx, t.cy, t.cz from ({_FIRST_HIT}) as h join ({_ASIDE_RAYS}) as r using (ray_id) join ({fx.TRIANGLES}) as t using (tri_id)", [
    {f"m{c}": e for c, e in zip(AXES, cross(sub(vec("vb"), vec("a")), sub(vec("c"), vec("a"))))} | {f"h{c}": f"o{c} + d{c} * t" for c in AXES},
    {"turn": f"case when {dot(vec('d'), vec('m'))} > 0e0 then -1e0 else 1e0 end / sqrt{dot(vec('m'), vec('m'))}"},
    {f"l{c}": f"cast({x!r} as double) - h{c}" for c, x in zip(AXES, _LIGHT)},
    {"cosine": f"{dot(vec('l'), vec('m'))} * turn", "far2": dot(vec("l"), vec("l"))},
])
_SHADOW_RAYS = f"select ray_id, tri_id as own, hx as ox, hy as oy, hz as oz, lx as dx, ly as dy, lz as dz from ({_MET}) as m"
_SHADOWED = f"select s.ray_id from ({oracles.ray_hits(_SHADOW_RAYS, fx.TRIANGLES, ', own')}) as s where tri_id <> own and t < 1e0"


@query("direct_light", f"select ray_id, 0 as bounce, tri_id, cosine > 0e0 and ray_id not in ({_SHADOWED}) as lit, round(case when cosine > 0e0 and ray_id not in ({_SHADOWED}) then cosine / sqrt(far2) / far2 * 5e-1 else 0e0 end, 6) as shade from ({_MET}) as x")
def direct_light(spark, d):
    """What a point light shows at the first hits of rays: the first step of path tracing."""
    r = fx.rays(spark, d).withColumns({"ox": F.col("ox") + 1e-3, "oy": F.col("oy") - 2e-3})
    return composite.trace_paths(r, fx.triangles(spark, d), _LIGHT).withColumn("shade", F.round("shade", 6))


@query("running_bounds", f"select date_trunc('hour', ts) as window_start, user_id, count(*) as n, min(value) as minx, min(pz) as miny, min(cast(event_id as double)) as minz, max(value) as maxx, max(pz) as maxy, max(cast(event_id as double)) as maxz from (select *, {fx.HOURS_SQL.format(t='ts')} as pz from events) as e group by 1, 2")
def running_bounds(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("ts", "user_id", "value as x", f"{fx.HOURS_SPARK.format(t='ts')} as y", "cast(event_id as double) as z")
    return maintenance.running_bounds(e, "user_id")


def _skinned(spark, d) -> DataFrame:
    """Triangles whose corners are moved by two bones each."""
    t = fx.triangles(spark, d)
    corner = F.explode(F.expr("array(" + ", ".join(f"named_struct('k', {i}, 'x', {p}x, 'y', {p}y, 'z', {p}z)" for i, p in enumerate(("a", "vb", "c"))) + ")"))
    v = t.select(F.lit(0).cast("long").alias("geom_id"), "tri_id", corner.alias("v")).select("geom_id", (F.col("tri_id") * 3 + F.col("v.k")).alias("vid"), "v.x", "v.y", "v.z")
    w = v.select("geom_id", "vid", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("slot")).withColumns({"bone": (F.col("vid") + F.col("slot")) % 3, "weight": F.expr("case slot when 0 then 75e-2 else 25e-2 end")})
    m = ", ".join(f"cast({x} as double)" for x in _matrix_text("id"))
    bones = spark.range(3).selectExpr("id as bone", f"array({m}) as matrix")
    return bake.skin(v, w, bones)


def _posed(vid: str, p: str) -> Vec:
    """A corner moved by the bones of its vertex."""
    own, other = _matrix_text(f"(({vid}) % 3)"), _matrix_text(f"(({vid} + 1) % 3)")
    return affine([f"(75e-2 * {a} + 25e-2 * {b})" for a, b in zip(own, other)], vec(p))


_CORNERS_POSED = {p: _posed(f"(tri_id * 3 + {i})", p) for i, p in enumerate(("a", "vb", "c"))}
_SKINNED = " union all ".join(f"select cast(0 as bigint) as geom_id, tri_id * 3 + {i} as vid, " + ", ".join(f"round({e}, 9) as {c}" for c, e in zip(AXES, _CORNERS_POSED[p])) + f" from ({fx.TRIANGLES}) as t" for i, p in enumerate(("a", "vb", "c")))
_POSED = "select tri_id, " + ", ".join(f"{e} as {p}{c}" for p, v in _CORNERS_POSED.items() for c, e in zip(AXES, v)) + f" from ({fx.TRIANGLES}) as t"


@query("skinning", _SKINNED)
def skinning(spark, d):
    return _skinned(spark, d).select("geom_id", "vid", *(F.round(c, 9).alias(c) for c in AXES))


@query("skinned_raycast", oracles.first(oracles.ray_hits(fx.RAYS, _POSED), "ray_id", "ray_id, tri_id"))
def skinned_raycast(spark, d):
    posed = _skinned(spark, d)
    t = geometry.triangles_from_index(posed, geometry.ensure_index(posed))
    return rays.raycast(fx.rays(spark, d), t, first=True).select("ray_id", "tri_id", F.round("distance", 6).alias("distance"))


_SHORT = "select query_id as seg_id, px as x0, py as y0, pz as z0, px + 1e-1 as x1, py as y1, pz - 1e-1 as z1 from (" + fx.QUERY_POINTS + ") as q"


_LINE_GAP = f"abs({dot(sub(vec('q'), vec('p')), cross(vec('d'), vec('e')))}) / sqrt({dot(cross(vec('d'), vec('e')), cross(vec('d'), vec('e')))})"
_LINES = {t: f"select query_id as {t}_id, " + ", ".join(f"p{c} as {p}{c}" for c in AXES) + ", " + ", ".join(f"{e} as {v}{c}" for c, e in zip(AXES, x)) + f" from ({fx.QUERY_POINTS}) as q" for t, p, v, x in (("a", "p", "d", ("1e0 + px", "2e0", "pz")), ("b", "q", "e", ("py", "-1e0", "5e-1")))}


@query("line_distances", f"select a_id, b_id, round({_LINE_GAP}, 6) as distance from ({_LINES['a']}) as l, ({_LINES['b']}) as r")
def line_distances(spark, d):
    q = fx.query_points(spark, d)
    line = lambda x, y, z: q.selectExpr("query_id as seg_id", "px as x0", "py as y0", "pz as z0", f"px + ({x}) as x1", f"py + ({y}) as y1", f"pz + ({z}) as z1")
    found = pairs.line_distances(line("1e0 + px", "2e0", "pz"), line("py", "-1e0", "5e-1"))
    return found.select("a_id", "b_id", F.round("distance", 6).alias("distance"))


@query("degenerate_triangles", f"select tri_id, case when tri_id % 10 = 0 then 'point' when tri_id % 5 = 0 then 'segment' else 'triangle' end as shape from ({fx.TRIANGLES}) as t")
def degenerate_triangles(spark, d):
    """Of triangles some of which were folded onto a corner or an edge."""
    folded = {f"vb{c}": F.expr(f"case when tri_id % 5 = 0 then a{c} else vb{c} end") for c in AXES} | {f"c{c}": F.expr(f"case when tri_id % 10 = 0 then a{c} else c{c} end") for c in AXES}
    return pairs.degenerate_triangles(fx.triangles(spark, d).withColumns(folded))


@query("segment_triangle_distance", oracles.segment_distances(_SHORT, fx.TRIANGLES, "5e-2"))
def segment_triangle_distance(spark, d):
    s = fx.query_points(spark, d).selectExpr("query_id as seg_id", "px as x0", "py as y0", "pz as z0", "px + 1e-1 as x1", "py as y1", "pz - 1e-1 as z1")
    return pairs.segment_distances(s, fx.triangles(spark, d), 0.05).withColumn("distance", F.round("distance", 6))


_OTHERS = "select i as other_id, i * 1e5 as minx, 0e0 as miny, 0e0 as minz, i * 1e5 + 5e4 as maxx, 1e3 as maxy, 3e0 as maxz from (select unnest(range(2)) as i) as r"


@query("obb_aabb_distance", oracles.obb_aabb(f"select object_id as box_id, {', '.join(BOX)} from ({fx.OBJECTS}) as o", _OTHERS, oracles.untold(_TURN), _TURN))
def obb_aabb_distance(spark, d):
    b = fx.objects(spark, d).selectExpr("object_id as box_id", *BOX).withColumn("inverse", F.array(*(F.lit(float(x)) for x in _TURN)))
    other = spark.range(2).selectExpr("id as other_id", "id * 1e5 as minx", "0e0 as miny", "0e0 as minz", "id * 1e5 + 5e4 as maxx", "1e3 as maxy", "3e0 as maxz")
    return pairs.oriented_box_distances(b, other).withColumn("distance", F.round("distance", 6))


#: An inverse projection whose w depends on x, y and the depth, and a placement.
_UNPROJECT = [0.8, 0.1, 0.0, 0.15, 0.0, 0.7, 0.05, -0.1, 0.0, 0.0, 0.2, 0.45, 0.05, 0.0, -1.0, 0.6]
_STAND = [0.8, 0.6, 0.0, 0.0, -0.6, 0.8, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 3.0, -2.0, 5.0, 1.0]


def _unprojected(z: str, to: str) -> list[dict[str, str]]:
    """Clip space point (x, y, z) as rows of matrix times column, divided by the fourth, then placed."""
    row = lambda m, r, v: " + ".join(f"{m[4 * i + r]!r}::double * {c}" for i, c in enumerate(v))
    flat = {f"{to}{r}": row(_UNPROJECT, r, ("x", "y", z, "1e0")) for r in range(4)}
    return [flat, {f"{to}{'xyz'[r]}": row(_STAND, r, (f"{to}0 / {to}3", f"{to}1 / {to}3", f"{to}2 / {to}3", "1e0")) for r in range(3)}]


@query("camera_rays", "select ray_id, " + ", ".join(f"round(o{c}, 9) as o{c}, round(f{c} - o{c}, 9) as d{c}" for c in AXES) + " from (" + nested_sql("select vec_id as ray_id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings", _unprojected("-1e0", "o") + _unprojected("1e0", "f")) + ") as p")
def camera_rays(spark, d):
    """Rays through a perspective view: the division by w is not by one number."""
    p = spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id as ray_id", "cast(embedding[0] as double) as x", "cast(embedding[1] as double) as y")
    return rays.camera_rays(p, _UNPROJECT, _STAND).select("ray_id", *(F.round(c, 9).alias(c) for c in rays.RAY))


@query("refit_hinted", _refitted("box_id = 0", "25e1"))
def refit_hinted(spark, d):
    """Just the leaf of one moved box and its ancestors are computed; no other node changes."""
    nodes, order, b = _index(spark, d)
    moved = b.withColumns({x: F.expr(f"{x} + case when box_id = 0 then 25e1 else 0e0 end") for x in BOX})
    slot = order.where("box_id = 0").select(F.col("root_id").alias("r"), "slot")
    dirty = nodes.where("is_leaf").join(slot, (F.col("root_id") == F.col("r")) & (F.col("slot") >= F.col("offset")) & (F.col("slot") < F.col("offset") + F.col("count")), "left_semi")
    return index.refit(nodes, order, moved, dirty.select("root_id", "node_id")).select("root_id", "node_id", *BOX)


@query("batched_build", oracles.tree(f"select cast(b.box_id % 3 as int) as root_id, * from ({fx.AABBS}) as b", "select root_id, node_id, depth, is_leaf, count from node", 4))
def batched_build(spark, d):
    """One hierarchy for each geometry of a batch, with leaves of four."""
    b = fx.aabbs(spark, d).withColumn("geom_id", F.col("box_id") % 3)
    return index.build_nodes(b, "geom_id", leaf_size=4)[0].select("root_id", "node_id", "depth", "is_leaf", "count")


@query("packed_nodes", oracles.tree(_ROOTED, "select n.root_id, n.node_id, coalesce((select r.node_id from node as r where r.root_id = n.root_id and r.path = n.path || 'R'), -1) as right_id, n.is_leaf, case when n.is_leaf then n.count end as count, true as covers, (select count(*) * 32 from node as k where k.root_id = n.root_id) as bytes from node as n"))
def packed_nodes(spark, d):
    """Nodes packed to 32 bytes each and read back; single-precision bounds must hold the exact ones."""
    nodes = _index(spark, d)[0]
    packed = index.pack(nodes)
    exactly = nodes.select("root_id", "node_id", *(F.col(x).alias(f"e_{x}") for x in BOX))
    back = index.unpack(packed).join(exactly, ["root_id", "node_id"]).join(packed.select("root_id", F.octet_length("packed").cast("long").alias("bytes")), "root_id")
    return back.select("root_id", "node_id", "right_id", "is_leaf", "count", F.expr(bounds.contains_box("", "e_")).alias("covers"), "bytes")


@query("attribute_texture", f"select i as texel, i % s as x, i // s as y, r, g, b, 1e0 as a from (select query_id as i, px as r, py as g, pz as b, cast(ceil(sqrt(count(*) over ())) as bigint) as s from ({fx.QUERY_POINTS}) as q) as t")
def attribute_texture(spark, d):
    """Points as texels, filled up to four channels."""
    return textures.attribute_texels(fx.query_points(spark, d), "query_id", ["px", "py", "pz"])


_ONE_ROOT = f"select cast(0 as int) as root_id, * from ({fx.AABBS}) as b"


def _one_index(spark, d):
    return index.build_nodes(fx.aabbs(spark, d).withColumn("root_id", F.lit(0)))


_RIGHT = "coalesce((select r.node_id from node as r where r.path = n.path || 'R') - n.node_id, 0)"
_OFFSET = "(select count(*) from member as m join node as k on m.path = k.path where k.is_leaf and k.node_id < n.node_id)"


@query("hierarchy_texture", oracles.tree(_ONE_ROOT, f"select node_id as texel, node_id % s as x, node_id // s as y, case when is_leaf then 4294901760 | count else null end as r, case when is_leaf then {_OFFSET} else {_RIGHT} end as g from node as n, (select cast(ceil(sqrt(count(*))) as bigint) as s from node) as k"))
def hierarchy_texture(spark, d):
    """Contents of a hierarchy's nodes as texels; split axes are those of build_nodes and left out here."""
    contents = textures.hierarchy_texels(_one_index(spark, d)[0])[1]
    return contents.withColumn("r", F.when(F.col("r") > 2, F.col("r")))


@query("hierarchy_bounds_texture", oracles.tree(_ONE_ROOT, "select node_id * 2 + k as texel, (node_id * 2 + k) % s as x, (node_id * 2 + k) // s as y, " + ", ".join(f"case k when 0 then min{c} else max{c} end as {t}" for c, t in zip(AXES, "rgb")) + " from node, (select unnest([0, 1]) as k) as e, (select cast(2 * ceil(sqrt(count(*) / 2)) as bigint) as s from node) as w"))
def hierarchy_bounds_texture(spark, d):
    return textures.hierarchy_texels(_one_index(spark, d)[0])[0]


@query("dereferenced_index", oracles.tree(_ONE_ROOT, "select cast(0 as int) as root_id, (nr - 1) * 3 + k as place, box_id * 3 + k as vid from (select m.box_id, row_number() over (order by m.path, m.box_id) as nr from member as m join node as n on m.path = n.path where n.is_leaf) as o, (select unnest([0, 1, 2]) as k) as c"))
def dereferenced_index(spark, d):
    corners_ = fx.triangles(spark, d).select(F.explode(F.array(*(F.col("tri_id") * 3 + k for k in range(3)))).alias("slot"))
    return textures.dereferenced(corners_.withColumn("vid", F.col("slot")), _one_index(spark, d)[1])


@query("subtree_spans", oracles.tree(_ROOTED, "select n.root_id, n.node_id, count(*) as n_nodes, cast(max(k.depth) - n.depth as int) as levels from node as n join node as k on k.root_id = n.root_id and starts_with(k.path, n.path) group by n.root_id, n.node_id, n.depth"))
def subtree_spans(spark, d):
    return textures.subtree_spans(_index(spark, d)[0])


_TWO_LEVELS = f"select cast(-1 as int) as root_id, row_number() over (order by object_id, instance_id) - 1 as box_id, {', '.join(BOX)} from ({_WORLD_BOX}) as w join (select object_id, instance_id, visible from ({_INST}) as i) as v using (object_id, instance_id) where visible union all select cast(geom_id as int) as root_id, tri_id as box_id, " + ", ".join(f"{g}(a{c}, vb{c}, c{c}) as {f}{c}" for f, g in (("min", "least"), ("max", "greatest")) for c in AXES) + f" from ({_GEOM_TRIS}) as t"


@query("scene_index", oracles.tree(_TWO_LEVELS, f"select root_id, node_id, depth, is_leaf, count, {', '.join(BOX)} from node", 4))
def scene_index(spark, d):
    """A hierarchy over instances and one for each geometry."""
    return scene.scene_index(_instances(spark), _geometry_tris(spark, d), leaf_size=4)[0].select("root_id", "node_id", "depth", "is_leaf", "count", *BOX)


@query("index_round_trip", oracles.tree(_ROOTED, "select v as version, n.root_id, n.node_id, coalesce((select r.node_id from node as r where r.root_id = n.root_id and r.path = n.path || 'R'), -1) as right_id, n.count from node as n, (select unnest([0, 1]) as v) as k"))
def index_round_trip(spark, d):
    """Nodes as read from files of the old and of the present version."""
    nodes, order, _ = _index(spark, d)
    path = durable.fresh(spark, "index")
    geometry.write_index(nodes, order, f"{path}/1")
    nodes.write.parquet(f"{path}/0/nodes")
    order.write.parquet(f"{path}/0/order")
    both = [geometry.read_index(spark, f"{path}/{v}")[0].withColumn("version", F.lit(v)) for v in (0, 1)]
    return both[0].unionByName(both[1]).select("version", "root_id", "node_id", "right_id", "count")


_ENTERED = "select root_id, node_id, depth, count from node as n where not exists (select 1 from node as p where p.root_id = n.root_id and p.path <> n.path and starts_with(n.path, p.path) and not p.maxx > 5e-1)"


@query("tree_traverse_pruned", oracles.tree(_ROOTED, _ENTERED))
def tree_traverse_pruned(spark, d):
    return index.traverse(_index(spark, d)[0], enter=F.col("maxx") > 0.5).select("root_id", "node_id", "depth", "count")


@query("tree_traverse", oracles.tree(_ROOTED, "select root_id, node_id, depth, count from node where depth <= 3"))
def tree_traverse(spark, d):
    return index.traverse(_index(spark, d)[0], 3).select("root_id", "node_id", "depth", "count")


@query("memory_estimate", oracles.tree(_ROOTED, "select root_id, count(*) * 32 as bytes from node group by root_id"))
def memory_estimate(spark, d):
    return index.memory_estimate(_index(spark, d)[0])
