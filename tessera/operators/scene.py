"""Scenes: hierarchies of objects, instances, transforms, and queries over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import bounds
from ..functions.staged import apply, matching
from ..functions.vectors import AXES, affine, vec
from ..plans import ordered
from ..plans import strategy as plan
from ..plans.durable import cut
from ..plans.tree import build
from .rays import RAY, TILE_ROWS, TRIANGLE, by_slices, cast, columns, corners, first_hits, ray_box_pairs, raycast_points, raycast_segments, tiled
from .index import build_nodes
from .regions import BOX, NOT_INTERSECTED, _inverted, boxed, frustum_state

MATRIX = [f"matrix[{i}]" for i in range(16)]
#: Rays that one task takes to a geometry, or to a tile of one.
GEOMETRY_RAYS = 20_000


def collect_objects(scene: DataFrame, roots: DataFrame, kinds: tuple[str, ...] = ("mesh", "line", "points")) -> DataFrame:
    """Distinct ids below the roots (id) with one of the kinds, over scene (parent_id, id, kind), however deep.

    One join per level, whose result is stored; the loop ends with the first
    level that has nothing new, so an object below itself does no harm.
    """
    level = cut(roots.select("id").distinct())
    found, turn = level, 0
    while True:
        level = cut(scene.join(level.withColumnRenamed("id", "parent_id"), "parent_id").select("id").distinct().join(found, "id", "left_anti"))
        if level.isEmpty():
            break
        found, turn = found.unionAll(level), turn + 1
        if turn % 16 == 0:  # else the plan grows with the depth
            found = cut(found)
    return scene.where(F.col("kind").isin(*kinds)).join(found, "id", "left_semi").select("id").distinct()


def visible_objects(scene: DataFrame) -> DataFrame:
    """(id, seen) of scene (parent_id, id, visible): whether an object and all above it are visible, level by level from those without a parent."""
    level = cut(scene.where("parent_id is null").select("id", F.col("visible").alias("seen")))
    found, turn = level, 0
    while not level.isEmpty():
        above = level.select(F.col("id").alias("parent_id"), "seen")
        level = cut(scene.join(above, "parent_id").select("id", (F.col("visible") & F.col("seen")).alias("seen")).join(found.select("id"), "id", "left_anti"))
        found, turn = found.unionAll(level), turn + 1
        if turn % 16 == 0:
            found = cut(found)
    return found


def update_transforms(instances: DataFrame, seen: DataFrame, matrices: DataFrame) -> DataFrame:
    """instances with the matrices (object_id, instance_id, matrix) that have changed, visible where they and their object (id, seen) are; their bounds follow by instance_bounds, those of an index by refit."""
    new = matrices.select("object_id", "instance_id", F.col("matrix").alias("new_matrix"))
    joined = instances.join(new, ["object_id", "instance_id"], "left").join(seen.withColumnRenamed("id", "object_id"), "object_id", "left")
    out = joined.withColumns({"matrix": F.coalesce("new_matrix", "matrix"), "visible": F.col("visible") & F.coalesce("seen", F.lit(True))})
    return out.select(*instances.columns)


def instance_bounds(instances: DataFrame, geometry: DataFrame) -> DataFrame:
    """(object_id, instance_id, minx..maxz): bounds of the eight transformed corners of each instance's geometry box.

    instances: object_id, instance_id, geom_id, matrix (16, column-major); geometry: geom_id, minx..maxz.
    A geometry that also has a bounding sphere (sx, sy, sz, radius) shrinks the
    bounds to those of the moved sphere, whose radius grows with the largest scale.
    """
    sphere = ["sx", "sy", "sz", "radius"]
    joined = instances.join(geometry.select("geom_id", *BOX, *(c for c in sphere if c in geometry.columns)), "geom_id")
    if set(sphere) <= set(geometry.columns):
        largest = "greatest(" + ", ".join(f"sqrt({' + '.join(f'{MATRIX[4 * j + r]} * {MATRIX[4 * j + r]}' for r in range(3))})" for j in range(3)) + ")"
        moved = dict(zip(("ux", "uy", "uz"), affine(MATRIX, ("sx", "sy", "sz")))) | {"reach": f"radius * {largest}"}
        corner = [affine(MATRIX, tuple(f"{'max' if (k >> i) & 1 else 'min'}{c}" for i, c in enumerate(AXES))) for k in range(8)]
        shrunk = {f"v{f}{c}": f"{g}(w{f}{c}, u{c} {s} reach)" for f, g, s in (("min", "greatest", "-"), ("max", "least", "+")) for c in AXES}
        out = apply(joined, [bounds.of_points(corner, "w") | moved, shrunk])
        return out.select("object_id", "instance_id", *(F.col(f"v{x}").alias(x) for x in BOX))
    corner = [affine(MATRIX, tuple(f"{'max' if (k >> i) & 1 else 'min'}{c}" for i, c in enumerate(AXES))) for k in range(8)]
    out = apply(joined, [bounds.of_points(corner, "w")])
    return out.select("object_id", "instance_id", *(F.col(f"w{x}").alias(x) for x in BOX))


def precise_bounds(instances: DataFrame, vertices: DataFrame) -> DataFrame:
    """The same from all transformed vertices (geom_id, x, y, z)."""
    moved = apply(instances.join(vertices, "geom_id"), [dict(zip(("wx", "wy", "wz"), affine(MATRIX, ("x", "y", "z"))))])
    return moved.groupBy("object_id", "instance_id").agg(*(f(f"w{c}").alias(f"{n}{c}") for n, f in (("min", F.min), ("max", F.max)) for c in AXES))


def frustum_cull(objects: DataFrame, planes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Visible rows of objects: those not wholly behind a plane."""
    return frustum_state(objects, planes).where(F.col("state") != NOT_INTERSECTED)


def raycast_scene(rays: DataFrame, instances: DataFrame, tris: DataFrame, side: str = "double", first: str | None = None, near: float | None = None, far: float | None = None) -> DataFrame:
    """World-space hits (ray_id, object_id, instance_id, tri_id, distance, px..pz) over visible instances.

    Two joins: rays with the bounds of instances, then, in the frame of each
    instance met, with its triangles. Distances are those in world space.
    first: None for all hits, 'instance' for the nearest of each instance,
    'scene' for the nearest of all; ties go to the smallest ids.
    """
    seen = instances.where("visible")
    geometry = apply(tris.select("geom_id", *TRIANGLE), [bounds.of_points([vec("a"), vec("vb"), vec("c")])]).groupBy("geom_id").agg(*(F.expr(x).alias(n) for n, x in bounds.union_of().items()))
    boxes = instance_bounds(seen, geometry)
    met = ray_box_pairs(rays, boxes, ["object_id", "instance_id"])
    local = met.join(seen.select("object_id", "instance_id", "geom_id", "matrix", _inverted(F.col("matrix")).alias("inverse")), ["object_id", "instance_id"])
    m = [f"inverse[{i}]" for i in range(16)]
    moved = dict(zip([f"l{x}" for x in RAY], affine(m, vec("o")) + affine(m, vec("d"), "0e0")))
    # Local rays take the names of rays; the world ones are kept as wox..wdz.
    local = apply(local, [moved]).select("ray_id", "object_id", "instance_id", "geom_id", *(F.col(x).alias(f"w{x}") for x in RAY), *(F.col(f"l{x}").alias(x) for x in RAY))
    hits = _local_hits(local, tris, side, first is not None and near is None and far is None)
    world = apply(hits, [dict(zip(("gx", "gy", "gz"), (f"(wo{c} + wd{c} * t)" for c in AXES))), {"gap": "sqrt((gx - wox) * (gx - wox) + (gy - woy) * (gy - woy) + (gz - woz) * (gz - woz))"}])
    out = world.select("ray_id", "object_id", "instance_id", "tri_id", F.col("gap").alias("distance"), F.col("gx").alias("px"), F.col("gy").alias("py"), F.col("gz").alias("pz"))
    if near is not None:
        out = out.where(F.col("distance") >= near)
    if far is not None:
        out = out.where(F.col("distance") <= far)
    if first is None:
        return out
    keys = ["ray_id"] if first == "scene" else ["ray_id", "object_id", "instance_id"]
    rest = [c for c in ("object_id", "instance_id", "tri_id", "px", "py", "pz") if c not in keys]
    return out.groupBy(*keys).agg(F.min(F.struct("distance", *rest)).alias("m")).select(*keys, "m.*").select(out.columns)


def _local_hits(local: DataFrame, tris: DataFrame, side: str, first: bool, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Rays in the frames of instances against their geometries: one hierarchy per geometry and part.

    A geometry that many rays reach goes to several tasks, each with a part of
    the rays. One of more than `tile_rows` triangles is cut into tiles in its
    own frame, and rays go to those of its tiles whose bounds they meet.
    """
    keep = ["ray_id", "object_id", "instance_id", *(f"w{x}" for x in RAY)]
    tris = tris.select("geom_id", "tri_id", *TRIANGLE)
    if (tris.groupBy("geom_id").count().agg(F.max("count")).first()[0] or 0) > tile_rows:
        held, _ = tiled(tris, tile_rows)
        # Bounds are widened by more than rounding, so that no hit on a tile's face is lost.
        wide = {x: F.expr(f"{x} {'-' if x.startswith('min') else '+'} 1e-9 * (1e0 + abs({x}))") for x in BOX}
        boxes = cut(held.groupBy("geom_id", "tile").agg(*(F.expr(e).alias(n) for n, e in bounds.union_of().items())).withColumns(wide))
        local = matching(local.join(boxes, "geom_id"), bounds.ray_interval("", vec("o"), vec("d")), bounds.ray_hits())
        tris = held.select("geom_id", "tri_id", "tile", *TRIANGLE)
    else:
        local, tris = local.withColumn("tile", F.lit(0)), tris.withColumn("tile", F.lit(0))
    key = ["geom_id", "tile"]
    left, right = plan.dealt(local.select(*key, *keep, *RAY), tris, key, GEOMETRY_RAYS)
    kinds = dict(left.dtypes)
    ddl = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", tri_id long, t double"

    def run(rays: pa.Table, mesh: pa.Table) -> Iterator[pa.RecordBatch]:
        tri, ids = columns(mesh, TRIANGLE), mesh.column("tri_id").to_numpy()
        a, b, c = corners(tri)
        tree = build(np.minimum(np.minimum(a, b), c), np.maximum(np.maximum(a, b), c))

        def hits(some: pa.Table) -> pa.RecordBatch:
            at, hit, t, *_ = cast(tree, ids, tri, np.arange(some.num_rows), columns(some, RAY), side, first, None)
            told = some.select(keep).combine_chunks().take(pa.array(at, pa.int64())).combine_chunks()
            return pa.RecordBatch.from_arrays([*(x.chunk(0) if x.num_chunks else pa.array([], x.type) for x in told.columns), pa.array(hit, pa.int64()), pa.array(t, pa.float64())], names=[*keep, "tri_id", "t"])

        yield from by_slices(rays, hits)

    return plan.streamed(left, right, [*key, "part"], run, ddl)


def raycast_object(rays: DataFrame, tris: DataFrame, matrix: list[float], side: str = "double", first: bool = False, near: float | None = None, far: float | None = None) -> DataFrame:
    """World-space hits (ray_id, tri_id, distance, px..pz) on one object placed by a matrix, with near <= distance <= far in the world."""
    spark = rays.sparkSession
    one = spark.createDataFrame([(0, 0, 0, [float(x) for x in matrix], True)], "object_id long, instance_id int, geom_id long, matrix array<double>, visible boolean")
    found = raycast_scene(rays, one, tris.withColumn("geom_id", F.lit(0).cast("long")), side, "scene" if first else None, near, far)
    return found.drop("object_id", "instance_id")


IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def raycast_any(rays: DataFrame, primitives: DataFrame, matrix: list[float] | None = None, threshold: float = 1.0, side: str = "double", first: bool = False, near: float | None = None, far: float | None = None) -> DataFrame:
    """(ray_id, prim_id, distance) on triangles, points or segments, told by their columns, of an object placed by a matrix if given. Triangles have no threshold, the others no side."""
    placed = matrix or IDENTITY
    if set(TRIANGLE) <= set(primitives.columns):
        found, prim = raycast_object(rays, primitives, placed, side, first, near, far), "tri_id"
    elif {"x0", "x1"} <= set(primitives.columns):
        found, prim = raycast_object_segments(rays, primitives, placed, threshold, first, near, far), "seg_id"
    elif set(vec("p")) <= set(primitives.columns):
        found, prim = raycast_object_points(rays, primitives, placed, threshold, first, near, far), "point_id"
    else:
        raise ValueError("neither triangles nor segments nor points")
    return found.select("ray_id", F.col(prim).alias("prim_id"), "distance")


#: Root of the hierarchy over a scene's instances, beside those of its geometries.
TOP = -1


def scene_index(instances: DataFrame, tris: DataFrame, strategy: str = "center", leaf_size: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, order, placed): a two-level index, a hierarchy over the bounds of visible instances (root TOP) and one for each geometry they use (root geom_id).

    placed: box_id, object_id, instance_id, geom_id of the boxes of TOP. A
    geometry that many instances share has one hierarchy.
    """
    seen = instances.where("visible")
    used = boxed(tris.join(seen.select("geom_id").distinct(), "geom_id", "left_semi"))
    geometry = used.groupBy("geom_id").agg(*(F.expr(x).alias(n) for n, x in bounds.union_of().items()))
    top = ordered.numbered(instance_bounds(seen, geometry).withColumn("scene", F.lit(0)), "scene", ["object_id", "instance_id"], "box_id").withColumn("box_id", F.col("box_id").cast("long"))
    boxes = top.select(F.lit(TOP).alias("root_id"), "box_id", *BOX).unionAll(used.select(F.col("geom_id").cast("int").alias("root_id"), F.col("tri_id").alias("box_id"), *BOX))
    placed = top.select("box_id", "object_id", "instance_id").join(seen.select("object_id", "instance_id", "geom_id"), ["object_id", "instance_id"])
    return *build_nodes(boxes, strategy=strategy, leaf_size=leaf_size), placed


def _placed(rays: DataFrame, matrix: list[float]) -> tuple[DataFrame, float]:
    """Rays in the frame of an object placed by a matrix, and the mean of its three scales."""
    m = np.array(matrix, float).reshape(4, 4).T
    inverse = [f"cast({float(x)!r} as double)" for x in np.linalg.inv(m).T.ravel()]
    moved = dict(zip([f"l{x}" for x in RAY], affine(inverse, vec("o")) + affine(inverse, vec("d"), "0e0")))
    return apply(rays, [moved]).select("ray_id", *(F.col(f"l{x}").alias(x) for x in RAY)), float(np.sqrt((m[:3, :3] ** 2).sum(0)).mean())


def _world(hits: DataFrame, rays: DataFrame, near: float | None, far: float | None, first: bool, prim: str) -> DataFrame:
    """Distances along the world's rays: a ray's t is the same in any frame."""
    length = rays.select("ray_id", F.expr("sqrt(dx * dx + dy * dy + dz * dz)").alias("length"))
    out = hits.join(length, "ray_id").withColumn("distance", F.col("t") * F.col("length")).drop("length")
    out = out if near is None else out.where(F.col("distance") >= near)
    out = out if far is None else out.where(F.col("distance") <= far)
    return first_hits(out, prim=prim) if first else out


def raycast_object_points(rays: DataFrame, points: DataFrame, matrix: list[float], threshold: float, first: bool = False, near: float | None = None, far: float | None = None) -> DataFrame:
    """World-space hits (ray_id, point_id, t, distance) on the points of an object placed by a matrix.

    The threshold is of the world: in the object's frame it is divided by the mean of the object's scales.
    """
    local, scale = _placed(rays, matrix)
    return _world(raycast_points(local, points, threshold / scale), rays, near, far, first, "point_id")


def raycast_object_segments(rays: DataFrame, segments: DataFrame, matrix: list[float], threshold: float, first: bool = False, near: float | None = None, far: float | None = None) -> DataFrame:
    """World-space hits (ray_id, seg_id, t, s, distance) on the segments of an object placed by a matrix; the threshold as for points."""
    local, scale = _placed(rays, matrix)
    return _world(raycast_segments(local, segments, threshold / scale), rays, near, far, first, "seg_id")


__all__ = ["raycast_object_points", "raycast_object_segments", "collect_objects", "first_hits", "frustum_cull", "instance_bounds", "precise_bounds", "raycast_object", "raycast_scene"]
