"""Region queries and existence joins. `intersects_*` test surfaces: a shape wholly inside a closed mesh meets nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import bounds, exact, kernels
from ..functions.staged import apply, matching
from ..functions.vectors import AXES, affine, vec
from ..plans import strategy as plan
from . import boxes as boxes_
from .rays import TRIANGLE, columns, corners

NOT_INTERSECTED, INTERSECTED, CONTAINED = 0, 1, 2
BOX = [f"{f}{c}" for f in ("min", "max") for c in AXES]


def boxed(tris: DataFrame, prefix: str = "") -> DataFrame:
    """Triangles with their bounds."""
    return apply(tris, [bounds.of_points([vec("a"), vec("vb"), vec("c")], prefix)])


def candidates(shapes: DataFrame, tris: DataFrame, shape_box: dict[str, str], test: boxes_.Test, ddl: str, names: list[str], strategy: str = "auto", some: str | None = None) -> DataFrame:
    """Rows of `ddl` that test makes of pairs (batches of the named columns) of shapes and triangles whose boxes overlap; shape_box gives a_minx.. as expressions."""
    return boxes_.tested(apply(shapes, [shape_box]), boxed(tris, "b_"), test, ddl, names, strategy, some=some)


def sphere_hits(spheres: DataFrame, tris: DataFrame, strategy: str = "auto", some: bool = False) -> DataFrame:
    """(sphere_id, tri_id, d2) of spheres (sphere_id, px..pz, r) and the triangles they touch; `some`: one at least of each sphere."""
    around = {f"a_{n}{c}": f"p{c} {s} r" for n, s in (("min", "-"), ("max", "+")) for c in AXES}
    return candidates(spheres.select("sphere_id", *vec("p"), "r"), tris.select("tri_id", *TRIANGLE), around, _touch, _TOUCH, ["sphere_id", "tri_id", *vec("p"), "r", *TRIANGLE], strategy, "sphere_id" if some else None)


_TOUCH = "sphere_id long, tri_id long, d2 double"


def _touch(batch: pa.RecordBatch) -> pa.RecordBatch:
    p = columns(batch, list(vec("p")))
    gap = p - kernels.closest_on_triangle(p, *corners(columns(batch, TRIANGLE)))
    d2, r = kernels.dot(gap, gap), batch.column("r").to_numpy()
    return pa.RecordBatch.from_arrays([batch.column("sphere_id"), batch.column("tri_id"), pa.array(d2)], names=["sphere_id", "tri_id", "d2"]).filter(pa.array(d2 <= r * r))


def box_hits(boxes: DataFrame, tris: DataFrame, strategy: str = "auto", some: bool = False) -> DataFrame:
    """(box_id, tri_id) of axis-aligned boxes (box_id, minx..maxz) and the triangles they touch; `some`: one at least of each box."""
    same = {f"a_{x}": x for x in BOX}

    def test(batch: pa.RecordBatch) -> pa.RecordBatch:
        box = columns(batch, BOX)
        hit = kernels.aligned_box_triangle(box[:, :3], box[:, 3:], corners(columns(batch, TRIANGLE)))
        return pa.RecordBatch.from_arrays([batch.column("box_id"), batch.column("tri_id")], names=["box_id", "tri_id"]).filter(pa.array(hit))

    return candidates(boxes.select("box_id", *BOX), tris.select("tri_id", *TRIANGLE), same, test, "box_id long, tri_id long", ["box_id", "tri_id", *BOX, *TRIANGLE], strategy, "box_id" if some else None)


def placed_box(matrix: str, prefix: str, wider: str | None = None) -> list[dict[str, str]]:
    """Steps: bounds (prefix_minx..) of the box minx..maxz moved by a matrix column; widened by an expression of {}, the bound."""
    m = [f"{prefix}w{i}" for i in range(16)]
    corners_ = [tuple(f"{prefix}k{k}{c}" for c in AXES) for k in range(8)]
    moved = {n: e for k, names in enumerate(corners_) for n, e in zip(names, affine(m, tuple(f"{'max' if (k >> i) & 1 else 'min'}{c}" for i, c in enumerate(AXES))))}
    box = bounds.of_points(corners_, prefix)
    if wider:
        box = {n: f"{e} {'-' if n.startswith(f'{prefix}min') else '+'} {wider.format(e)}" for n, e in box.items()}
    return [{x: f"{matrix}[{i}]" for i, x in enumerate(m)}, moved, box]


def in_world(boxes: DataFrame, prefix: str, reach: float = 0.0) -> DataFrame:
    """(box_id, minx..maxz, inverse, world, prefix_minx..): boxes with the inverse of `inverse`, and the bounds, wider by reach, of what it makes of them; null where either is not known.

    Computed in batches: as expressions these are so long that the optimizer alone, which copies them into each condition that reads a bound, takes the driver's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            world = _inverse(batch.column("inverse"))
            known = world.is_valid().to_numpy(zero_copy_only=False) & np.all([batch.column(x).is_valid().to_numpy(zero_copy_only=False) for x in BOX], 0)
            m, box = np.full((batch.num_rows, 16), np.nan), columns(batch, BOX)
            m[world.is_valid().to_numpy(zero_copy_only=False)] = _matrices(world.drop_null())
            corners_ = [[box[:, 3 * (k >> i & 1) + i] for i in range(3)] for k in range(8)]
            at = [[m[:, r] * x + m[:, 4 + r] * y + m[:, 8 + r] * z + m[:, 12 + r] for x, y, z in corners_] for r in range(3)]
            # NaN is greater than any number, as it is in SQL.
            ends = [np.fmin.reduce(v) - reach for v in at] + [np.maximum.reduce(v) + reach for v in at]
            yield pa.RecordBatch.from_arrays([*batch.columns, world, *(pa.array(v, mask=~known) for v in ends)], names=[*batch.schema.names, "world", *(f"{prefix}{x}" for x in BOX)])

    ddl = "box_id long, " + "".join(f"{x} double, " for x in BOX) + "inverse array<double>, world array<double>" + "".join(f", {prefix}{x} double" for x in BOX)
    typed = boxes.select(F.col("box_id").cast("long").alias("box_id"), *(F.col(x).cast("double").alias(x) for x in BOX), F.col("inverse").cast("array<double>").alias("inverse"))
    return typed.mapInArrow(run, ddl)


def oriented_box_hits(boxes: DataFrame, tris: DataFrame) -> DataFrame:
    """(box_id, tri_id) of boxes (box_id, minx..maxz, inverse: array of 16, world to local) and triangles, by a kernel on box candidates."""

    def test(batch: pa.RecordBatch) -> pa.RecordBatch:
        box = columns(batch, BOX)
        hit = kernels.box_triangle(_matrices(batch.column("inverse")), box[:, :3], box[:, 3:], corners(columns(batch, TRIANGLE)))
        return pa.RecordBatch.from_arrays([batch.column("box_id"), batch.column("tri_id")], names=["box_id", "tri_id"]).filter(pa.array(hit))

    left = in_world(boxes, "a_").drop("world")
    return boxes_.tested(left, boxed(tris.select("tri_id", *TRIANGLE), "b_"), test, "box_id long, tri_id long", ["box_id", "tri_id", "inverse", *BOX, *TRIANGLE])


def _matrices(of: pa.Array) -> np.ndarray:
    """n x 16; a null element is NaN."""
    return of.flatten().to_numpy(zero_copy_only=False).reshape(-1, 16)


def _inverse(matrices: pa.Array) -> pa.Array:
    """Inverses of affine column-major matrices; null for a singular one."""
    flat = matrices.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4, 4)
    known = np.flatnonzero(matrices.is_valid().to_numpy(zero_copy_only=False))
    regular = np.linalg.det(flat[:, :3, :3]) != 0
    out = np.full((len(matrices), 16), np.nan)
    out[known[regular]] = np.linalg.inv(flat[regular]).reshape(-1, 16)  # rows and columns are swapped before and after
    null = np.ones(len(matrices), bool)
    null[known[regular]] = False
    ends = np.arange(len(matrices) + 1, dtype=np.int32) * 16
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()), mask=pa.array(null))


@arrow_udf(ArrayType(DoubleType()))
def _inverted(matrices: pa.Array) -> pa.Array:
    """The same as an expression would be too long to be compiled where each element is used."""
    return _inverse(matrices)


def exists(shapes: DataFrame, hits: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name: whether the shape has a hit), for every shape."""
    found = hits.select(F.col(key).alias("_hit")).distinct()
    return shapes.select(key).join(found, F.col(key) == F.col("_hit"), "left").select(key, F.col("_hit").isNotNull().alias(name))


def intersects_sphere(spheres: DataFrame, tris: DataFrame, strategy: str = "auto") -> DataFrame:
    return exists(spheres, sphere_hits(spheres, tris, strategy, True), "sphere_id", "intersects")


def intersects_box(boxes: DataFrame, tris: DataFrame, strategy: str = "auto") -> DataFrame:
    return exists(boxes, box_hits(boxes, tris, strategy, True), "box_id", "intersects")


def classify_boxes(boxes: DataFrame, spheres: DataFrame) -> DataFrame:
    """(sphere_id, box_id, state) for overlapping pairs: INTERSECTED, or CONTAINED if the whole box lies in the sphere."""
    pairs = plan.cross_small(spheres.select("sphere_id", *vec("p"), "r"), boxes.select("box_id", *BOX))
    if pairs is None:
        around = {f"a_{n}{c}": f"p{c} {s} r" for n, s in (("min", "-"), ("max", "+")) for c in AXES}
        left, right = apply(spheres.select("sphere_id", *vec("p"), "r"), [around]), apply(boxes.select("box_id", *BOX), [{f"b_{x}": x for x in BOX}])
        pairs = boxes_.join(left, right, ["sphere_id", *vec("p"), "r", "box_id", *BOX], "tiles")
    far2 = " + ".join(f"greatest(abs(p{c} - min{c}), abs(p{c} - max{c})) * greatest(abs(p{c} - min{c}), abs(p{c} - max{c}))" for c in AXES)
    state = F.expr(f"case when {far2} <= r * r then {CONTAINED} else {INTERSECTED} end")
    return pairs.where(bounds.sphere_overlaps("", vec("p"), "r")).select("sphere_id", "box_id", state.alias("state"))


def _selected(batch: pa.RecordBatch) -> pa.RecordBatch:
    p, r, tri = columns(batch, list(vec("p"))), batch.column("r").to_numpy(zero_copy_only=False), columns(batch, TRIANGLE)
    a, b, c = corners(tri)
    far = np.maximum(np.abs(p - np.minimum(np.minimum(a, b), c)), np.abs(p - np.maximum(np.maximum(a, b), c)))
    hit = kernels.dot(far, far) <= r * r
    rest = np.flatnonzero(~hit)
    gap = p[rest] - kernels.closest_on_triangle(p[rest], *corners(tri[rest]))
    hit[rest] = kernels.dot(gap, gap) <= r[rest] * r[rest]
    return pa.RecordBatch.from_arrays([batch.column("sphere_id"), batch.column("tri_id")], names=["sphere_id", "tri_id"]).filter(pa.array(hit))


def select_region(spheres: DataFrame, tris: DataFrame, strategy: str = "auto") -> DataFrame:
    """Ids of the triangles that each brush sphere touches; those of wholly contained boxes skip the exact test.

    Pairs are classified and tested where they are found: their number grows with both tables, and none is shuffled.
    """
    around = {f"a_{n}{c}": f"p{c} {s} r" for n, s in (("min", "-"), ("max", "+")) for c in AXES}
    return candidates(spheres.select("sphere_id", *vec("p"), "r"), tris.select("tri_id", *TRIANGLE), around, _selected, "sphere_id long, tri_id long", ["sphere_id", "tri_id", *vec("p"), "r", *TRIANGLE], strategy)


def shapecast(nodes: DataFrame, primitives: DataFrame, intersects_bounds: Column, intersects_primitive: Column, first_only: bool = False) -> DataFrame:
    """Generic region query over leaf tiles: nodes (tile, minx..maxz) pruned by a bounds predicate, then primitives by an exact one.

    intersects_bounds gives NOT_INTERSECTED, INTERSECTED or CONTAINED;
    primitives (tile, ...) of contained tiles are reported untested. first_only
    stops at one row.
    """
    state = nodes.select("tile", intersects_bounds.alias("state")).where(F.col("state") != NOT_INTERSECTED)
    met = primitives.join(state, "tile")
    out = met.where(F.col("state") == CONTAINED).unionAll(met.where(F.col("state") == INTERSECTED).where(intersects_primitive))
    out = out.withColumn("contained", F.col("state") == CONTAINED).drop("state")
    return out.limit(1) if first_only else out


def shapecast_ranges(nodes: DataFrame, primitives: DataFrame, intersects_bounds: Column, intersects_range: Callable[[pa.Table, bool], pa.Table], schema: str) -> DataFrame:
    """The same with a function of whole tiles: (primitives of a tile, whether it is contained) -> rows of `schema`."""
    state = nodes.select("tile", intersects_bounds.alias("state")).where(F.col("state") != NOT_INTERSECTED)
    met = primitives.join(state, "tile")

    def run(table: pa.Table) -> pa.Table:
        return intersects_range(table.drop(["state"]), table.column("state")[0].as_py() == CONTAINED)

    return met.groupBy("tile").applyInArrow(run, schema)


def points_in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """(box_id, point_id) of points (point_id, px..pz) inside oriented boxes (box_id, minx..maxz, m0..m15: world to local)."""
    m = [f"m{i}" for i in range(16)]
    points, boxes = points.select("point_id", *vec("p")), boxes.select("box_id", *BOX, *m)
    pairs = plan.cross_small(points, boxes)
    if pairs is None:  # both are large: points as boxes without extent meet the bounds of the boxes in the world
        world = apply(boxes.withColumn("world", _inverted(F.array(*m))), placed_box("world", "b_", "1e-9 * (1e0 + abs({}))"))
        pairs = plan.box_join(apply(points, [{f"a_{f}{c}": f"p{c}" for f in ("min", "max") for c in AXES}]), world.select("box_id", *BOX, *m, *(f"b_{x}" for x in BOX)), strategy="cells")
    return matching(pairs, [exact.box_point_local(m, vec("p"))], bounds.contains_point("", vec("l"))).select("box_id", "point_id")


def oriented_box_overlaps(boxes: DataFrame, others: DataFrame, strategy: str = "auto") -> DataFrame:
    """(box_id, other_id) of oriented boxes (box_id, minx..maxz, inverse: world to local) that overlap aligned ones (other_id, minx..maxz), by the fifteen separating axes."""
    left = in_world(boxes, "a_").drop("inverse")
    right = others.select("other_id", *(F.col(x).alias(f"b_{x}") for x in BOX))

    def known(batch: pa.RecordBatch) -> pa.RecordBatch:
        box = columns(batch, BOX)
        axes = kernels.oriented_axes(_matrices(batch.column("world")), box[:, :3], box[:, 3:])
        return pa.RecordBatch.from_arrays([batch.column("box_id"), *(pa.array(np.ascontiguousarray(x)) for x in axes.T)], names=["box_id", *(f"k{i}" for i in range(axes.shape[1]))])

    def test(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = [batch.column(f"k{i}").to_numpy() for i in range(36)]
        other = [batch.column(f"b_{x}").to_numpy(zero_copy_only=False) for x in BOX]
        hit = kernels.box_box(told, other[:3], other[3:])
        return pa.RecordBatch.from_arrays([batch.column("box_id"), batch.column("other_id")], names=["box_id", "other_id"]).filter(pa.array(hit))

    return boxes_.tested(left, right, test, "box_id long, other_id long", ["box_id", *BOX, "world", "other_id", *(f"b_{x}" for x in BOX)], strategy, known=known)


def oriented_box_point_distances(points: DataFrame, boxes: DataFrame, within: float) -> DataFrame:
    """(box_id, point_id, distance) of points (point_id, px..pz) no farther than `within` from oriented boxes (box_id, minx..maxz, inverse); 0 inside."""
    m, w = [f"inverse[{i}]" for i in range(16)], [f"world[{i}]" for i in range(16)]
    right = in_world(boxes, "b_", within * (1 + 1e-9) + 1e-9)
    pairs = plan.box_join(apply(points.select("point_id", *vec("p")), [{f"a_{f}{c}": f"p{c}" for f in ("min", "max") for c in AXES}]), right)
    clamped = {f"k{c}": f"least(greatest(l{c}, min{c}), max{c})" for c in AXES}
    placed = dict(zip(vec("g"), affine(w, vec("k"))))
    gap = {"distance": "sqrt(" + " + ".join(f"(p{c} - g{c}) * (p{c} - g{c})" for c in AXES) + ")"}
    inside = " and ".join(f"l{c} = k{c}" for c in AXES)
    found = apply(pairs, [exact.box_point_local(m, vec("p")), clamped, placed, gap]).withColumn("distance", F.expr(f"case when {inside} then 0e0 else distance end"))
    return found.where(F.col("distance") <= within).select("box_id", "point_id", "distance")


def frustum_state(objects: DataFrame, planes: list[tuple[float, float, float, float]]) -> DataFrame:
    """objects with state against planes (nx, ny, nz, constant; inside is n.p + constant >= 0)."""
    sides = [bounds.plane_side("", tuple(f"cast({x!r} as double)" for x in p[:3]), f"cast({p[3]!r} as double)") for p in planes]
    named = {f"side_{i}": F.expr(s) for i, s in enumerate(sides)}
    out = objects.withColumns(named)
    low = F.least(*named) if len(named) > 1 else F.col("side_0")
    return out.withColumn("state", F.when(low < 0, NOT_INTERSECTED).when(low > 0, CONTAINED).otherwise(INTERSECTED)).drop(*named)
