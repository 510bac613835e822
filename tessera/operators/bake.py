"""Baking scenes to static geometry: transforms, morphs, skinning, merging and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.staged import apply
from ..functions.vectors import AXES, affine, cross, determinant, named, vec
from ..plans.durable import cut
from .rays import TRIANGLE
from .scene import MATRIX


def bake_triangles(tris: DataFrame, instances: DataFrame) -> DataFrame:
    """World-space triangles (object_id, instance_id, tri_id, ...); mirrored instances have their winding turned."""
    moved = {}
    for p in ("a", "vb", "c"):
        moved |= {f"w{k}": v for k, v in named(p, affine(MATRIX, vec(p))).items()}
    out = apply(tris.join(instances, "geom_id"), [moved | {"det": determinant(MATRIX)}])
    swap = {f"{p}{c}": F.when(F.col("det") < 0, F.col(f"w{q}{c}")).otherwise(F.col(f"w{p}{c}")) for p, q in (("a", "c"), ("c", "a")) for c in AXES}
    return out.withColumns(swap | {f"vb{c}": F.col(f"wvb{c}") for c in AXES}).select("object_id", "instance_id", "tri_id", *TRIANGLE)


def bake_vertices(vertices: DataFrame, instances: DataFrame) -> DataFrame:
    """World-space vertices (object_id, instance_id, vid, x, y, z, ...) of instances.

    Normals (nx, ny, nz) go by the inverse transpose, tangents (tx, ty, tz) by
    the matrix, both scaled to length one (a zero stays zero); any other
    columns, such as uv or tw, stay as they are.
    """
    moved = dict(zip([f"w{c}" for c in AXES], affine(MATRIX, ("x", "y", "z"))))
    columns = [tuple(MATRIX[4 * j + r] for r in range(3)) for j in range(3)]
    cofactors = [cross(columns[(j + 1) % 3], columns[(j + 2) % 3]) for j in range(3)]
    steps = [moved | {"det": determinant(MATRIX)}]
    out = {c: f"w{c}" for c in AXES}
    for name, turned in (("n", [" + ".join(f"{cofactors[j][r]} * n{c}" for j, c in enumerate(AXES)) for r in range(3)]), ("t", [" + ".join(f"{columns[j][r]} * t{c}" for j, c in enumerate(AXES)) for r in range(3)])):
        if f"{name}x" in vertices.columns:
            sign = " * case when det < 0e0 then -1e0 else 1e0 end" if name == "n" else ""
            steps += [{f"u{name}{c}": f"({e}){sign}" for c, e in zip(AXES, turned)}, {f"l{name}": f"sqrt(un{name}x * un{name}x + un{name}y * un{name}y + un{name}z * un{name}z)".replace(f"un{name}", f"u{name}")}]
            out |= {f"{name}{c}": f"case when l{name} > 0e0 then u{name}{c} / l{name} else 0e0 end" for c in AXES}
    rest = [c for c in vertices.columns if c not in out and c != "geom_id"]
    full = apply(vertices.join(instances.select("object_id", "instance_id", "geom_id", "matrix"), "geom_id"), steps)
    return full.select("object_id", "instance_id", *rest, *(F.expr(e).alias(c) for c, e in out.items()))


def merge_index(index: DataFrame, vertex_counts: DataFrame, index_counts: DataFrame, skip: list[int] | None = None) -> DataFrame:
    """(geom_id, slot, vid) of the merged geometry: slots and vertices shifted by what the geometries before have.

    index: geom_id, slot, vid; counts: geom_id, n_vertices. Geometries in
    `skip` keep their room but are not written, as they have not changed.
    """
    v = merge_offsets(vertex_counts).select("geom_id", F.col("first_vertex").alias("v0"))
    s = merge_offsets(index_counts).select("geom_id", F.col("first_vertex").alias("s0"))
    some = index.where(~F.col("geom_id").isin(skip)) if skip else index
    return some.join(v, "geom_id").join(s, "geom_id").select("geom_id", (F.col("slot") + F.col("s0")).alias("slot"), (F.col("vid") + F.col("v0")).alias("vid"))


def merge_groups(index_counts: DataFrame) -> DataFrame:
    """(start, count, material_index): a group for each geometry of a merged one, in order of id."""
    ranks = merge_offsets(index_counts.select("geom_id", F.lit(1).cast("long").alias("n_vertices"))).select("geom_id", F.col("first_vertex").alias("material_index"))
    return merge_offsets(index_counts).join(ranks, "geom_id").select(F.col("first_vertex").alias("start"), F.col("n_vertices").alias("count"), "material_index")


def invert_winding(tris: DataFrame) -> DataFrame:
    """Triangles with their first and last corner swapped."""
    old = {c: F.col(c) for c in TRIANGLE}
    return tris.select(*(c for c in tris.columns if c not in old), *(old[f"c{c}"].alias(f"a{c}") for c in AXES), *(old[f"vb{c}"] for c in AXES), *(old[f"a{c}"].alias(f"c{c}") for c in AXES))


def morph(vertices: DataFrame, targets: DataFrame, relative: bool = True) -> DataFrame:
    """vertices (geom_id, vid, x, y, z) moved by targets (geom_id, vid, target, influence, x, y, z).

    relative: targets are offsets; else positions, and each adds its
    difference from the base. Targets of a vertex are added in their order.
    """
    t = targets.select("geom_id", "vid", "target", "influence", *(F.col(c).alias(f"t{c}") for c in AXES))
    sums = t.groupBy("geom_id", "vid").agg(F.sort_array(F.collect_list(F.struct("target", "influence", "tx", "ty", "tz"))).alias("ts"))  # one entry a target
    joined = vertices.join(sums, ["geom_id", "vid"], "left")
    out = {}
    for c in AXES:
        step = f"s.influence * s.t{c}" if relative else f"s.influence * (s.t{c} - {c})"
        out[c] = F.expr(f"{c} + aggregate(coalesce(ts, array()), 0e0, (acc, s) -> acc + {step})")
    return joined.select("geom_id", "vid", *(v.alias(c) for c, v in out.items()))


def skin(vertices: DataFrame, weights: DataFrame, bones: DataFrame) -> DataFrame:
    """Linear blend skinning: the weighted sum of bone transforms (bone, matrix: bone times inverse bind) of each vertex.

    weights: geom_id, vid, slot, bone, weight; zero weights are left out. A
    vertex without weights stays.
    """
    used = weights.where("weight <> 0").join(bones, "bone")
    m = used.groupBy("geom_id", "vid").agg(F.sort_array(F.collect_list(F.struct("slot", "weight", "matrix"))).alias("ws"))  # four a vertex
    blend = {f"m{i}": F.expr(f"aggregate(ws, 0e0, (acc, w) -> acc + w.weight * w.matrix[{i}])") for i in range(16)}
    joined = vertices.join(m, ["geom_id", "vid"], "left").withColumns(blend)
    moved = affine([f"m{i}" for i in range(16)], ("x", "y", "z"))
    return joined.select("geom_id", "vid", *(F.expr(f"case when ws is null then {c} else {e} end").alias(c) for c, e in zip(AXES, moved)))


def merge_offsets(counts: DataFrame) -> DataFrame:
    """(geom_id, n_vertices, first_vertex): running vertex offsets over the geometries in order of id.

    Offsets run inside each range of ids, and the ranges' sums, one row for
    each shuffle partition, are added up on the driver.
    """
    spark = counts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = cut(counts.repartitionByRange(n, "geom_id").withColumn("part", F.spark_partition_id()))
    offsets, at = [], 0
    for number, size in sorted(parted.groupBy("part").agg(F.sum("n_vertices")).collect()):
        offsets.append((number, at))
        at += size
    w = Window.partitionBy("part").orderBy("geom_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = parted.withColumn("inside", F.sum("n_vertices").over(w) - F.col("n_vertices"))
    offset = spark.createDataFrame(offsets, "part int, offset long")
    return inside.join(F.broadcast(offset), "part").withColumn("first_vertex", F.col("inside") + F.col("offset")).select(*counts.columns, "first_vertex")


def merge_geometries(parts: list[DataFrame]) -> DataFrame:
    """Union of vertex tables with equal columns; a mismatch is an error."""
    names = parts[0].dtypes
    for p in parts[1:]:
        if sorted(p.dtypes) != sorted(names):
            raise ValueError("geometries to merge need equal attributes")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def changed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or changed rows between two snapshots, by a null-safe comparison of all columns."""
    cols = [c for c in new.columns if c != key]
    a = old.select(F.col(key).alias("_k"), F.struct(*cols).alias("_old"))
    b = new.select(F.col(key).alias("_l"), F.struct(*cols).alias("_new"))
    joined = a.join(b, F.col("_k") == F.col("_l"), "full")
    state = F.when(F.col("_k").isNull(), "added").when(F.col("_l").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return joined.select(F.coalesce("_k", "_l").alias(key), state.alias("change")).where("change is not null")


def materials(meshes: DataFrame) -> DataFrame:
    """(position, material): materials of the meshes (mesh_id, materials: array) in mesh order."""
    return meshes.select("mesh_id", F.posexplode("materials").alias("slot", "material"))
