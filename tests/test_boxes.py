"""Joins of boxes by tiles, and how their work is dealt out."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import boxes, composite, descent, index, nearest, pairs, rays, regions, views
from tessera.plans import strategy
from tessera.sources import fixtures as fx


def _key(df):
    return sorted(tuple(r) for r in df.collect())


def test_tiles_give_the_pairs_of_a_nested_loop(spark, data, monkeypatch):
    """Both are large: pairs are tested where they are found, in several tasks."""
    t = fx.triangles(spark, data).where("tri_id < 700")
    b = fx.aabbs(spark, data).where("box_id < 700")
    s = fx.spheres(spark, data)
    segments = t.selectExpr("tri_id as seg_id", "ax as x0", "ay as y0", "vbx as x1", "vby as y1")
    queries = [lambda: pairs.box_pairs(b), lambda: pairs.triangle_pairs(t), lambda: regions.box_hits(fx.boxes(spark, data), t), lambda: regions.classify_boxes(b, s), lambda: composite.segment_crossings(segments)]
    want = [_key(q()) for q in queries]
    assert all(want)
    monkeypatch.setattr(strategy, "NESTED_PAIRS", 0)
    monkeypatch.setattr(strategy, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(strategy, "cell_join", None)
    monkeypatch.setattr(strategy, "LEAST_PART", 50)
    monkeypatch.setattr(boxes, "TILE_ROWS", 300)
    assert [_key(q()) for q in queries] == want


def test_unknown_bounds_meet_nothing(spark):
    """A null bound overlaps nothing; NaN is above all numbers."""
    rows = [(1, 0.0, 1.0), (2, 0.5, float("nan")), (3, 5.0, 6.0)]
    make = lambda rows: spark.createDataFrame(rows, "box_id long, lo double, hi double").selectExpr("box_id", *(f"lo as min{c}" for c in "xyz"), *(f"hi as max{c}" for c in "xyz"))
    assert _key(pairs.box_pairs(make(rows), strategy="nested")) == [(1, 2), (2, 3)]
    assert _key(pairs.box_pairs(make([*rows, (4, None, 1.0)]), strategy="tiles")) == [(1, 2), (2, 3)]


def test_few_tiles_make_many_parts(spark):
    """One tile that all rays reach goes to more than one task for each core."""
    left = spark.range(100_000).select(F.lit(0).alias("tile"), "id")
    right = spark.range(3).select(F.lit(0).alias("tile"), F.col("id").alias("prim"))
    l, r = strategy.dealt(left, right, ["tile"], rays.TILE_QUERIES)
    parts = l.select("part").distinct().count()
    assert parts >= 2 * spark.sparkContext.defaultParallelism and r.count() == 3 * parts



def test_nested_nearest_tests_few_pairs(spark, data):
    """The nearest corner bounds the distance: what is tested and sorted is a small part of all pairs."""
    p, t = fx.query_points(spark, data), fx.triangles(spark, data)
    tried = nearest._nested(p, t).count()
    assert p.count() <= tried < p.count() * t.count() / 10
    gone = t.limit(1).select("tri_id", *(F.lit(None).cast("double").alias(x) for x in rays.TRIANGLE)).withColumn("tri_id", F.lit(-1).cast("long"))
    assert _key(nearest.closest_point(p, t.unionAll(gone), strategy="nested")) == _key(nearest.closest_point(p, t, strategy="nested"))



def test_hidden_parts_by_tiles(spark, data, monkeypatch):
    """Parts of edges are found and merged in tasks, with two large tables as with small ones."""
    t = fx.triangles(spark, data).where("tri_id < 700")
    edges = t.selectExpr("tri_id as edge_id", "ax as x0", "ay as y0", "az as z0", "vbx as x1", "vby as y1", "vbz as z1")
    want = _key(views.hidden_parts(edges, t))
    assert want
    monkeypatch.setattr(strategy, "NESTED_PAIRS", 0)
    monkeypatch.setattr(strategy, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(strategy, "cell_join", None)
    monkeypatch.setattr(boxes, "TILE_ROWS", 300)
    assert _key(views.hidden_parts(edges, t)) == want
    got = views._merged(pa.array([2, 1, 2, None, 2, 1]), np.array([0.5, 0.2, 0.0, 0.1, 0.1, 0.9]), np.array([0.6, 0.3, 0.2, 0.9, 0.5, 1.0]))
    assert sorted(map(tuple, got.to_pandas().fillna(0).to_numpy().tolist())) == [(0, 0.1, 0.9), (1, 0.2, 0.3), (1, 0.9, 1.0), (2, 0.0, 0.6)]



def test_descent_tests_pairs_where_ranges_are(spark, data, monkeypatch):
    """Ranges of slots go to the task that has the triangles of both, for runs of slots of any length."""
    t = fx.triangles(spark, data).where("tri_id < 700")
    made = index.build_nodes(t.selectExpr("cast(tri_id % 2 as int) as root_id", "tri_id as box_id", *(f"{f}(a{c}, vb{c}, c{c}) as {n}{c}" for n, f in (("min", "least"), ("max", "greatest")) for c in "xyz")), leaf_size=8)
    monkeypatch.setattr(descent, "TILE_SLOTS", 50)
    monkeypatch.setattr(descent, "PAIRS", 100)
    ids = lambda df: sorted((r.a_id, r.b_id) for r in df.collect())
    want = ids(pairs.triangle_pairs(t, t))
    assert ids(descent.triangle_pairs(t, t, made, made)) == want and len(want) > 700



def test_push_out_sends_triangles_not_pairs(spark, data, monkeypatch):
    """Probes are pushed in tiles that have their triangles; unknown ones stay as they are."""
    t = fx.triangles(spark, data).where("tri_id < 1400")
    probe = fx.spheres(spark, data).selectExpr("sphere_id as probe_id", "px", "py", "pz", "px as qx", "py as qy", "pz + 1e-1 as qz", "r")
    none = spark.createDataFrame([(-1, None, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (-2, float("nan"), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], probe.schema)
    monkeypatch.setattr(strategy, "box_join", None)
    got = {r.probe_id: r for r in composite.push_out(probe.unionAll(none), t).collect()}
    monkeypatch.setattr(composite, "_WINDOW", 3)
    again = {r.probe_id: r for r in composite.push_out(probe, t).collect()}
    assert len(got) == len(again) + 2 == probe.count() + 2 and all(got[k] == r for k, r in again.items())
    assert got[-1].px is None and got[-1].n_hits == got[-2].n_hits == 0 and max(r.n_hits for r in again.values()) > 1


def test_one_hit_settles_a_shape(spark, data, monkeypatch):
    """Whether there is a hit costs a test or so for each shape, not one for each of its pairs."""
    t = fx.triangles(spark, data)
    b, s = fx.boxes(spark, data), fx.spheres(spark, data)
    want = [_key(q(x, t)) for q, x in ((regions.intersects_box, b), (regions.intersects_sphere, s))]
    hits = regions.box_hits(b, t).count()
    monkeypatch.setattr(boxes, "TILE_ROWS", 2000)
    assert [_key(q(x, t, "tiles")) for q, x in ((regions.intersects_box, b), (regions.intersects_sphere, s))] == want
    assert {r[1] for rows in want for r in rows} == {True, False}
    some = regions.box_hits(b, t, "tiles", True)
    ids = {tuple(r) for r in some.collect()}
    assert ids <= {tuple(r) for r in regions.box_hits(b, t).collect()} and len(ids) < hits / 2


def test_cells_are_dealt_to_tasks(spark, data, monkeypatch):
    """Crowded cells and cells that coarse boxes share with all finer ones are searched in parts; no join makes pairs."""
    t = fx.triangles(spark, data).where("tri_id < 700")
    b = fx.aabbs(spark, data).where("box_id < 700")
    wide = b.where("box_id < 5").selectExpr("-1 - box_id as box_id", *(f"min{c} - 3e0 as min{c}" for c in "xyz"), *(f"max{c} + 3e0 as max{c}" for c in "xyz"))
    b = b.unionByName(wide)
    s = fx.spheres(spark, data)
    want = [_key(pairs.box_pairs(b, strategy="nested")), _key(regions.sphere_hits(s, t, "nested"))]
    assert [len(x) > 700 for x in want] == [True, True]
    joined = strategy.cell_join(*(b.select(F.col("box_id").alias(f"{p}_id"), *(F.col(x).alias(f"{p}_{x}") for x in regions.BOX)) for p in "ab"))
    assert sorted((r.a_id, r.b_id) for r in joined.collect() if r.a_id < r.b_id) == want[0]
    monkeypatch.setattr(strategy, "box_join", None)
    monkeypatch.setattr(strategy, "LEAST_PART", 50)
    monkeypatch.setattr(boxes, "TILE_ROWS", 100)
    assert [_key(pairs.box_pairs(b, strategy="cells")), _key(regions.sphere_hits(s, t, "cells"))] == want
    none = b.limit(0)
    assert not pairs.box_pairs(none, b, strategy="cells").count()


def test_what_a_box_needs_is_computed_once(spark, data, monkeypatch):
    """Turned and sheared boxes by tiles meet what they meet by a nested loop; their axes are computed for rows, not for pairs."""
    b = fx.boxes(spark, data).withColumn("inverse", F.expr("transform(array(8e-1, -6e-1, 0e0, 0e0, 6e-1, 8e-1, 1e-1, 0e0, 0e0, 2e-1, 1e0 + vec_id % 3, 0e0, 1e-1, -2e-1, 5e-2, 1e0), x -> x)".replace("vec_id", "box_id")))
    others = fx.aabbs(spark, data).withColumnRenamed("box_id", "other_id")
    want = _key(regions.oriented_box_overlaps(b, others))
    seen = spark.sparkContext.accumulator(0)
    axes = regions.kernels.oriented_axes

    def counted(world, low, high):
        seen.add(len(low))
        return axes(world, low, high)

    monkeypatch.setattr(regions, "kernels", type("K", (), {"oriented_axes": staticmethod(counted), "box_box": staticmethod(regions.kernels.box_box)}))
    got = _key(regions.oriented_box_overlaps(b, others, "tiles"))
    assert got == want and len(want) > 700
    assert 0 < seen.value <= 2 * b.count()


def test_brushes_make_no_pairs_to_shuffle(spark, data):
    """Triangles of brushes are told where they are found: there is one join, and by any strategy the rows are those of spheres."""
    t = fx.triangles(spark, data)
    s = fx.spheres(spark, data).withColumn("r", F.when(F.col("sphere_id") % 9 == 0, 3.0).otherwise(F.col("r")))  # some contain whole triangles
    want = sorted((r.sphere_id, r.tri_id) for r in regions.sphere_hits(s, t).collect())
    found = regions.select_region(s, t)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    for strategy_ in ("nested", "tiles"):
        assert _key(regions.select_region(s, t, strategy_)) == want
