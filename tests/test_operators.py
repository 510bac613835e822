"""Operators on small tables with known answers, and strategies against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bake, composite, index, nearest, pairs, rays, regions, scene
from tessera.plans import strategy
from tessera.sources import fixtures as fx
from tessera.sources import geometry


def torus(spark, radius=5.0, tube=2.0, around=40, across=10):
    u, v = np.arange(around) * 2 * np.pi / around, np.arange(across) * 2 * np.pi / across
    p = lambda i, j: ((radius + tube * np.cos(v[j % across])) * np.cos(u[i % around]), (radius + tube * np.cos(v[j % across])) * np.sin(u[i % around]), tube * np.sin(v[j % across]))
    out = []
    for i in range(around):
        for j in range(across):
            for t in ((p(i, j), p(i + 1, j), p(i + 1, j + 1)), (p(i, j), p(i + 1, j + 1), p(i, j + 1))):
                out.append((len(out), *(float(x) for q in t for x in q)))
    return spark.createDataFrame(out, "tri_id long, " + ", ".join(f"{c} double" for c in rays.TRIANGLE))


def ray(spark, *rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")


def test_torus_crossings(spark):
    t = torus(spark)
    r = ray(spark, (0.01, 0.02, 10, 0, 0, -1), (5.01, 0.02, 10, 0, 0, -1), (-20, 0.03, 0.04, 1, 0, 0))
    for s in ("nested", "tree", "tiles"):
        n = {x.ray_id: x["count"] for x in rays.raycast(r, t, strategy=s).groupBy("ray_id").count().collect()}
        assert n == {1: 2, 2: 4}
        first = {x.ray_id: x.distance for x in rays.raycast(r, t, first=True, strategy=s).collect()}
        assert abs(first[1] - 8) < 0.1 and abs(first[2] - 13) < 0.1
    fronts = rays.raycast(r, t, side="front").groupBy("ray_id").count().collect()
    backs = rays.raycast(r, t, side="back").groupBy("ray_id").count().collect()
    assert sorted(fronts) == sorted(backs)


def test_near_and_far_are_closed(spark):
    t = spark.createDataFrame([(0, -1.0, -1.0, 5.0, 3.0, -1.0, 5.0, -1.0, 3.0, 5.0)], "tri_id long, " + ", ".join(f"{c} double" for c in rays.TRIANGLE))
    r = ray(spark, (0, 0, 0, 0, 0, 2))
    assert rays.raycast(r, t, near=5.0, far=5.0).count() == 1
    assert rays.raycast(r, t, near=5.1).count() == 0 and rays.raycast(r, t, far=4.9).count() == 0
    hit = rays.raycast(r, t).first()
    assert hit.t == 2.5 and hit.distance == 5


def test_degenerate_ray_and_empty_tables(spark):
    t = torus(spark)
    for s in ("nested", "tree", "tiles"):
        assert rays.raycast(ray(spark, (0, 0, 0, 0, 0, 0)), t, strategy=s).count() == 0
        assert rays.raycast(ray(spark, (0, 0, 0, 0, 0, 1)), t.limit(0), strategy=s).count() == 0
        assert rays.raycast(ray(spark), t, strategy=s, first=True).count() == 0


def test_threshold_edges(spark):
    r = ray(spark, (0, 0, 0, 1, 0, 0))
    p = spark.createDataFrame([(0, 3.0, 1.0, 0.0), (1, 3.0, 0.5, 0.0), (2, -1.0, 0.5, 0.0)], "point_id long, px double, py double, pz double")
    assert [x.point_id for x in rays.raycast_points(r, p, 1.0).collect()] == [1]
    s = spark.createDataFrame([(0, 3.0, 1.0, -1.0, 3.0, 1.0, 1.0), (1, 3.0, 1.1, -1.0, 3.0, 1.1, 1.0)], "seg_id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    assert [x.seg_id for x in rays.raycast_segments(r, s, 1.0).collect()] == [0]


def rounded(df, *keys):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*keys).collect())


def test_large_sides_meet_by_tiles_and_cells(spark, data, monkeypatch):
    r, p, t = fx.event_rays(spark, data), fx.points(spark, data), fx.triangles(spark, data)
    q = fx.event_rays(spark, data).selectExpr("ray_id as query_id", "ox as qx", "oy as qy", "oz as qz")
    turn = [0.8, -0.6, 0.0, 0.0, 0.6, 0.8, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.1, -0.2, 0.05, 1.0]
    turned = fx.boxes(spark, data).withColumns({f"m{i}": F.lit(x) for i, x in enumerate(turn)})
    inst = spark.range(9).selectExpr("id as object_id", "cast(0 as int) as instance_id", "id % 3 as geom_id", "array(1D, 0D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 0D, 1D, 0D, cast(id as double), 0D, 0D, 1D) as matrix", "true as visible")
    far = pairs.transformed(t, [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 5, 0, 0, 1])
    asked = {
        "points": lambda: rays.raycast_points(r, p, 5.0),
        "near": lambda: nearest.closest_point(fx.query_points(spark, data), t),
        "few": lambda: nearest.nearest_points(q, p, 3),
        "many": lambda: nearest.nearest_points(q, p, 40),
        "boxes": lambda: pairs.box_pairs(fx.aabbs(spark, data)),
        "held": lambda: regions.points_in_boxes(fx.query_points(spark, data).withColumnRenamed("query_id", "point_id"), turned),
        "scene": lambda: scene.raycast_scene(fx.rays(spark, data), inst, t.withColumn("geom_id", F.col("tri_id") % 3)).select("ray_id", "object_id", "tri_id", "distance"),
        "closest": lambda: pairs.closest_geometry(t, far).select("a_id", "b_id", "distance"),
        "first": lambda: rays.raycast(fx.rays(spark, data), t, first=True).select("ray_id", "tri_id", "distance"),
    }
    want = {k: rounded(f(), "*") for k, f in asked.items()}
    for name, value in (("TREE_ROWS", 10), ("NESTED_PAIRS", 0), ("BROADCAST_BYTES", 0)):
        monkeypatch.setattr(strategy, name, value)
    monkeypatch.setattr(rays, "TILE_ROWS", 300)
    monkeypatch.setattr(rays, "TILE_QUERIES", 50)
    for k, f in asked.items():
        assert rounded(f(), "*") == want[k], k


def test_tiles_with_an_outlier_and_all_rays_on_one(spark, monkeypatch):
    t = torus(spark)
    out = t.unionByName(t.where("tri_id = 0").select((F.col("tri_id") + 10_000).alias("tri_id"), *((F.col(c) + 1e12).alias(c) for c in rays.TRIANGLE)))
    monkeypatch.setattr(rays, "TILE_ROWS", 50)
    monkeypatch.setattr(rays, "TILE_QUERIES", 10)
    cut, tiles = rays.tiled(out)
    sizes = [x["count"] for x in cut.groupBy("tile").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 150
    same = spark.range(200).selectExpr("id as ray_id", "5.01D as ox", "0.02D as oy", "10D as oz", "0D as dx", "0D as dy", "-1D as dz")
    sent, held = strategy.dealt(rays.sent_to_tiles(same, tiles), cut, ["tile"], 10)
    assert sent.groupBy("tile", "part").count().agg(F.max("count")).first()[0] < 40
    assert rays.raycast(same, out, strategy="tiles").groupBy("ray_id").count().where("count <> 2").isEmpty()
    assert rays.raycast(same, out, strategy="tiles").count() == 400


def test_nearest_thresholds(spark, monkeypatch):
    t = torus(spark)
    q = spark.createDataFrame([(0, 5.0, 0.0, 2.1), (1, 50.0, 0.0, 0.0)], "query_id long, px double, py double, pz double")
    every = {r.query_id: r.distance for r in nearest.closest_point(q, t).collect()}
    monkeypatch.setattr(rays, "TILE_ROWS", 50)
    some = {r.query_id: r.distance for r in nearest.closest_point(q, t, strategy="tiles", enough=1.0).collect()}
    assert every[0] <= some[0] < 1.0 and some[1] == every[1]
    far = pairs.transformed(t, [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 20, 0, 0, 1])
    assert pairs.closest_geometry(t, far, farthest=5.0).count() == 0
    assert abs(pairs.closest_geometry(t, far, farthest=7.0).first().distance - 6) < 1e-9
    assert abs(pairs.closest_geometry(t, far, enough=100.0).first().distance - 6) < 1


def test_surface_only(spark):
    t = torus(spark)
    s = spark.createDataFrame([(0, 5.0, 0.0, 0.0, 0.5), (1, 5.0, 0.0, 2.0, 0.5), (2, 50.0, 0.0, 0.0, 1.0)], "sphere_id long, px double, py double, pz double, r double")
    assert {x.sphere_id: x.intersects for x in regions.intersects_sphere(s, t).collect()} == {0: False, 1: True, 2: False}
    assert not pairs.intersects_geometry(t, pairs.transformed(t, [0.01, 0, 0, 0, 0, 0.01, 0, 0, 0, 0, 0.01, 0, 5, 0, 0, 1])).first().intersects
    assert pairs.intersects_geometry(t, pairs.transformed(t, [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 5, 0, 0, 1])).first().intersects


def test_closest_geometry_of_spaced_copies(spark):
    t = torus(spark)
    far = pairs.transformed(t, [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 20, 0, 0, 1])
    assert abs(pairs.closest_geometry(t, far).first().distance - 6) < 1e-9
    assert pairs.closest_geometry(t, far.limit(0)).count() == 0


def test_ranges_and_gaps(spark):
    g = spark.createDataFrame([(0, 0, 21), (0, 16, 25), (0, 41, 20)], "geom_id long, start long, count long")
    got = sorted((r.range_start, r.range_end - 1) for r in geometry.root_ranges(g, 10, 55).collect())
    assert got == [(10, 15), (16, 20), (21, 40), (41, 54)]
    gap = spark.createDataFrame([(0, 0, 6), (0, 12, None)], "geom_id long, start long, count long")
    assert sorted((r.range_start, r.range_end) for r in geometry.root_ranges(gap, 0, 36).collect()) == [(0, 6), (12, 36)]


def test_index_round_trip_and_versions(spark, tmp_path, data):
    b = fx.aabbs(spark, data).withColumn("root_id", F.lit(0))
    nodes, order = index.build_nodes(b)
    same = lambda x, y: sorted(map(tuple, x.select(y.columns).collect())) == sorted(map(tuple, y.collect()))
    told = index.tree_json(nodes)
    assert told.startswith('{"bounds"') and '"left"' in told
    geometry.write_index(nodes, order, str(tmp_path / "new"))
    nodes.write.parquet(str(tmp_path / "old" / "nodes"))  # version 0 knows no version
    order.write.parquet(str(tmp_path / "old" / "order"))
    for name in ("new", "old"):
        back, again = geometry.read_index(spark, str(tmp_path / name))
        assert same(back, nodes) and same(again, order)
        assert index.tree_json(back) == told
    stored = spark.read.parquet(str(tmp_path / "new" / "nodes"))
    assert stored.where("version <> 1").isEmpty() and stored.where("right_id > 0 and right_id = 2").count() > 0


def test_objects_are_collected_however_deep(spark):
    chain = [(i - 1 if i else None, i, "mesh") for i in range(90)] + [(89, 5, "mesh"), (300, 301, "mesh")]  # one below itself, one elsewhere
    scene_ = spark.createDataFrame(chain, "parent_id long, id long, kind string")
    assert sorted(r.id for r in scene.collect_objects(scene_, spark.createDataFrame([(0,)], "id long")).collect()) == list(range(90))


def test_traverse_leaves_out_what_is_not_entered(spark, data):
    nodes, _ = index.build_nodes(fx.aabbs(spark, data).withColumn("root_id", F.lit(0)))
    rows = {r.node_id: r for r in nodes.collect()}
    want, stack = [], [0]
    while stack:
        r = rows[stack.pop()]
        want.append(r.node_id)
        if not r.is_leaf and r.maxx > 0.5:
            stack += [r.node_id + 1, r.right_id]
    assert sorted(r.node_id for r in index.traverse(nodes, enter=F.col("maxx") > 0.5).collect()) == sorted(want)
    assert 0 < len(want) < len(rows)


def test_refit_below_an_inner_node(spark, data):
    b = fx.aabbs(spark, data).withColumn("root_id", F.lit(0))
    nodes, order = index.build_nodes(b)
    inner = nodes.where("depth = 2 and not is_leaf").orderBy("node_id").first()
    held = order.where((F.col("slot") >= inner.offset) & (F.col("slot") < inner.offset + inner["count"])).select("box_id")
    moved = b.join(held, "box_id", "left_semi").withColumn("maxx", F.col("maxx") + 9).unionByName(b.join(held, "box_id", "left_anti"))
    dirty = spark.createDataFrame([(0, inner.node_id)], "root_id int, node_id long")
    key = lambda df: sorted(map(tuple, df.select("node_id", *regions.BOX).collect()))
    assert key(index.refit(nodes, order, moved, dirty)) == key(index.refit(nodes, order, moved)) != key(nodes)


def test_scene_first_hit_is_nearest_of_all(spark, data):
    t = torus(spark).withColumn("geom_id", F.lit(0).cast("long"))
    inst = spark.createDataFrame([(i, 0, 0, [float(x) for x in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 10 * i, 1)], i != 2) for i in range(4)], "object_id long, instance_id int, geom_id long, matrix array<double>, visible boolean")
    r = ray(spark, (5.01, 0.02, 100, 0, 0, -1))
    every = scene.raycast_scene(r, inst, t).collect()
    assert len(every) == 6 and {x.object_id for x in every} == {0, 1, 3}
    first = scene.raycast_scene(r, inst, t, first="scene").collect()
    assert len(first) == 1 and first[0].distance == min(x.distance for x in every)
    assert len(scene.raycast_scene(r, inst, t, first="instance").collect()) == 3


def test_bake_errors_and_morph(spark):
    a = spark.createDataFrame([(0, 0, 1.0)], "geom_id long, vid long, x double")
    assert bake.merge_geometries([a, a]).count() == 2
    with pytest.raises(ValueError):
        bake.merge_geometries([a, a.withColumn("y", F.lit(1.0))])
    v = spark.createDataFrame([(0, 0, 1.0, 1.0, 1.0)], "geom_id long, vid long, x double, y double, z double")
    t = spark.createDataFrame([(0, 0, 0, 0.5, 3.0, 1.0, 0.0)], "geom_id long, vid long, target int, influence double, x double, y double, z double")
    assert tuple(bake.morph(v, t, relative=False).first())[2:] == (2.0, 1.0, 0.5)
    assert tuple(bake.morph(v, t).first())[2:] == (2.5, 1.5, 1.0)


def test_push_out_and_voxels(spark):
    floor = spark.createDataFrame([(0, -9.0, -9.0, 0.0, 9.0, -9.0, 0.0, 0.0, 9.0, 0.0)], "tri_id long, " + ", ".join(f"{c} double" for c in rays.TRIANGLE))
    probe = spark.createDataFrame([(0, 0.0, 0.0, 0.6, 0.0, 0.0, 2.0, 1.0), (1, 0.0, 0.0, 9.0, 0.0, 0.0, 9.0, 1.0)], "probe_id long, px double, py double, pz double, qx double, qy double, qz double, r double")
    got = {x.probe_id: (round(x.pz, 9), round(x.qz, 9), x.n_hits) for x in composite.push_out(probe, floor).collect()}
    assert got == {0: (1.0, 2.4, 1), 1: (9.0, 9.0, 0)}
    kinds = {x.kind: x["count"] for x in composite.voxelize(torus(spark), 12).groupBy("kind").count().collect()}
    assert kinds["surface"] > kinds["inside"] > 0
    field = composite.distance_field(torus(spark), 12).agg(F.min("distance"), F.max("distance")).first()
    assert -2 < field[0] < -1 and field[1] > 1


def test_a_probe_is_pushed_through_many_walls(spark):
    """Every push takes it into the next wall, beyond the triangles that were near it at first."""
    from tessera.functions import kernels as K

    wall = lambda i, x: (i, x, -9.0, -9.0, x, 9.0, -9.0, x, 0.0, 9.0)
    rows = [wall(i, 0.6 * i) for i in range(9)] + [wall(20, 60.0)]
    probe = [(0, 0.5, 0.0, 0.0, 0.5, 0.0, 0.5, 1.0), (1, 30.0, 0.0, 0.0, 30.0, 0.0, 0.0, 1.0), (2, 59.5, 0.0, 0.0, 59.5, 0.0, 0.0, 0.7)]
    want = {}
    for i, *ends, r in probe:
        p, q, n = np.array(ends[:3]), np.array(ends[3:]), 0
        for _, *t in sorted(rows):
            s = [np.array([t[3 * k : 3 * k + 3]]) for k in range(3)]
            near = [K.segment_segment(s[e], s[(e + 1) % 3], p[None], q[None]) for e in range(3)] + [(K.closest_on_triangle(x[None], *s), x[None]) for x in (p, q)]
            x, y = min(near, key=lambda v: np.linalg.norm(v[0] - v[1]))
            d = np.linalg.norm(x - y)
            if 0 < d < r:
                move = (y - x)[0] / d * (r - d)
                p, q, n = p + move, q + move, n + 1
        want[i] = (*np.round([*p, *q], 9), n)
    tris = spark.createDataFrame(rows, "tri_id long, " + ", ".join(f"{c} double" for c in rays.TRIANGLE))
    probes = spark.createDataFrame(probe, "probe_id long, px double, py double, pz double, qx double, qy double, qz double, r double")
    got = {r[0]: (*np.round(r[1:7], 9), r[7]) for r in composite.push_out(probes, tris).collect()}
    assert got == want and want[0][6] >= 7 and want[1][6] == 0


def test_shared_edges_are_no_features(spark):
    assert composite.feature_edges(torus(spark, around=200, across=200), cosine=0.9).count() == 0
    assert composite.feature_edges(torus(spark), cosine=0.99).count() > 0


def test_keys_too_large_for_a_task(spark, data, monkeypatch):
    """Vertex numbers, polylines and merged intervals by ranges are those by windows."""
    from tessera.plans import ordered

    o = spark.read.parquet(f"{data}/orders.parquet").selectExpr("o_custkey % 3 as k", "o_orderkey * 7 % 5000 as lo", "o_orderkey * 7 % 5000 + o_orderkey % 4 as hi")
    v = spark.range(500).selectExpr("id % 2 as geom_id", "id * 37 % 997 as vid")
    p = fx.polyline_points(spark, data).withColumn("user_id", F.col("user_id") % 2)
    one = p.limit(1).withColumn("user_id", F.lit(99).cast("long"))
    asked = {
        "numbers": lambda: geometry.ensure_index(v).select("geom_id", "slot", "vid"),
        "open": lambda: geometry.polyline_segments(p.unionByName(one), "user_id", ["ts", "point_id"]).select("seg_id", "x0", "x1", "y1", "z1"),
        "closed": lambda: geometry.polyline_segments(p.unionByName(one), "user_id", ["ts", "point_id"], closed=True).select("seg_id", "x0", "x1", "y1", "z1"),
        "merged": lambda: composite.compress_intervals(o, "k").select("k", "lo", "hi"),
        "gaps": lambda: composite.gaps_between(o, "k", 0, 6000).select("k", "lo", "hi"),
    }
    want = {n: rounded(f(), "*") for n, f in asked.items()}
    monkeypatch.setattr(ordered, "KEY_ROWS", 0)
    for n, f in asked.items():
        assert rounded(f(), "*") == want[n], n


def test_paths_bounce_inside_a_box(spark):
    """Inside a closed box every path goes on; over a floor none meets anything again."""
    corners = [(x, y, z) for x in (-1.0, 1.0) for y in (-1.0, 1.0) for z in (-1.0, 1.0)]
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    rows = [(2 * i + h, *(v for k in (q[0], q[1 + h], q[2 + h]) for v in corners[k])) for i, q in enumerate(quads) for h in (0, 1)]
    box = spark.createDataFrame(rows, "tri_id long, " + ", ".join(f"{c} double" for c in rays.TRIANGLE))
    r = spark.range(60).selectExpr("id as ray_id", "0.1D as ox", "0.05D as oy", "0.02D as oz", "cos(id) as dx", "sin(id) as dy", "cos(id * 3) as dz")
    paths = composite.trace_paths(r, box, (0.3, 0.2, 0.1), bounces=2)
    got = paths.collect()
    assert [sum(x.bounce == b for x in got) for b in range(3)] == [60, 60, 60]
    assert all(x.lit and x.shade > 0 for x in got)  # nothing stands between the light and a wall
    at = {(x.ray_id, x.bounce): x.tri_id // 2 for x in got}
    assert all(at[i, b] != at[i, b + 1] for i in range(60) for b in range(2))  # a ray leaves its wall
    assert sorted(map(tuple, composite.trace_paths(r, box, (0.3, 0.2, 0.1), bounces=2).collect())) == sorted(map(tuple, got))
    floor = box.where("tri_id in (8, 9)")
    assert {x.bounce for x in composite.trace_paths(r, floor, (0.0, 0.0, 5.0), bounces=2).collect()} == {0}


def test_texels_are_dealt_anew(spark):
    from tessera.sources import textures

    v = spark.range(12).selectExpr("id as i", "id * 2 as v")
    got = sorted(map(tuple, textures.attribute_texels(v, "i", ["v"], channels=3).collect()))
    assert got == [(k, k % 2, k // 2, 6 * k, 6 * k + 2, 6 * k + 4, 1) for k in range(4)]
    with pytest.raises(ValueError):
        textures.attribute_texels(v, "i", ["v"], channels=5)
    with pytest.raises(ValueError):
        textures.hierarchy_texels(spark.createDataFrame([(0, 0), (1, 0)], "root_id int, node_id long"))


def test_bounded_tables_are_checked(spark):
    with pytest.raises(ValueError):
        strategy.bounded(spark.range(20), 10)
