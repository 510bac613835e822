"""Hierarchies larger than a task: building, refitting and walking them."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from tessera import catalogue
from tessera.operators import descent, index, pairs, rays, scene, stored
from tessera.operators.regions import BOX
from tessera.sources import fixtures as fx
from tessera.sources import geometry


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()))


@pytest.fixture(scope="module")
def boxes(spark, data):
    """Two roots: one of some hundred boxes with 60 equal ones among them, one of a few."""
    some = fx.aabbs(spark, data).where("box_id % 12 = 0").withColumn("root_id", F.when(F.col("box_id") % 60 == 0, 1).otherwise(0))
    same = spark.range(60).selectExpr("id + 1000000 as box_id", *(f"{v} as {x}" for x, v in zip(BOX, ("1e-1", "2e-1", "3e-1", "15e-2", "25e-2", "35e-2"))), "0 as root_id")
    return some.unionByName(same).coalesce(2).cache()


@pytest.fixture(scope="module")
def levelled(boxes):
    """Nodes and order by levels, of leaves that hold more than a task does too."""
    nodes, order = index.build_nodes(boxes, task_rows=50)
    return nodes.cache(), order.cache()


def same_tree(made, want):
    names = [x.split()[0] for x in index.NODES.split(", ")]
    assert rows(made[0], *names) == rows(want[0], *names)
    assert rows(made[1], "root_id", "slot", "box_id") == rows(want[1], "root_id", "slot", "box_id")


def test_levels_build_what_a_task_builds(boxes, levelled):
    same_tree(levelled, index.build_nodes(boxes))
    assert levelled[0].where("node_id = 0").count() == 2 and levelled[0].where("is_leaf and count >= 60").count() == 1


@pytest.mark.parametrize("strategy,depth", [("average", 40), ("sah", 40), ("center", 2)])
def test_other_strategies_and_a_low_tree(boxes, strategy, depth):
    same_tree(index.build_nodes(boxes, strategy=strategy, max_depth=depth, task_rows=100), index.build_nodes(boxes, strategy=strategy, max_depth=depth))


def test_paths_lead_to_parents(levelled):
    nodes = levelled[0].collect()
    by_path = {(n.root_id, n.path): n for n in nodes}
    assert len(by_path) == len(nodes)
    for n in nodes:
        assert n.path.bit_length() == n.depth + 1
        if n.depth:
            up = by_path[n.root_id, n.path >> 1]
            assert up.node_id == n.parent_id and (up.right_id == n.node_id if n.path & 1 else up.node_id + 1 == n.node_id)


def test_a_tree_deeper_than_a_path_is_an_error(boxes):
    with pytest.raises(ValueError):
        index.build_nodes(boxes, max_depth=62)


def test_refit_with_and_without_dirty_leaves(boxes, levelled):
    nodes, order = levelled
    moved = boxes.withColumns({x: F.when(F.col("box_id") % 84 == 0, F.col(x) + 3).otherwise(F.col(x)) for x in BOX})
    dirty = index.leaves_of(nodes, order, boxes.where("box_id % 84 = 0"))
    whole, part = index.refit(nodes, order, moved), index.refit(nodes, order, moved, dirty)
    names = ["root_id", "node_id", *BOX]
    assert rows(whole, *names) == rows(part, *names) != rows(nodes, *names)
    assert not index.validate_bounds(whole, order, moved).where("bad_nodes > 0 or bad_primitives > 0").count()


def test_dirty_inner_nodes_stand_for_their_leaves(boxes, levelled):
    nodes, order = levelled
    moved = boxes.withColumns({x: F.col(x) + 1 for x in BOX})
    top = nodes.where("root_id = 0 and depth = 1 and path = 2").select("root_id", "node_id")
    got = {r.path: r.minx for r in index.refit(nodes, order, moved, top).where("root_id = 0").collect()}
    for n in nodes.where("root_id = 0").collect():
        below = n.path >> (n.depth - 1) == 2 if n.depth else False
        if n.depth:
            assert got[n.path] == (n.minx + 1 if below else n.minx)


def test_a_leaf_without_its_boxes_keeps_its_bounds(boxes):
    nodes, order = index.build_nodes(boxes)
    names = ["root_id", "node_id", *BOX]
    assert rows(index.refit(nodes, order, boxes.limit(0)), *names) == rows(nodes, *names)


def test_plans_compare_no_ranges(boxes, capsys):
    nodes, order = index.build_nodes(boxes)
    index.refit(nodes, order, boxes, nodes.where("is_leaf and node_id % 7 = 0")).explain()
    index.traverse(nodes, enter=F.col("maxx") > 0.5).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "FlatMapGroups" not in plan


def test_searches_use_the_stored_nodes(spark, data, tmp_path):
    """A leaf whose stored bounds are emptied is not entered: the hierarchy comes from the rows."""
    t = fx.triangles(spark, data)
    nodes, order = index.build_nodes(fx.aabbs(spark, data).withColumn("root_id", F.lit(0)), leaf_size=200)
    geometry.write_index(nodes, order, str(tmp_path / "index"))
    nodes, order = geometry.read_index(spark, str(tmp_path / "index"))
    leaf = nodes.where("is_leaf").orderBy("node_id").first()
    inside = {r.box_id for r in order.where((F.col("slot") >= leaf.offset) & (F.col("slot") < leaf.offset + leaf["count"])).collect()}
    shut = nodes.withColumns({x: F.when(F.col("node_id") == leaf.node_id, F.lit(float("nan"))).otherwise(F.col(x)) for x in BOX})
    whole, part = (stored.raycast(fx.rays(spark, data), n, order, t, most=600).select("ray_id", "tri_id").collect() for n in (nodes, shut))
    assert sorted(whole) == sorted(rays.raycast(fx.rays(spark, data), t).select("ray_id", "tri_id").collect())
    assert sorted(part) == sorted(r for r in whole if r.tri_id not in inside) and len(part) < len(whole)


def test_old_files_get_paths(spark, boxes, tmp_path):
    nodes, order = index.build_nodes(boxes)
    nodes.drop("path").write.parquet(str(tmp_path / "old" / "nodes"))
    order.write.parquet(str(tmp_path / "old" / "order"))
    read = geometry.read_index(spark, str(tmp_path / "old"))[0]
    assert rows(read, "root_id", "node_id", "path") == rows(nodes, "root_id", "node_id", "path")


def test_first_hits_enter_few_tiles(spark, data, monkeypatch):
    """Rows sent from front to back, against those of all tiles on the lines."""
    t = fx.triangles(spark, data)
    held, tiles = rays.tiled(t, 50)
    sent, next_tiles = [], rays._next_tiles

    def counted(*args):
        out = next_tiles(*args)
        sent.append(out.count())
        return out

    monkeypatch.setattr(rays, "_next_tiles", counted)
    r = fx.rays(spark, data)
    got = rays.in_tiles(r, held.select("tile", "tri_id", *rays.TRIANGLE), tiles, rays.grown, "double", True, None)
    assert rows(got, "ray_id", "tri_id") == rows(rays.raycast(r, t, first=True), "ray_id", "tri_id")
    every = rays.sent_to_tiles(r, tiles).count()
    print(f"front to back {sum(sent)} rows, all tiles {every}")
    assert sum(sent) < 0.6 * every


def test_descent_equals_the_cell_join(spark, boxes):
    nodes, order = index.build_nodes(boxes, leaf_size=40)
    ranges = descent.range_pairs(nodes, nodes)
    got = set()
    slot = {(r.root_id, r.slot): r.box_id for r in order.collect()}
    for r in ranges.collect():
        got |= {(slot[r.a_root_id, i], slot[r.b_root_id, j]) for i in range(r.a_offset, r.a_offset + r.a_count) for j in range(r.b_offset, r.b_offset + r.b_count)}
    assert {(r.a_id, r.b_id) for r in pairs.box_pairs(boxes, boxes, strategy="cells").collect()} <= got
    far = descent.range_pairs(nodes, nodes, matrix=[1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 100.0, 0, 0, 1.0])
    assert not far.count()


def test_scene_rays_meet_tiles_of_large_geometries(spark, data, monkeypatch):
    instances, tris, r = catalogue._instances(spark), catalogue._geometry_tris(spark, data), fx.rays(spark, data)
    names = ["ray_id", "object_id", "instance_id", "tri_id"]
    for first in (None, "scene"):
        want = rows(scene.raycast_scene(r, instances, tris, first=first), *names)
        with monkeypatch.context() as m:
            m.setattr(scene, "_local_hits", partial(scene._local_hits, tile_rows=200))
            assert rows(scene.raycast_scene(r, instances, tris, first=first), *names) == want


def test_a_track_along_a_diagonal_is_cut_into_small_tiles(spark):
    """All axes go together, with a few outliers: tiles stay small."""
    at = spark.range(200_000).selectExpr("id", "case when id % 50000 = 0 then 1e9 else id / 1e3 end as p")
    boxes = at.select("id", *(F.col("p").alias(x) for x in BOX))
    sizes = [r[0] for r in rays.tiled_boxes(boxes, 50)[0].groupBy("tile").count().select("count").collect()]
    assert sum(sizes) == 200_000 and sum(n for n in sizes if n < 150) > 190_000  # 1,024 codes would leave 195 in a tile
