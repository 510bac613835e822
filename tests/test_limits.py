"""Limits of queries and of the memory that searches take."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tessera import catalogue, catalogue_hierarchies
from tessera.operators import index, nearest, pairs, primitives, rays, regions, stored
from tessera.plans import strategy
from tessera.plans.tree import PAIRS, Found, build, search
from tessera.sources import fixtures as fx


def test_a_distance_that_rounds_to_the_limit_counts(spark, tmp_path):
    """A box 0.2000003 from a point: its distance to six places is 0.2."""
    row = [0.0] * 64
    row[57:60] = [0.3100003, -0.2, 0.05]
    pq.write_table(pa.table({"vec_id": pa.array([1], pa.int64()), "embedding": pa.array([row], pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    found = catalogue.QUERIES["obb_point_distance"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [(1, 1, 0.2)]


def test_searches_hold_a_bounded_number_of_pairs():
    """However many primitives a query reaches, a test gets a bounded number, and of hits that lose nothing stays."""
    low = np.random.default_rng(1).normal(size=(5000, 3))
    tree = build(low, low + 1.0)
    most, pairs = [], 0

    def visit(q, p):
        nonlocal pairs
        most.append(len(q))
        pairs += len(q)

    search(tree, 100, lambda q, node: np.ones(len(q), bool), visit)
    assert pairs == 500_000 and max(most) <= PAIRS
    found = Found(1, np.arange(10)[::-1], 20)
    for d in (3.0, 1.0, 2.0, 1.0):
        for p in range(10):
            found.add(np.arange(4), np.full(4, p), np.full(4, d))
    assert found.held <= 30
    q, p, d = found.all()
    assert q.tolist() == [0, 1, 2, 3] and p.tolist() == [9] * 4 and d.tolist() == [1.0] * 4


def test_many_hits_leave_in_several_batches(spark):
    """All hits of a tile's rays come batch by batch, and are those of one batch."""
    batch = pa.RecordBatch.from_pydict({"n": list(range(3000))})
    out = list(rays.by_slices(batch, lambda b: pa.RecordBatch.from_pydict({"n": np.repeat(b.column("n").to_numpy(), 1000)})))
    assert max(b.num_rows for b in out) < 300_000 and sum(b.num_rows for b in out) == 3_000_000
    left, right = spark.range(4).selectExpr("id % 2 as k", "id as a"), spark.range(6).selectExpr("id % 3 as k", "id as b")

    def both(l: pa.Table, r: pa.Table):
        for a in l.column("a").to_pylist():
            yield pa.RecordBatch.from_pydict({"a": [a] * r.num_rows, "b": r.column("b").to_pylist()})

    got = strategy.streamed(left, right, ["k"], both, "a long, b long").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (0, 3), (1, 1), (1, 4), (2, 0), (2, 3), (3, 1), (3, 4)]


def test_all_pairs_of_two_large_tables(spark, monkeypatch):
    """Where neither side may be sent to all tasks, or the estimate says so, there is still a result."""
    lines = spark.range(20).selectExpr("id as seg_id", "id * 1e0 as x0", "id * id * 1e0 as y0", "0e0 as z0", "id + 1e0 as x1", "1e0 as y1", "id * 2e0 as z1")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    want = key(pairs.line_distances(lines, lines))
    assert len(want) == 400
    monkeypatch.setattr(strategy, "BROADCAST_BYTES", 0)
    assert key(pairs.line_distances(lines, lines)) == want
    boxes = spark.range(50).selectExpr("cast(id % 2 as int) as root_id", "id as box_id", *(f"id * 1e0 as min{c}" for c in "xyz"), *(f"id + 1e0 as max{c}" for c in "xyz"))
    monkeypatch.setattr(strategy, "spread", lambda df: df)
    nodes, order = index.build_nodes(boxes, leaf_size=5)
    met = stored.shapecast(spark.range(3).select(F.col("id").alias("q")), nodes, order, boxes, "box_id", F.expr("case when minx <= q * 10 and maxx >= q * 10 then 1 else 0 end"), F.expr("minx <= q * 10 and maxx >= q * 10"))
    assert sorted((r.q, r.box_id) for r in met.collect()) == [(0, 0), (1, 9), (1, 10), (2, 19), (2, 20)]


def test_estimates_of_any_length(spark):
    """Joins of tables of unknown size multiply their estimates: to more digits than Python reads."""
    df = spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a0 long")
    for n in range(8):
        df = df.crossJoin(df.toDF(*(f"b{n}_{i}" for i in range(len(df.columns)))))
    assert strategy.spread(df) is df


def test_first_hits_derive_their_tiles_once(spark, data):
    """Rounds from front to back read what is in the tiles, and don't compute it anew."""
    held, tiles = rays.tiled(fx.triangles(spark, data).where("tri_id < 700"), 50)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    held = held.select("tile", "tri_id", *rays.TRIANGLE)
    told = held.mapInArrow(counted, held.schema)
    found = rays.in_tiles(fx.rays(spark, data), told, tiles, rays.grown, "double", True, None).collect()
    assert seen.value == 700
    want = rays.raycast(fx.rays(spark, data), held, first=True, strategy="nested").select("ray_id", "tri_id").collect()
    assert sorted((r.ray_id, r.tri_id) for r in found) == sorted(map(tuple, want))


def test_a_search_takes_little_memory(spark):
    """What a task holds beside its queries: a tile, its hierarchy, and what the pairs tested at once take."""
    rng = np.random.default_rng(2)
    at = rng.normal(size=(rays.TILE_ROWS, 3))
    tri = np.concatenate([at, at + 0.3 * rng.normal(size=at.shape), at + 0.3 * rng.normal(size=at.shape)], 1)
    table = pa.table({"tri_id": np.arange(len(tri)), **{n: x for n, x in zip(rays.TRIANGLE, tri.T)}})
    origin = rng.normal(size=(400, 3)) * 5
    peaks = {}
    for name, run in (
        ("first", lambda t: rays.cast(*t, np.arange(400), np.concatenate([origin, -origin], 1), "double", True, None)),
        ("nearest", lambda t: nearest.nearest_in_tree(*t, origin, np.full(400, np.inf))),
    ):
        tracemalloc.start()
        assert len(run(rays.grown(table))[0]) > 300
        peaks[name] = tracemalloc.get_traced_memory()[1] >> 20
        tracemalloc.stop()
    assert max(peaks.values()) < 20, peaks


def test_a_walk_stores_no_frontier(spark, data, monkeypatch):
    """Nodes that all tasks may have are walked there: pairs of queries and nodes are not stored; nodes of any size give the same rows."""
    b = fx.aabbs(spark, data).where("box_id < 700").withColumn("root_id", F.expr("cast(box_id % 2 as int)"))
    nodes, order = index.build_nodes(b, leaf_size=8)
    state = F.expr("case when px - minx >= 0 and px - maxx >= 0 then 2 when px >= minx then 1 else 0 end")
    points = fx.query_points(spark, data).limit(40).select("query_id", "px").coalesce(1)
    cast = lambda: stored.shapecast(points, nodes, order, b.selectExpr("box_id", "minx as low"), "box_id", state, F.expr("low <= px"))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    cuts, cut = [], stored.cut
    monkeypatch.setattr(stored, "cut", lambda df: cuts.append(df.columns) or cut(df))
    got = key(cast())
    assert {r.contained for r in cast().select("contained").distinct().collect()} == {True, False}
    assert not any("query_id" in c for c in cuts)
    want = points.join(b.selectExpr("box_id", "minx as low"), F.expr("low <= px")).select("query_id", "box_id")
    assert sorted(r[:1] + r[2:3] for r in got) == key(want)
    monkeypatch.setattr(strategy, "BROADCAST_BYTES", 0)
    assert key(cast()) == got


def test_bounds_of_turned_boxes_are_no_expressions(spark, data):
    """The optimizer sees none of the corners of turned boxes, whose bounds are what expressions make of them; a box whose matrix has no inverse meets nothing."""
    from tessera.functions.staged import apply

    b = fx.boxes(spark, data).withColumn("inverse", F.expr("transform(array(8e-1, -6e-1, 0e0, 0e0, 6e-1, 8e-1, 1e-1, 0e0, 0e0, 2e-1, 1e0 + box_id % 3, 0e0, 1e-1, -2e-1, 5e-2, 1e0), x -> if(box_id = 3, 0e0, x))"))
    found = regions.oriented_box_overlaps(b, fx.aabbs(spark, data).withColumnRenamed("box_id", "other_id"))
    assert "a_k0x" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert not found.where("box_id = 3").count()
    got = regions.in_world(b, "a_")
    want = apply(got.select("box_id", *regions.BOX, "world"), regions.placed_box("world", "w_"))
    both = got.join(want, "box_id").select("box_id", *(f"a_{x}" for x in regions.BOX), *(f"w_{x}" for x in regions.BOX)).collect()
    assert len(both) == b.count() and all(r[1:7] == r[7:13] for r in both)
    assert [r.box_id for r in both if r.a_minx is None] == [3]


def test_a_walk_of_rays_joins_no_pairs(spark, data):
    """What rays meet on their walk comes with its corners: above the blocks of slots there is no join by the triangle's id."""
    plan = catalogue_hierarchies.ray_by_shapecast(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate explode(held")]
    assert "Join" not in above


def test_hits_are_decorated_where_they_are_found(spark, data, monkeypatch):
    """Told hits need no join, and have the columns of joined ones by any strategy; materials of overlapping groups are those of the first."""
    r, t = fx.rays(spark, data), fx.triangles(spark, data)
    groups = spark.createDataFrame([(100, 1000, 7), (100, 500, 2), (50, 2000, 3), (60, 5, 9), (3000, 0, 4), (2050, 10, None), (2055, 400, 6)], "start long, count long, material_index int")
    rows = groups.fillna(0).collect()
    want = None
    for strategy_ in ("nested", "tree", "tiles"):
        monkeypatch.setattr(rays, "TILE_ROWS", 500)
        hits = rays.raycast(r, t, strategy=strategy_)
        told = rays.decorate(rays.raycast(r, t, strategy=strategy_, told=True), r, t, groups)
        if strategy_ == "tree":
            assert "Join" not in told._jdf.queryExecution().optimizedPlan().toString()
        got = {(x.ray_id, x.tri_id): x for x in told.collect()}
        joined = {(x.ray_id, x.tri_id): x for x in rays.decorate(hits, r, t, groups).collect()}
        assert got == joined and len(got) > 1000
        want = want or got
        assert set(got) == set(want)
    for (_, tri), x in want.items():
        over = [(g.start, g.material_index) for g in rows if g.start <= tri < g.start + g["count"]]
        assert x.material_index == (min(over)[1] if over else 0)


def test_first_hits_of_own_kinds_go_from_front_to_back(spark, data):
    """Rays don't go to tiles behind their first hit: of shapes that all hits test, first ones test a part, with the rows of one hierarchy."""
    disc, tested = catalogue_hierarchies.DISC, spark.sparkContext.accumulator(0)

    def counted(o, d, shapes):
        tested.add(len(o))
        return disc.ray(o, d, shapes)

    r, s = fx.rays(spark, data), catalogue_hierarchies._discs(spark, data)
    kind = primitives.Kind(disc.key, disc.columns, disc.bounds, counted, disc.distance)
    primitives.raycast(r, s, kind, strategy="tiles", tile_rows=20).count()
    whole = tested.value
    got = sorted(map(tuple, primitives.raycast(r, s, kind, first=True, strategy="tiles", tile_rows=20).collect()))
    assert got == sorted(map(tuple, primitives.raycast(r, s, disc, first=True).collect())) and len(got) > 100
    assert tested.value - whole < 0.8 * whole
