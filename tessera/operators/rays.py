"""Ray joins: all hits and first hit on triangles, threshold hits on points and segments.

Rays: ray_id, ox..oz, dx..dz. Every strategy gives the same rows:

nested  the broadcast side is checked for size; tests run in generated code
tree    triangles up to TREE_ROWS go into one packed hierarchy, sent to all
        tasks; rays stream past it in Arrow batches
tiles   triangles are cut into tiles by a space-filling order, each with its
        own hierarchy; rays go to the tiles whose bounds they meet: to all of
        them for all hits, from front to back for the first one
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import bounds, exact, kernels
from ..functions.staged import apply, matching
from ..functions.vectors import AXES, vec
from ..plans import strategy as plan
from ..plans.durable import cut
from ..plans.tree import Found, Tree, build, search

TRIANGLE = [f"{p}{c}" for p in ("a", "vb", "c") for c in AXES]
RAY = [f"{p}{c}" for p in ("o", "d") for c in AXES]
HIT = "ray_id long, tri_id long, t double, distance double, u double, v double"
_HIT = pa.schema([("ray_id", pa.int64()), ("tri_id", pa.int64()), *((n, pa.float64()) for n in ("t", "distance", "u", "v"))])
#: Hits with their rays and the corners of their triangles.
TOLD = HIT + "".join(f", {c} double" for c in (*RAY, *TRIANGLE))
_TOLD = pa.schema([*_HIT, *((c, pa.float64()) for c in (*RAY, *TRIANGLE))])
#: Triangles of a tile, and tiles of a table at most: beyond that many rows tiles are larger.
TILE_ROWS = 50_000
MOST_TILES = 200_000
#: Rays or points that one task takes to a tile: a tile that more of them reach goes to several tasks.
TILE_QUERIES = 50_000
#: Hits that a task holds, about, before it passes them on.
HITS = 100_000


def first_hits(hits: DataFrame, key: str = "ray_id", order: str = "distance", prim: str = "tri_id") -> DataFrame:
    """The nearest hit of each ray; the smallest id wins ties. A partial minimum runs before the shuffle."""
    rest = [c for c in hits.columns if c not in (key, order, prim)]
    return hits.groupBy(key).agg(F.min(F.struct(order, prim, *rest)).alias("hit")).select(key, "hit.*").select(hits.columns)


def raycast(rays: DataFrame, tris: DataFrame, side: str = "double", near: float | None = None, far: float | None = None, first: bool = False, strategy: str = "auto", told: bool = False) -> DataFrame:
    """Hits (ray_id, tri_id, t, distance, u, v) with near <= distance <= far; `first`: the nearest of each ray.

    `told`, for all hits: with the columns of their rays and triangles, as the tasks that find them have them.

    A ray without a hit has no row. Distances are Euclidean, t is in lengths
    of the direction. side: front, back or double. The default is both sides,
    as tables have no materials; pass 'front' for surfaces seen from outside.
    """
    if first and told:
        raise ValueError("first hits are few: join them")
    rays, tris = rays.select("ray_id", *RAY), tris.select("tri_id", *TRIANGLE)
    if strategy == "auto":
        strategy = "tree" if plan.small(tris, 1 << 30) else "tiles"
    if strategy == "nested":
        hits = _nested(rays, tris, side, told)
    elif strategy == "tree":
        hits = _by_tree(rays, tris, side, first and near is None, far, told)
    else:
        hits = _by_tiles(rays, tris, side, first and near is None, far, told)
    if near is not None:
        hits = hits.where(F.col("distance") >= near)
    if far is not None:
        hits = hits.where(F.col("distance") <= far)
    return first_hits(hits) if first else hits


def _nested(rays: DataFrame, tris: DataFrame, side: str, told: bool) -> DataFrame:
    crossed = plan.cross_small(rays, tris)
    if crossed is None:
        raise ValueError("neither side is small enough to broadcast")
    return raycast_pairs(crossed, side, told)


def raycast_pairs(pairs: DataFrame, side: str = "double", told: bool = False) -> DataFrame:
    """HIT for pairs (ray_id, ox..dz, tri_id, ax..cz) that some search has left, tested in generated code."""
    steps, hit, after = exact.ray_triangle(side)
    return apply(matching(pairs, steps, hit), after).select(*(x.split()[0] for x in (TOLD if told else HIT).split(", ")))


def columns(batch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1)


def corners(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return table[:, :3], table[:, 3:6], table[:, 6:9]


def cast(tree: Tree, ids: np.ndarray, tri: np.ndarray, ray_ids: np.ndarray, rays: np.ndarray, side: str, first: bool, far: float | None) -> list[np.ndarray]:
    """Columns of HIT for a batch of rays against one hierarchy; `first` prunes by the best so far."""
    o, d = rays[:, :3], rays[:, 3:]
    norm = np.sqrt(kernels.dot(d, d))
    best = np.full(len(o), np.inf if far is None else far)
    found = Found(4, ids if first else None)

    def keep(q, node):
        t_in, t_out = kernels.ray_box(tree.low[node], tree.high[node], o[q], d[q])
        # Bounds are widened by rounding, so that no hit on a box's face is lost.
        slack = 1e-12 * (1.0 + np.abs(t_in))
        with np.errstate(invalid="ignore"):  # an infinite t of a flat direction: not kept
            return (t_in <= t_out + slack) & (t_out >= -slack) & ((t_in - slack) * norm[q] <= best[q])

    def visit(q, p):
        hit, t, u, v = kernels.ray_triangle(o[q], d[q], *(x[p] for x in corners(tri)), side)
        q, p, t, u, v = q[hit], p[hit], t[hit], u[hit], v[hit]
        gap = (o[q] + d[q] * t[:, None]) - o[q]
        distance = np.sqrt(kernels.dot(gap, gap))
        if first:
            np.minimum.at(best, q, distance)
            near = distance <= best[q]
            q, p, t, distance, u, v = (x[near] for x in (q, p, t, distance, u, v))
        found.add(q, p, distance, t, u, v)

    search(tree, len(o), keep, visit)
    q, p, distance, t, u, v = found.all()
    return [ray_ids[q], ids[p], t, distance, u, v]


def by_slices(table, hits: Callable) -> Iterator[pa.RecordBatch]:
    """hits(slice), a record batch, of slices of a table or batch of queries, each so long that it should give about HITS rows."""
    at, rows = 0, 256
    while at < table.num_rows:
        out = hits(table.slice(at, rows))
        yield out
        at, rows = at + rows, min(TILE_QUERIES, max(1, rows * HITS // max(out.num_rows, HITS // 4)))


def _cast_rows(rays, tree: Tree, ids: np.ndarray, tri: np.ndarray, side: str, first: bool, far, told: bool = False) -> pa.RecordBatch:
    if told:
        ray, known = columns(rays, RAY), rays.column("ray_id").to_numpy()
        q, p, *found = cast(tree, np.arange(len(ids)), tri, np.arange(len(ray)), ray, side, False, far)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (known[q], ids[p], *found, *ray[q].T, *tri[p].T)], schema=_TOLD)
    out = cast(tree, ids, tri, rays.column("ray_id").to_numpy(), columns(rays, RAY), side, first, far)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in out], schema=_HIT)


def _by_tree(rays: DataFrame, tris: DataFrame, side: str, first: bool, far: float | None, told: bool = False) -> DataFrame:
    table = tris.limit(plan.TREE_ROWS + 1).toArrow()
    if table.num_rows > plan.TREE_ROWS:
        return _by_tiles(rays, tris, side, first, far, told)
    tri = columns(table, TRIANGLE)
    ids = table.column("tri_id").to_numpy()
    a, b, c = corners(tri)
    tree = build(np.minimum(np.minimum(a, b), c), np.maximum(np.maximum(a, b), c))
    shipped = rays.sparkSession.sparkContext.broadcast((tree, ids, tri))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, ids, tri = shipped.value
        for batch in batches:
            yield from by_slices(batch, lambda b: _cast_rows(b, tree, ids, tri, side, first, far, told))

    return plan.spread(rays).mapInArrow(run, TOLD if told else HIT)


def tiled(tris: DataFrame, tile_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(triangles with a tile, tiles with bounds), see tiled_boxes."""
    return tiled_boxes(apply(tris, [bounds.of_points([vec("a"), vec("vb"), vec("c")])]), tile_rows)


def tiled_boxes(boxed: DataFrame, tile_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with a tile, tiles with bounds): runs of a Morton order, of about `tile_rows` rows each.

    The order interleaves ranks of the centres along the axes, by quantiles and
    by the place between two of them, so that crowded regions get smaller tiles,
    outliers take no room, and a track along a diagonal has as many codes as any. The
    cuts are fixed values from then on: every later evaluation of the plan puts
    a row into the same tile. There are MOST_TILES tiles at most.
    """
    n = boxed.count()
    if not n:
        return boxed.withColumn("tile", F.lit(0)), boxed.limit(0).selectExpr("0 as tile", "minx", "miny", "minz", "maxx", "maxy", "maxz")
    parts = min(MOST_TILES, max(1, -(-n // (tile_rows or TILE_ROWS))))
    mids = boxed.withColumns({f"mid{c}": F.expr(f"(min{c} + max{c}) / 2e0") for c in AXES})
    edges = [np.unique(x) if x else np.zeros(1) for x in mids.approxQuantile([f"mid{c}" for c in AXES], [i / 1024 for i in range(1025)], 5e-4)] if parts > 1 else [np.zeros(1)] * 3

    def codes(*mid: pa.Array) -> np.ndarray:
        code = np.zeros(len(mid[0]), np.int64)
        for i, (x, at) in enumerate(zip(mid, edges)):
            x = x.to_numpy(zero_copy_only=False)
            rank = np.searchsorted(at[1:-1], x, side="right")
            low, high = at[rank], at[np.minimum(rank + 1, len(at) - 1)]
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                inner = np.clip(np.nan_to_num((x - low) / (high - low) * 1024), 0, 1023)
            rank = rank << 10 | inner.astype(np.int64)
            for bit in range(20):
                code |= (rank >> bit & 1) << (3 * bit + i)
        return code

    @arrow_udf("long")
    def coded(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        return pa.array(codes(x, y, z))

    shares = [i / parts for i in range(1, parts)]
    placed = mids.select(coded(*(f"mid{c}" for c in AXES)).alias("code"))
    cuts = np.unique(placed.approxQuantile("code", shares, min(0.01, 0.25 / parts))) if shares else np.zeros(0)

    @arrow_udf("int")
    def tile(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, codes(x, y, z), side="right").astype(np.int32))

    held = mids.withColumn("tile", tile(*(f"mid{c}" for c in AXES))).drop(*(f"mid{c}" for c in AXES))
    return held, held.groupBy("tile").agg(*(F.expr(x).alias(n) for n, x in bounds.union_of().items()))


class TileTree:
    """A hierarchy over the bounds of tiles (MOST_TILES rows at most), held by the driver and sent to all tasks."""

    def __init__(self, tiles: DataFrame):
        table = tiles.toArrow()
        self.ids = table.column("tile").to_numpy()
        low, high = (np.stack([table.column(f"{f}{c}").to_numpy() for c in AXES], 1).reshape(-1, 3) for f in ("min", "max"))
        self.low, self.high, self.tree = low, high, build(low, high)

    def met(self, rays: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ray, tile, t) of the rays (rows of RAY) that meet a tile's bounds, and where they enter."""
        o, d, found = rays[:, :3], rays[:, 3:], []

        def test(q, low, high):
            t_in, t_out = kernels.ray_box(low, high, o[q], d[q])
            slack = 1e-12 * (1.0 + np.abs(t_in))
            with np.errstate(invalid="ignore"):
                return (t_in <= t_out + slack) & (t_out >= -slack), np.maximum(t_in - slack, 0)

        def visit(q, p):
            on, enters = test(q, self.low[p], self.high[p])
            found.append((q[on], self.ids[p[on]], enters[on]))

        search(self.tree, len(o), lambda q, node: test(q, self.tree.low[node], self.tree.high[node])[0], visit)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))


def sent_to_tiles(rays: DataFrame, tiles: DataFrame) -> DataFrame:
    """(tile, ray_id, ox..dz): each ray with the tiles whose bounds it meets."""
    shipped = rays.sparkSession.sparkContext.broadcast(TileTree(tiles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, tile, _ = shipped.value.met(columns(batch, RAY))
            yield pa.RecordBatch.from_arrays([pa.array(tile, pa.int32()), *(batch.column(c).take(pa.array(q)) for c in ("ray_id", *RAY))], names=["tile", "ray_id", *RAY])

    return plan.spread(rays.select("ray_id", *RAY)).mapInArrow(run, "tile int, ray_id long, " + ", ".join(f"{c} double" for c in RAY))


Read = Callable[[pa.Table], tuple[Tree, np.ndarray, np.ndarray]]


def grown(table: pa.Table) -> tuple[Tree, np.ndarray, np.ndarray]:
    """(hierarchy, ids, corners) of a tile's triangles, built by its task."""
    tri = columns(table, TRIANGLE)
    a, b, c = corners(tri)
    return build(np.minimum(np.minimum(a, b), c), np.maximum(np.maximum(a, b), c)), table.column("tri_id").to_numpy(), tri


def _by_tiles(rays: DataFrame, tris: DataFrame, side: str, first: bool, far: float | None, told: bool = False) -> DataFrame:
    held, tiles = tiled(tris)
    return in_tiles(rays, held.select("tile", "tri_id", *TRIANGLE), tiles, grown, side, first, far, told)


def in_tiles(rays: DataFrame, held: DataFrame, tiles: DataFrame, read: Read, side: str, first: bool, far: float | None, told: bool = False) -> DataFrame:
    """Hits of rays in tiles (tile, minx..maxz) whose rows (tile, ...) `read` makes a hierarchy of; `first`: the nearest of each ray."""

    def run(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        tree, ids, tri = read(right)
        yield from by_slices(left, lambda b: _cast_rows(b, tree, ids, tri, side, first, b.column("best").to_numpy() if first else far, told))

    def meet(sent: DataFrame) -> DataFrame:
        return plan.streamed(*plan.dealt(sent, held, ["tile"], TILE_QUERIES), ["tile", "part"], run, TOLD if told else HIT)

    if not first:
        return meet(sent_to_tiles(rays, tiles))
    held = cut(held)  # read in every round: what derives it, as a refit and its joins, runs once
    return front_to_back(rays, tiles, meet, far, "tri_id")


def front_to_back(rays: DataFrame, tiles: DataFrame, meet: Callable[[DataFrame], DataFrame], far: float | None, prim: str) -> DataFrame:
    """The nearest hit of each ray, the smallest `prim` of equal ones: meet gives the hits of rows (tile, ray_id, ox..dz, best), which go to tiles in rounds."""
    shipped = rays.sparkSession.sparkContext.broadcast(TileTree(tiles))
    far = float("inf") if far is None else far
    todo, best, low, width = rays.select("ray_id", *RAY).withColumn("best", F.lit(far)), None, 0, 1
    while True:
        sent = cut(_next_tiles(todo, shipped, low, low + width))
        if sent.isEmpty():
            return best if best is not None else meet(sent)
        hits = meet(sent)
        best = cut(first_hits(hits if best is None else best.unionByName(hits), prim=prim))
        asked = sent.select("ray_id", *RAY).distinct()
        bound = best.select(F.col("ray_id").alias("of_ray"), F.col("distance").alias("so_far"))
        todo = asked.join(bound, asked["ray_id"] == bound["of_ray"], "left").select("ray_id", *RAY, F.least(F.coalesce("so_far", F.lit(far)), F.lit(far)).alias("best"))
        low, width = low + width, width * 2


def _next_tiles(rays: DataFrame, shipped, low: int, high: int) -> DataFrame:
    """(tile, ray_id, ox..dz, best): the tiles that a ray enters as number low to high - 1, those alone that it enters no farther than its best hit.

    A ray that gets none has its first hit: it would enter all others farther away.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ray, best = columns(batch, RAY), batch.column("best").to_numpy()
            q, tile, enters = shipped.value.met(ray)
            order = np.lexsort((tile, enters, q))
            q, tile, enters = q[order], tile[order], enters[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            on = (rank >= low) & (rank < high) & (enters * np.sqrt(kernels.dot(ray[q, 3:], ray[q, 3:])) * (1 - 1e-12) <= best[q])
            q, tile = pa.array(q[on]), pa.array(tile[on], pa.int32())
            yield pa.RecordBatch.from_arrays([tile, *(batch.column(c).take(q) for c in ("ray_id", *RAY, "best"))], names=["tile", "ray_id", *RAY, "best"])

    return plan.spread(rays).mapInArrow(run, "tile int, ray_id long, " + ", ".join(f"{c} double" for c in (*RAY, "best")))


def ray_box_pairs(rays: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(ray_id, ox..dz, keys): rays with the boxes (keys, minx..maxz) they meet."""
    rays, boxes = rays.select("ray_id", *RAY), boxes.select(*keys, *(f"{f}{c}" for f in ("min", "max") for c in AXES))
    crossed = plan.cross_small(rays, boxes) if plan._rows(rays) * plan._rows(boxes) <= plan.NESTED_PAIRS else None
    if crossed is not None:
        return matching(crossed, bounds.ray_interval("", vec("o"), vec("d")), bounds.ray_hits()).select("ray_id", *RAY, *keys)
    held, tiles = tiled_boxes(boxes)
    kinds = dict(boxes.dtypes)
    ddl = "ray_id long, " + ", ".join(f"{c} double" for c in RAY) + "".join(f", {k} {kinds[k]}" for k in keys)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        told = right.select(["minx", "miny", "minz", "maxx", "maxy", "maxz"]).append_column("tile", pa.array(np.arange(right.num_rows)))
        q, p, _ = TileTree(_Held(told)).met(columns(left, RAY)) if left.num_rows and right.num_rows else (np.zeros(0, np.int64),) * 3
        return pa.Table.from_arrays([*(left.column(c).take(pa.array(q)) for c in ("ray_id", *RAY)), *(right.column(k).take(pa.array(p)) for k in keys)], names=["ray_id", *RAY, *keys])

    sent, held = plan.dealt(sent_to_tiles(rays, tiles), held, ["tile"], TILE_QUERIES)
    return sent.groupBy("tile", "part").cogroup(held.groupBy("tile", "part")).applyInArrow(run, ddl)


class _Held:
    """A table that a task has, where a DataFrame would be collected."""

    def __init__(self, table: pa.Table):
        self.table = table

    def toArrow(self) -> pa.Table:
        return self.table


def decorate(hits: DataFrame, rays: DataFrame, tris: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """hits with the point, weights, normal, the face's normal turned to the ray, and material_index (of the first group that covers it, else 0).

    Hits that raycast has told, with the columns of their rays and triangles, are joined with neither.
    """
    full = hits
    if not {*RAY, *TRIANGLE} <= set(hits.columns):
        full = hits.join(rays.select("ray_id", *RAY), "ray_id").join(tris.select("tri_id", *TRIANGLE), "tri_id")
    from ..functions.vectors import add, cross, dot, length, named, scale, sub

    steps = [
        {"w": "1e0 - u - v"} | named("p", add(vec("o"), scale(vec("d"), "t"))) | named("n", cross(sub(vec("vb"), vec("a")), sub(vec("c"), vec("a")))),
        {"n_length": length(vec("n"))},
        named("unit", tuple(f"{x} / nullif(n_length, 0e0)" for x in vec("n"))),
        {"facing": dot(vec("unit"), vec("d"))},
        named("face", tuple(f"case when facing > 0e0 then -{x} else {x} end" for x in vec("unit"))),
    ]
    own = hits.columns if full is not hits else [c for c in hits.columns if c not in (*RAY, *TRIANGLE)]
    out = apply(full, steps).select(*own, "w", *vec("p"), *vec("unit"), *vec("face"))
    return out.withColumn("material_index", F.lit(0) if groups is None else _material(groups)(F.col("tri_id")))


def _material(groups: DataFrame) -> Callable:
    """A function of triangles' ids: the material of the first of the groups (start, count, material_index) that covers one, the least of equal ones, else 0."""
    rows = sorted(tuple(r) for r in plan.bounded(groups.select(F.col("start").cast("long"), F.coalesce("material_index", F.lit(0)).cast("int"), F.col("count").cast("long"))).collect() if r[0] is not None and (r[2] or 0) > 0)
    edges = np.unique([x for start, _, count in rows for x in (start, start + count)]).astype(np.int64)
    of = np.zeros(len(edges) + 1, np.int32)
    # From one edge to the next one group is the first: of those that have begun and not ended, the one on top.
    begun, at = [], 0
    for i, edge in enumerate(edges.tolist()):
        while at < len(rows) and rows[at][0] <= edge:
            heapq.heappush(begun, (rows[at][:2], rows[at][0] + rows[at][2]))
            at += 1
        while begun and begun[0][1] <= edge:
            heapq.heappop(begun)
        of[i + 1] = begun[0][0][1] if begun else 0

    @arrow_udf("int")
    def material(ids: pa.Array) -> pa.Array:
        return pa.array(of[np.searchsorted(edges, ids.to_numpy(zero_copy_only=False), side="right")])

    return material


def camera_rays(pixels: DataFrame, inverse_projection: list[float], world: list[float]) -> DataFrame:
    """Rays (ray_id, ox..dz) through pixels (ray_id, x, y in -1..1): near and far points unprojected, then placed in the world."""
    from ..functions.vectors import affine, sub

    f = lambda m: [f"cast({float(x)!r} as double)" for x in m]
    m, w = f(inverse_projection), f(world)
    steps = []
    for name, z in (("n", "-1e0"), ("f", "1e0")):
        point = ("x", "y", z)
        steps.append(dict(zip(vec(f"{name}p"), affine(m, point))) | {f"{name}w": f"({m[3]} * x + {m[7]} * y + {m[11]} * {z} + {m[15]})"})
    merged = steps[0] | steps[1]
    near, far = (tuple(f"({c} / nullif({n}w, 0e0))" for c in vec(f"{n}p")) for n in ("n", "f"))
    placed = dict(zip(vec("o"), affine(w, near))) | dict(zip(vec("e"), affine(w, far)))
    out = apply(pixels.select("ray_id", "x", "y"), [merged, placed, dict(zip(vec("d"), sub(vec("e"), vec("o"))))])
    return out.select("ray_id", *RAY)


def interpolate(hits: DataFrame, attributes: DataFrame, names: list[str]) -> DataFrame:
    """Values at the hits of attributes (tri_id, name_a, name_b, name_c), weighted by w, u, v; null where absent."""
    joined = hits.join(attributes, "tri_id", "left")
    return joined.withColumns({n: F.expr(f"w * {n}_a + u * {n}_b + v * {n}_c") for n in names}).select(*hits.columns, *names)


def _threshold_hits(rays: DataFrame, prims: DataFrame, prim: str, ends: list[str], threshold: float, exact_test, strict: bool) -> DataFrame:
    """Hits within a threshold, with primitives in one hierarchy per task or, if they are many, per tile."""
    names = ["ray_id", prim, "t", "s", "distance"]
    schema = pa.schema([(names[0], pa.int64()), (prim, pa.int64()), *((n, pa.float64()) for n in names[2:])])
    ddl = f"ray_id long, {prim} long, t double, s double, distance double"

    def against(table):
        shape = columns(table, ends)
        first, last = shape[:, :3], shape[:, -3:]
        ids = table.column(prim).to_numpy()
        # Boxes are widened by the threshold and a little, as rounding may favour a hit at its edge.
        wide = threshold * (1 + 1e-9) + 1e-300
        return ids, first, last, build(np.minimum(first, last) - wide, np.maximum(first, last) + wide)

    def hits(index, batch) -> pa.RecordBatch:
        ids, first, last, tree = index
        ray = columns(batch, RAY)
        o, d = ray[:, :3], ray[:, 3:]
        found = Found(2)

        def keep(q, node):
            t_in, t_out = kernels.ray_box(tree.low[node], tree.high[node], o[q], d[q])
            slack = 1e-12 * (1.0 + np.abs(t_in))
            return (t_in <= t_out + slack) & (t_out >= -slack)

        def visit(q, p):
            gap2, t, at = exact_test(o[q], d[q], first[p], last[p])
            near = gap2 < threshold * threshold if strict else gap2 <= threshold * threshold
            found.add(*(x[near] for x in (q, p, t, at)))

        search(tree, len(o), keep, visit)
        q, p, t, at = found.all()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (batch.column("ray_id").to_numpy()[q], ids[p], t, at, t * np.sqrt(kernels.dot(d[q], d[q])))], schema=schema)

    rays, prims = rays.select("ray_id", *RAY), prims.select(prim, *ends)
    table = prims.limit(plan.TREE_ROWS + 1).toArrow() if plan.small(prims, 1 << 30) else None
    if table is not None and table.num_rows <= plan.TREE_ROWS:
        shipped = rays.sparkSession.sparkContext.broadcast(against(table))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from by_slices(batch, lambda b: hits(shipped.value, b))

        return plan.spread(rays).mapInArrow(run, ddl)

    box = {f"{n}{c}": f"{f}({', '.join(x for x in ends if x[-1] == c or x[0] == c)}) {s} cast({threshold!r} as double)" for n, f, s in (("min", "least" if len(ends) > 3 else "", "-"), ("max", "greatest" if len(ends) > 3 else "", "+")) for c in AXES}
    boxed, tiles = tiled_boxes(apply(prims, [box]))

    def run_tile(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        index = against(right)
        yield from by_slices(left, lambda b: hits(index, b))

    sent, held = plan.dealt(sent_to_tiles(rays, tiles), boxed.select("tile", prim, *ends), ["tile"], TILE_QUERIES)
    return plan.streamed(sent, held, ["tile", "part"], run_tile, ddl)


def raycast_points(rays: DataFrame, points: DataFrame, threshold: float, first: bool = False) -> DataFrame:
    """Hits (ray_id, point_id, t, distance) on points (point_id, px..pz) nearer to the ray than the threshold (strict)."""

    def test(o, d, p, _):
        gap2, t = kernels.ray_point(o, d, p)
        return gap2, t, t

    hits = _threshold_hits(rays, points, "point_id", list(vec("p")), threshold, test, True).drop("s")
    return first_hits(hits, prim="point_id") if first else hits


def raycast_segments(rays: DataFrame, segments: DataFrame, threshold: float, first: bool = False) -> DataFrame:
    """Hits (ray_id, seg_id, t, s, distance) on segments (seg_id, x0..z1) within the threshold (inclusive); s is where on the segment."""
    hits = _threshold_hits(rays, segments, "seg_id", ["x0", "y0", "z0", "x1", "y1", "z1"], threshold, kernels.ray_segment, False)
    return first_hits(hits, prim="seg_id") if first else hits
