"""Primitives of one's own: bounds and exact tests of a kind of shape, used by every strategy.

A kind tells which columns a shape has, the bounds of a batch of shapes, and,
for what is to be asked, where a ray meets one or how far a point is from one. Hierarchies,
tiles, first hits and nearest shapes then work as they do for triangles; `boxed`
gives the boxes for operators.index and pairs.box_pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import kernels
from ..functions.vectors import vec
from ..plans import strategy as plan
from ..plans.durable import cut
from ..plans.tree import Found, build, search
from . import nearest
from .rays import RAY, TILE_QUERIES, TileTree, by_slices, columns, first_hits, front_to_back, sent_to_tiles, tiled_boxes
from .regions import BOX


@dataclass(frozen=True)
class Kind:
    """A kind of shape: its id and columns (numbers), and functions of batches.

    bounds(shapes) -> (low, high), n x 3 each. ray(o, d, shapes) -> (hit, t) of rows
    of rays and shapes. distance(p, shapes) -> distances of rows of points and
    shapes; a shape lies within its bounds.
    """

    key: str
    columns: tuple[str, ...]
    bounds: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
    ray: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None
    distance: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None


def boxed(shapes: DataFrame, kind: Kind) -> DataFrame:
    """(key, columns, minx..maxz)."""
    names = [kind.key, *kind.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = kind.bounds(columns(batch, list(kind.columns)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(x) for x in (*low.T, *high.T))], names=[*names, *BOX])

    kinds = dict(shapes.dtypes)
    return shapes.select(*names).mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names) + "".join(f", {x} double" for x in BOX))


class Held:
    """Shapes of a task, or of all tasks, under one hierarchy."""

    def __init__(self, table: pa.Table, kind: Kind):
        self.ids, self.shapes = table.column(kind.key).to_numpy(), columns(table, list(kind.columns))
        self.tree = build(*kind.bounds(self.shapes))


def _ray_hits(held: Held, kind: Kind, batch) -> list[np.ndarray]:
    ray, tree, found = columns(batch, RAY), held.tree, Found(1)
    o, d = ray[:, :3], ray[:, 3:]

    def keep(q, node):
        t_in, t_out = kernels.ray_box(tree.low[node], tree.high[node], o[q], d[q])
        slack = 1e-12 * (1.0 + np.abs(t_in))
        return (t_in <= t_out + slack) & (t_out >= -slack)

    def visit(q, p):
        hit, t = kind.ray(o[q], d[q], held.shapes[p])
        found.add(q[hit], p[hit], t[hit])

    search(tree, len(o), keep, visit)
    q, p, t = found.all()
    return [batch.column("ray_id").to_numpy()[q], held.ids[p], t, t * np.sqrt(kernels.dot(d[q], d[q]))]


def raycast(rays: DataFrame, shapes: DataFrame, kind: Kind, first: bool = False, strategy: str = "auto", tile_rows: int | None = None) -> DataFrame:
    """(ray_id, key, t, distance) of rays and the shapes they meet; `first`: the nearest of each ray, the smallest id of equal ones."""
    ddl = f"ray_id long, {kind.key} long, t double, distance double"
    names = [x.split()[0] for x in ddl.split(", ")]
    rows = shapes.select(F.col(kind.key).cast("long").alias(kind.key), *kind.columns)
    rays = rays.select("ray_id", *RAY)
    table = rows.limit(plan.TREE_ROWS + 1).toArrow() if strategy != "tiles" and plan.small(rows, 1 << 30) else None
    if table is not None and table.num_rows <= plan.TREE_ROWS:
        shipped = rays.sparkSession.sparkContext.broadcast(Held(table, kind))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from by_slices(batch, lambda b: pa.RecordBatch.from_arrays([pa.array(x) for x in _ray_hits(shipped.value, kind, b)], names=names))

        hits = plan.spread(rays).mapInArrow(run, ddl)
    else:
        at, tiles = tiled_boxes(boxed(rows, kind), tile_rows)

        def meet(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
            index = Held(right, kind)
            yield from by_slices(left, lambda b: pa.RecordBatch.from_arrays([pa.array(x) for x in _ray_hits(index, kind, b)], names=names))

        at = at.select("tile", kind.key, *kind.columns)
        at = cut(at) if first else at  # read in every round
        met = lambda sent: plan.streamed(*plan.dealt(sent, at, ["tile"], TILE_QUERIES), ["tile", "part"], meet, ddl)
        if first:
            return front_to_back(rays, tiles, met, None, kind.key)
        hits = met(sent_to_tiles(rays, tiles))
    return first_hits(hits, prim=kind.key) if first else hits


def _nearest(held: Held, kind: Kind, p: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, id, distance) of the nearest shape of each point, no farther than its limit."""
    tree, best, found = held.tree, limit.copy(), Found(1, held.ids)

    def gap(q, node):
        g = np.maximum(np.maximum(tree.low[node] - p[q], 0), p[q] - tree.high[node])
        return np.sqrt(kernels.dot(g, g))

    def visit(q, at):
        d = kind.distance(p[q], held.shapes[at])
        np.minimum.at(best, q, d)
        near = d <= best[q]
        found.add(q[near], at[near], d[near])

    search(tree, len(p), lambda q, node: gap(q, node) <= best[q] * (1 + 1e-12), visit)
    q, at, d = found.all()
    return q, held.ids[at], d


def closest(points: DataFrame, shapes: DataFrame, kind: Kind, strategy: str = "auto", tile_rows: int | None = None) -> DataFrame:
    """(query_id, key, distance): the nearest shape to each point (query_id, px..pz), the smallest id of equal ones."""
    ddl = f"query_id long, {kind.key} long, distance double"
    names, p = [x.split()[0] for x in ddl.split(", ")], list(vec("p"))
    rows = shapes.select(F.col(kind.key).cast("long").alias(kind.key), *kind.columns)
    points = points.select("query_id", *p).withColumn("most", F.lit(float("inf")))
    found = lambda held, batch: pa.Table.from_arrays([pa.array(x) for x in (lambda q, i, d: (batch.column("query_id").to_numpy()[q], i, d))(*_nearest(held, kind, columns(batch, p), batch.column("most").to_numpy()))], names=names)
    table = rows.limit(plan.TREE_ROWS + 1).toArrow() if strategy != "tiles" and plan.small(rows, 1 << 30) else None
    if table is not None and table.num_rows <= plan.TREE_ROWS:
        shipped = points.sparkSession.sparkContext.broadcast(Held(table, kind))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from found(shipped.value, batch).to_batches()

        return plan.spread(points).mapInArrow(run, ddl)
    at, boxes = tiled_boxes(boxed(rows, kind), tile_rows)
    at, tiles = at.select("tile", kind.key, *kind.columns), TileTree(boxes)

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.float64() if n == "distance" else pa.int64()) for n in names})
        return found(Held(right, kind), left)

    # The nearest tile bounds the distance; then all tiles within it.
    near = nearest._meet(nearest._tiles_within(points, tiles, p, None, ["query_id", *p, "most"]), at, meet, ddl)
    bound = near.select("query_id", F.col("distance").alias("bound"))
    limited = points.join(bound, "query_id", "left").withColumn("most", F.coalesce("bound", "most"))
    last = nearest._meet(nearest._tiles_within(limited, tiles, p, "most", ["query_id", *p, "most"]), at, meet, ddl)
    return last.groupBy("query_id").agg(F.min(F.struct("distance", kind.key)).alias("m")).select("query_id", f"m.{kind.key}", "m.distance")
