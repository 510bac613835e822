"""Pairs of overlapping boxes of two tables, with what a caller makes of them.

nested  one side is broadcast, see plans.strategy
cells   both go to the cells of a grid (plans.strategy.celled), and a task
        searches the hierarchy of what a cell holds
tiles   the right side is cut into tiles (rays.tiled_boxes), rows of the left
        one go to the tiles whose bounds they meet, and a task searches the
        hierarchy of its tile. Pairs are tested where they are found: what is
        shuffled are rows of both sides, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import AXES
from ..plans import strategy as plan
from ..plans.tree import PAIRS, Tree, build, search, visit_leaves
from .rays import HITS, TileTree, tiled_boxes

#: Rows of a tile, and rows of the other side that one task takes to it at most.
TILE_ROWS = TILE_QUERIES = 20_000
_BOX = [f"{f}{c}" for f in ("min", "max") for c in AXES]

Test = Callable[[pa.RecordBatch], pa.RecordBatch]


def extremes(table: pa.Table | pa.RecordBatch, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    """(low, high), 3 x n each; NaN is greater than any number, as it is in SQL."""
    values = np.stack([table.column(f"{prefix}{x}").to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(f"{prefix}{x}").to_numpy() for x in _BOX])
    values[np.isnan(values)] = np.inf
    return values[:3], values[3:]


def overlapping(low: np.ndarray, high: np.ndarray, tree: Tree, of: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), about HITS at once: boxes i (3 x n) that overlap boxes j of a hierarchy over the boxes `of`."""
    node_low, node_high = np.ascontiguousarray(tree.low.T), np.ascontiguousarray(tree.high.T)

    def meet(i: np.ndarray, j: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        on = low[0][i] <= highs[0][j]
        for x, a, y, b in ((lows[0], j, high[0], i), (low[1], i, highs[1], j), (lows[1], j, high[1], i), (low[2], i, highs[2], j), (lows[2], j, high[2], i)):
            on &= x[a] <= y[b]
        return on

    at, rows = 0, 16
    while at < low.shape[1]:
        n, found = min(rows, low.shape[1] - at), []

        def visit(q: np.ndarray, p: np.ndarray) -> None:
            on = meet(q + at, p, *of)
            found.append((q[on] + at, p[on]))

        search(tree, n, lambda q, node: meet(q + at, node, node_low, node_high), visit)
        i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        for k in range(0, len(i), PAIRS):
            yield i[k : k + PAIRS], j[k : k + PAIRS]
        at, rows = at + n, min(1 << 16, max(1, rows * HITS // max(len(i), HITS // 4)))


def _one_each(low: np.ndarray, high: np.ndarray, tree: Tree, of: tuple[np.ndarray, np.ndarray], test: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], ids: pa.Array) -> Iterator[pa.RecordBatch]:
    """For each box i (3 x n) one row that test(i, j), whose first column is of numbers i, makes of it and a box j of a hierarchy, with its id in the number's place.

    Each box first goes to the leaf that its centre is nearest to; those that meet nothing there are searched for, until they do.
    """
    node_low, node_high, mid = tree.low.T, tree.high.T, (low + high) / 2
    meet = lambda i, j, lows, highs: ((low[:, i] <= highs[:, j]) & (lows[:, j] <= high[:, i])).all(0)
    done = np.zeros(low.shape[1], bool)
    for at in range(0, len(done), 4096):
        own, found = np.arange(at, min(at + 4096, len(done))), []
        node = np.zeros(len(own), np.int64)
        gap2 = lambda i, j: (np.maximum(np.maximum(node_low[:, j] - mid[:, own[i]], 0), mid[:, own[i]] - node_high[:, j]) ** 2).sum(0)
        while len(inner := np.flatnonzero(tree.right[node] >= 0)):
            left, right = node[inner] + 1, tree.right[node[inner]]
            node[inner] = np.where(gap2(inner, left) <= gap2(inner, right), left, right)

        def visit(q: np.ndarray, p: np.ndarray) -> None:
            i = own[q]
            on = ~done[i] & meet(i, p, *of)
            if on.any():
                out = test(i[on], p[on])
                hit, first = np.unique(out.column(0).to_numpy(), return_index=True)
                done[hit] = True
                found.append(pa.RecordBatch.from_arrays([ids.take(pa.array(hit)), *out.take(pa.array(first)).columns[1:]], names=out.schema.names))

        visit_leaves(tree, np.arange(len(own)), node, visit)
        search(tree, len(own), lambda q, node: ~done[own[q]] & meet(own[q], node, node_low, node_high), visit)
        yield from found


def sent(left: DataFrame, tiles: DataFrame, a: str = "a_") -> DataFrame:
    """(tile, columns of left): each row with the tiles (tile, minx..maxz) whose bounds its box meets."""
    shipped, names = left.sparkSession.sparkContext.broadcast(TileTree(tiles)), ["tile", *left.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        for batch in batches:
            if batch.num_rows:
                for i, j in overlapping(*extremes(batch, a), held.tree, (held.low.T, held.high.T)):
                    yield pa.RecordBatch.from_arrays([pa.array(held.ids[j], pa.int32()), *batch.take(pa.array(i)).columns], names=names)

    return plan.spread(left).mapInArrow(run, "tile int, " + _ddl(left, left.columns))


def _ddl(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in names)


def in_tiles(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], ddl: str, a: str = "a_", b: str = "b_") -> DataFrame:
    """Rows of `ddl` that run(left, right) yields for each tile of the right side and the rows of the left one that may meet it."""
    boxed = right.withColumns({x: F.nanvl(F.col(f"{b}{x}").cast("double"), F.lit(float("inf"))) for x in _BOX})
    held, tiles = tiled_boxes(boxed.select(*dict.fromkeys([*right.columns, *_BOX])), TILE_ROWS)
    return plan.streamed(*plan.dealt(sent(left, tiles, a), held.select("tile", *right.columns), ["tile"], TILE_QUERIES), ["tile", "part"], run, ddl)


def in_cells(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], ddl: str, a: str = "a_", b: str = "b_") -> DataFrame:
    """Rows of `ddl` that run(left, right) yields for the rows of both sides in each cell of a grid; a pair may be in several cells, of which one owns it (_owned).

    Crowded cells are dealt to several tasks, by parts of either side: a task holds TILE_ROWS of one and TILE_QUERIES of the other.
    """
    left, right = plan.celled(plan.spread(left), plan.spread(right), a, b)
    left, right = plan.dealt(left, right, plan.CELL, TILE_QUERIES)
    right, left = plan.dealt(right.withColumnRenamed("part", "of_part"), left.withColumnRenamed("part", "of_part"), [*plan.CELL, "of_part"], TILE_ROWS)
    # The keys go along as columns too: a task has to know its cell.
    told = lambda df: df.withColumns({f"in_{k}": F.col(k) for k in plan.CELL})
    return plan.streamed(told(left), told(right), [*plan.CELL, "of_part", "part"], run, ddl)


def _owned(left: pa.Table, right: pa.Table, a: str, b: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether a cell owns pairs (i, j): it is of the coarser level of the two and holds the least corner of their overlap."""
    level = left.column("in_level")[0].as_py()
    mine, theirs = (t.column(f"{p}level").to_numpy() == level for t, p in ((left, a), (right, b)))
    at = [(left.column(f"{a}min{c}").to_numpy(), right.column(f"{b}min{c}").to_numpy(), left.column(f"in_cell_{c}")[0].as_py()) for c in AXES]

    def owned(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        on = mine[i] | theirs[j]
        for x, y, cell in at:
            on &= np.floor(np.maximum(x[i], y[j]) / 2.0**level) == cell
        return on

    return owned


def _whole(df: DataFrame, p: str) -> DataFrame:
    """Rows whose bounds are known: null overlaps nothing."""
    return df.where(" and ".join(f"{p}{x} is not null" for x in _BOX))


def _with(told: pa.RecordBatch, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The columns of told, and those of the batch that it has no like of."""
    rest = [c for c in batch.schema.names if c not in told.schema.names]
    return pa.RecordBatch.from_arrays([*told.columns, *(batch.column(c) for c in rest)], names=[*told.schema.names, *rest])


def tested(left: DataFrame, right: DataFrame, test: Test, ddl: str, columns: list[str], strategy: str = "auto", ordered: bool = False, a: str = "a_", b: str = "b_", some: str | None = None, known: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """Rows of `ddl` that test, a function of batches of pairs with the named columns, makes of all pairs of rows whose boxes overlap; ordered: of those with a_id < b_id.

    The strategy (auto, nested, cells, tiles) changes the plan, never the rows. With `some`, the key (long) of the
    left side and first column of `ddl`, each row of the left side that has rows has at least one of them: a search ends with its first.
    With `known`, test gets what it makes of batches with the named columns of the left side, in their place: once for each row that a task has, not for each pair.
    """
    pairs = None if strategy in ("tiles", "cells") else plan.box_join(left, right, a, b, strategy) if strategy != "auto" else plan.nested_join(left, right, a, b)
    if pairs is not None:

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield test(batch if known is None else _with(known(batch), batch))

        return (pairs.where("a_id < b_id") if ordered else pairs).select(*columns).mapInArrow(each, ddl)
    mine = set(left.columns)

    def run(l: pa.Table, r: pa.Table) -> Iterator[pa.RecordBatch]:
        low, high = extremes(r, b)
        tree = build(low.T, high.T, leaf_size=16)
        own = {c: l.column(c).chunk(0) for c in columns if c in mine}
        if known is not None:
            told = known(pa.RecordBatch.from_arrays(list(own.values()), names=list(own)))
            own = dict(zip(told.schema.names, told.columns))
        of = own | {c: r.column(c).chunk(0) for c in columns if c not in mine}
        names = list(of)
        owned = _owned(l, r, a, b) if strategy == "cells" else None
        if some and owned is None:
            pairs_of = lambda i, j, x: pa.RecordBatch.from_arrays([pa.array(x) if c == some else v.take(pa.array(i if c in own else j)) for c, v in of.items()], names=names)
            yield from _one_each(*extremes(l, a), tree, (low, high), lambda i, j: test(pairs_of(i, j, i)), of[some])
            return
        if ordered:
            first, second = l.column("a_id").to_numpy(), r.column("b_id").to_numpy()
        for i, j in overlapping(*extremes(l, a), tree, (low, high)):
            if ordered:
                on = first[i] < second[j]
                i, j = i[on], j[on]
            if owned is not None:
                on = owned(i, j)
                i, j = i[on], j[on]
            if len(i):
                i, j = pa.array(i), pa.array(j)
                yield test(pa.RecordBatch.from_arrays([x.take(i if c in own else j) for c, x in of.items()], names=names))

    return (in_cells if strategy == "cells" else in_tiles)(_whole(left, a), _whole(right, b), run, ddl, a, b)


def join(left: DataFrame, right: DataFrame, columns: list[str], strategy: str = "auto", ordered: bool = False, a: str = "a_", b: str = "b_") -> DataFrame:
    """The named columns of all pairs of rows whose boxes overlap; ordered: of those with a_id < b_id."""
    pairs = None if strategy in ("tiles", "cells") else plan.box_join(left, right, a, b, strategy) if strategy != "auto" else plan.nested_join(left, right, a, b)
    if pairs is not None:
        return (pairs.where("a_id < b_id") if ordered else pairs).select(*columns)
    kinds = dict(left.dtypes) | dict(right.dtypes)
    return tested(left, right, lambda batch: batch, ", ".join(f"`{c}` {kinds[c]}" for c in columns), columns, "cells" if strategy == "cells" else "tiles", ordered, a, b)
