"""A packed bounding-volume hierarchy in NumPy arrays, searched by whole batches.

Nodes are in pre-order: a node's left child follows it. A search moves a
frontier of (query, node) pairs down level by level, so each step is a few
array operations over all pairs still alive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

STRATEGIES = ("center", "average", "sah")
#: Cost constants of the surface-area heuristic, its bins, and the count below which every split is tried.
TRAVERSAL_COST, PRIMITIVE_COST, BINS, EXHAUSTIVE_BELOW = 1.0, 1.25, 32, 8


@dataclass
class Tree:
    low: np.ndarray  # nodes x 3
    high: np.ndarray
    right: np.ndarray  # right child, -1 for a leaf
    start: np.ndarray  # primitives of the subtree: order[start : start + count]
    count: np.ndarray
    axis: np.ndarray  # split axis, -1 for a leaf
    depth: np.ndarray
    parent: np.ndarray
    order: np.ndarray

    @property
    def leaf(self) -> np.ndarray:
        return self.right < 0

    def paths(self) -> np.ndarray:
        """Each node's way from the root: 1 for the root, then a bit for each step, 0 to the left and 1 to the right."""
        path = np.ones(len(self.right), np.int64)
        for d in range(1, int(self.depth.max(initial=0)) + 1):
            some = np.flatnonzero(self.depth == d)
            up = self.parent[some]
            path[some] = 2 * path[up] + (self.right[up] == some)
        return path


def _area(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    d = np.maximum(high - low, 0)
    return 2 * (d[..., 0] * d[..., 1] + d[..., 1] * d[..., 2] + d[..., 2] * d[..., 0])


def choose_split(low: np.ndarray, high: np.ndarray, strategy: str) -> tuple[int, float]:
    """(axis, position) for boxes of one node, or (-1, 0) if a leaf is as good."""
    mid = (low + high) / 2
    if strategy == "center":
        a, b = mid.min(0), mid.max(0)
        axis = int(np.argmax(b - a))
        return axis, float((a[axis] + b[axis]) / 2)
    if strategy == "average":
        axis = int(np.argmax(high.max(0) - low.min(0)))
        return axis, float(mid[:, axis].mean())
    n, whole = len(low), _area(low.min(0), high.max(0))
    if whole <= 0:
        return choose_split(low, high, "center")
    best: tuple[float, int, float] = (PRIMITIVE_COST * n, -1, 0.0)
    for axis in range(3):
        c = mid[:, axis]
        a, b = c.min(), c.max()
        if a == b:
            continue
        edges = np.unique(c)[1:] if n < EXHAUSTIVE_BELOW else bin_edges(a, b)
        slot = np.searchsorted(edges, c, side="right")
        m = len(edges) + 1
        lows, highs = np.full((m, 3), np.inf), np.full((m, 3), -np.inf)
        np.minimum.at(lows, slot, low)
        np.maximum.at(highs, slot, high)
        best = min(best, cheapest(axis, edges, lows, highs, np.bincount(slot, minlength=m), whole), key=lambda x: x[0])
    return best[1], best[2]


def bin_edges(a: float, b: float) -> np.ndarray:
    return a + (b - a) * np.arange(1, BINS) / BINS


def cheapest(axis: int, edges: np.ndarray, lows: np.ndarray, highs: np.ndarray, count: np.ndarray, whole: float) -> tuple[float, int, float]:
    """(cost, axis, position) of the cheapest split between bins of bounds and counts; the first of equal ones."""
    n = count.sum()
    left_n = np.cumsum(count)[:-1]
    la, lb = np.minimum.accumulate(lows)[:-1], np.maximum.accumulate(highs)[:-1]
    ra, rb = np.minimum.accumulate(lows[::-1])[::-1][1:], np.maximum.accumulate(highs[::-1])[::-1][1:]
    cost = TRAVERSAL_COST + PRIMITIVE_COST * (_area(la, lb) * left_n + _area(ra, rb) * (n - left_n)) / whole
    cost[(left_n == 0) | (left_n == n)] = np.inf
    i = int(np.argmin(cost))
    return float(cost[i]), axis, float(edges[i])


def build(low: np.ndarray, high: np.ndarray, strategy: str = "center", leaf_size: int = 10, max_depth: int = 40) -> Tree:
    """Build over boxes (n x 3 each). Centres below the split go left, all others right."""
    n = len(low)
    order = np.arange(n)
    nodes: list[list] = []
    stack = [(0, n, 0, -1, False)]
    mid = (low + high) / 2
    while stack:
        start, count, depth, parent, is_right = stack.pop()
        me = len(nodes)
        if is_right:
            nodes[parent][0] = me
        ids = order[start : start + count]
        nodes.append([-1, start, count, -1, depth, parent])
        if count <= leaf_size or depth >= max_depth:
            continue
        axis, position = choose_split(low[ids], high[ids], strategy)
        if axis < 0:
            continue
        left = mid[ids, axis] < position
        k = int(left.sum())
        if k in (0, count):
            continue
        order[start : start + count] = np.concatenate([ids[left], ids[~left]])
        nodes[me][3] = axis
        stack.append((start + k, count - k, depth + 1, me, True))
        stack.append((start, k, depth + 1, me, False))
    table = np.array(nodes, np.int64).reshape(-1, 6)
    right, start, count, axis, depth, parent = table.T
    tree = Tree(np.zeros((len(table), 3)), np.zeros((len(table), 3)), right, start, count, axis, depth, parent, order)
    refit(tree, low, high)
    return tree


def refit(tree: Tree, low: np.ndarray, high: np.ndarray, nodes: np.ndarray | None = None) -> None:
    """Bounds anew from the primitives' boxes, from the last node to the first; just `nodes` if given."""
    some = np.arange(len(tree.right))[::-1] if nodes is None else np.unique(nodes)[::-1]
    for i in some.tolist():
        r = tree.right[i]
        if r < 0:
            ids = tree.order[tree.start[i] : tree.start[i] + tree.count[i]]
            tree.low[i], tree.high[i] = (low[ids].min(0), high[ids].max(0)) if len(ids) else (np.inf, -np.inf)
        else:
            tree.low[i] = np.minimum(tree.low[i + 1], tree.low[r])
            tree.high[i] = np.maximum(tree.high[i + 1], tree.high[r])


Keep = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Pairs of queries and primitives that a search tests at once: a test holds some hundred bytes for each.
PAIRS = 1 << 15


def search(tree: Tree, n: int, keep: Keep, visit: Callable[[np.ndarray, np.ndarray], None], most: int = 4 * PAIRS) -> None:
    """Call visit(query, primitive) for all primitives in leaves that keep(query, node) lets n queries reach.

    At most about `most` pairs are kept or not at once: a longer frontier waits on a stack. A visit gets about PAIRS, or one leaf.
    """
    waiting = [(np.arange(n), np.zeros(n, np.int64))] if len(tree.order) else []
    while waiting:
        q, node = waiting.pop()
        if len(q) > most:
            waiting += [(q[i : i + most], node[i : i + most]) for i in range(0, len(q), most)]
            continue
        on = keep(q, node)
        q, node = q[on], node[on]
        leaf = tree.right[node] < 0
        if leaf.any():
            visit_leaves(tree, q[leaf], node[leaf], visit)
        q, node = q[~leaf], node[~leaf]
        if len(q):
            waiting.append((np.concatenate([q, q]), np.concatenate([node + 1, tree.right[node]])))


def visit_leaves(tree: Tree, q: np.ndarray, node: np.ndarray, visit: Callable[[np.ndarray, np.ndarray], None], most: int = PAIRS) -> None:
    """Call visit(query, primitive) for the primitives of pairs of queries and leaves, about `most` at once."""
    ends, i = np.cumsum(tree.count[node]), 0
    while i < len(node):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        size = tree.count[node[i:j]]
        at = np.repeat(tree.start[node[i:j]], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        visit(np.repeat(q[i:j], size), tree.order[at])
        i = j


class Found:
    """Rows (query, primitive, order, ...) of a search; with ids only the least of each query by order, then id, is kept, in about as many rows as there are queries."""

    def __init__(self, values: int, ids: np.ndarray | None = None, limit: int = 4 * PAIRS):
        self.ids, self.rows, self.held, self.limit, self.least = ids, [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * values], 0, limit, limit

    def add(self, q: np.ndarray, p: np.ndarray, *values: np.ndarray) -> None:
        if len(q):
            self.rows.append((q, p, *values))
            self.held += len(q)
            if self.ids is not None and self.held > self.limit:
                self.rows = [self.all()]
                self.held = len(self.rows[0][0])
                self.limit = max(self.least, 2 * self.held)

    def all(self) -> tuple[np.ndarray, ...]:
        q, p, *values = (np.concatenate(x) for x in zip(*self.rows))
        if self.ids is None or not len(q):
            return q, p, *values
        order = np.lexsort((self.ids[p], values[0], q))
        order = order[np.concatenate([[True], np.diff(q[order]) != 0])]
        return tuple(x[order] for x in (q, p, *values))
