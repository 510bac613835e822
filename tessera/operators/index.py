"""Index building and analytics as tables.

Split statistics (centre, average, surface-area histogram) are aggregations
over primitive boxes: box_id, minx..maxz and any grouping key. Node tables
(root_id, node_id, parent_id, right_id, depth, is_leaf, split_axis, offset,
count, minx..maxz, path) come from builds that split large nodes level by level
and grow what is below them in parallel. path tells a node's way from the root
by bits, so that ancestors are known without a walk: no join here compares
ranges, and none reads a root in one task.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import bounds
from ..functions.vectors import AXES
from ..plans.durable import cut
from ..plans.ordered import numbered
from ..plans.tree import BINS, PRIMITIVE_COST, STRATEGIES, TRAVERSAL_COST, bin_edges, build, cheapest
from .regions import BOX

NODES = "root_id int, node_id long, parent_id long, right_id long, depth int, is_leaf boolean, split_axis int, offset long, count long, " + ", ".join(f"{x} double" for x in BOX) + ", path long"
ORDER = "root_id int, slot long, box_id long"
_NAMES = [x.split()[0] for x in NODES.split(", ")]
#: Depth up to which a path fits a long.
DEEPEST = 61
#: Boxes of a subtree that one task builds; what is above is built level by level.
TASK_ROWS = 250_000


def ancestors(path: str = "path", depth: str = "depth", own: bool = True) -> Column:
    """Paths of a node's ancestors, from the node itself (or its parent) up to the root."""
    if own:
        return F.expr(f"transform(sequence(0, {depth}), i -> shiftright({path}, i))")
    return F.expr(f"case when {depth} > 0 then transform(sequence(1, {depth}), i -> shiftright({path}, i)) else array() end")


def node_bounds(boxes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Bounds of the boxes and of their centres (cminx..) and the count, in one pass."""
    own = [F.expr(x).alias(n) for n, x in bounds.union_of().items()]
    mid = [F.expr(f"{f}((min{c} + max{c}) / 2e0)").alias(f"c{f}{c}") for f in ("min", "max") for c in AXES]
    return boxes.groupBy(*(keys or [])).agg(*own, *mid, F.count("*").alias("n"))


def center_split(boxes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """axis and position: the middle of the longest axis of the centres' bounds."""
    at = node_bounds(boxes, keys).withColumn("axis", F.expr(bounds.longest_axis("c")))
    middle = " ".join(f"when {i} then (cmin{c} + cmax{c}) / 2e0" for i, c in enumerate(AXES))
    return at.withColumn("position", F.expr(f"case axis {middle} end")).select(*(keys or []), "axis", "position", "n")


def average_split(boxes: DataFrame, keys: list[str] | None = None, digits: int = 6) -> DataFrame:
    """axis and position: the mean centre on the longest axis of the bounds.

    Sums are of decimals with `digits` places, so that the mean doesn't depend
    on the order of rows.
    """
    fixed = lambda c: f"sum(cast((min{c} + max{c}) / 2e0 as decimal(28, {digits})))"
    sums = [F.expr(fixed(c)).alias(f"s{c}") for c in AXES]
    own = [F.expr(x).alias(n) for n, x in bounds.union_of().items()]
    at = boxes.groupBy(*(keys or [])).agg(*own, *sums, F.count("*").alias("n")).withColumn("axis", F.expr(bounds.longest_axis()))
    mean = " ".join(f"when {i} then cast(s{c} as double) / cast(n as double)" for i, c in enumerate(AXES))
    return at.withColumn("position", F.expr(f"case axis {mean} end")).select(*(keys or []), "axis", "position", "n")


def partition_sides(boxes: DataFrame, axis: int, position: float) -> DataFrame:
    """boxes with side: 'left' where the centre lies below the position, else 'right'."""
    c = AXES[axis]
    return boxes.withColumn("side", F.when(F.expr(f"(min{c} + max{c}) / 2e0") < position, "left").otherwise("right"))


def sah_histogram(boxes: DataFrame) -> DataFrame:
    """(axis, bin, n, minx..maxz): boxes by axis and 32 bins of their centres; two aggregations, no row leaves its partition otherwise."""
    span = node_bounds(boxes).select(*(f"c{f}{c}" for f in ("min", "max") for c in AXES))
    mid = ", ".join(f"named_struct('axis', {i}, 'c', (min{c} + max{c}) / 2e0, 'lo', cmin{c}, 'hi', cmax{c})" for i, c in enumerate(AXES))
    rows = boxes.select(*BOX).crossJoin(F.broadcast(span))  # span: one row
    rows = rows.withColumn("e", F.expr(f"explode(array({mid}))")).select(*BOX, "e.*")
    binned = rows.where("hi > lo").withColumn("bin", F.expr(f"cast(least({BINS - 1}, floor((c - lo) / (hi - lo) * {BINS})) as int)"))
    return binned.groupBy("axis", "bin").agg(F.count("*").alias("n"), *(F.expr(x).alias(n) for n, x in bounds.union_of().items()))


def sah_costs(histogram: DataFrame) -> DataFrame:
    """(axis, bin, cost): cost of splitting after each bin, by running bounds from both ends (at most 96 rows)."""
    left = Window.partitionBy("axis").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    right = Window.partitionBy("axis").orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("axis")
    cols = {}
    for p, w in (("l_", left), ("r_", right), ("w_", whole)):
        cols |= {f"{p}min{c}": F.min(f"min{c}").over(w) for c in AXES} | {f"{p}max{c}": F.max(f"max{c}").over(w) for c in AXES} | {f"{p}n": F.sum("n").over(w)}
    at = histogram.withColumns(cols).where("r_n > 0")
    ratio = f"({bounds.surface_area('l_')} * l_n + {bounds.surface_area('r_')} * r_n) / nullif({bounds.surface_area('w_')}, 0e0)"
    return at.withColumn("cost", F.expr(f"{TRAVERSAL_COST!r}D + {PRIMITIVE_COST!r}D * ({ratio})")).select("axis", "bin", "cost", F.col("w_n").alias("n"))


def sah_best(histogram: DataFrame) -> DataFrame:
    """The cheapest split, if it beats a leaf."""
    best = sah_costs(histogram).agg(F.min(F.struct("cost", "axis", "bin", "n")).alias("m")).select("m.*")
    return best.where(F.col("cost") < PRIMITIVE_COST * F.col("n"))


def build_nodes(boxes: DataFrame, root: str = "root_id", strategy: str = "center", leaf_size: int = 10, max_depth: int = 40, task_rows: int = TASK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(nodes, order) of one hierarchy for each root, of any size.

    boxes: root_id, box_id, minx..maxz. Nodes of more than `task_rows` boxes are split level
    by level: one aggregation gives the split of every open node, one join
    sends each box to its side. Subtrees below that are grown in a task each,
    and all are numbered in pre-order by running sums over the nodes above and
    the sizes of the subtrees. The result is the same for any `task_rows`, but for
    the rounding of the mean that strategy `average` splits large nodes at.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    if max_depth > DEEPEST:
        raise ValueError(f"a path has {DEEPEST} steps at most")
    rows = boxes.select(F.col(root).cast("int").alias("root_id"), "box_id", *BOX).withColumns({"path": F.lit(1).cast("long"), "depth": F.lit(0)})
    if (rows.groupBy("root_id").count().agg(F.max("count")).first()[0] or 0) <= task_rows:
        grown = _grown(rows, strategy, leaf_size, max_depth)
        return grown.where("kind = 0").select(*_NAMES), _slots(grown)
    return _by_levels(rows, strategy, leaf_size, max_depth, task_rows)


def _slots(grown: DataFrame) -> DataFrame:
    return grown.where("kind = 1").select("root_id", F.col("node_id").alias("slot"), F.col("parent_id").alias("box_id"))


def _grown(rows: DataFrame, strategy: str, leaf_size: int, max_depth: int) -> DataFrame:
    """The subtrees at (root_id, path), numbered from 0 each: a row per node, then one per slot (its number as node_id, its box as parent_id); kind tells them apart, top is the subtree's path."""

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("box_id")
        top, above = table.column("path")[0].as_py(), table.column("depth")[0].as_py()
        box = np.stack([table.column(x).to_numpy() for x in BOX], 1)
        t = build(box[:, :3], box[:, 3:], strategy, leaf_size, max_depth - above)
        r, ids, n = table.column("root_id")[0].as_py(), table.column("box_id").to_numpy(), len(t.right)
        path = (top << t.depth) | (t.paths() - (1 << t.depth))
        cols = [np.full(n, r, np.int32), np.arange(n), t.parent, t.right, (t.depth + above).astype(np.int32), t.leaf, t.axis.astype(np.int32), t.start, t.count, *t.low.T, *t.high.T, path]
        nodes = pa.Table.from_arrays([*(pa.array(c) for c in cols), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, top))], names=[*_NAMES, "kind", "top"])
        slots = {"root_id": np.full(len(ids), r, np.int32), "node_id": np.arange(len(ids)), "parent_id": ids[t.order], "kind": np.ones(len(ids), np.int32), "top": np.full(len(ids), top)}
        return pa.concat_tables([nodes, pa.table([pa.array(slots[c]) if c in slots else pa.nulls(len(ids), nodes.schema.field(c).type) for c in nodes.column_names], names=nodes.column_names)])

    # Stored, so that the hierarchies are grown once for both tables.
    return cut(rows.groupBy("root_id", "path").applyInArrow(grow, NODES + ", kind int, top long"))


def _splits(open_: DataFrame, stats: DataFrame, strategy: str) -> DataFrame:
    """(root_id, path, axis, position) of the open nodes; none where a leaf is as good."""
    keys = ["root_id", "path"]
    at = " ".join(f"when {i} then (cmin{c} + cmax{c}) / 2e0" for i, c in enumerate(AXES))
    centre = stats.withColumn("axis", F.expr(bounds.longest_axis("c"))).withColumn("position", F.expr(f"case axis {at} end")).select(*keys, "axis", "position")
    if strategy == "center":
        return centre
    if strategy == "average":
        return average_split(open_, keys).select(*keys, "axis", "position")
    flat = F.expr(bounds.surface_area()) <= 0
    span = stats.where(~flat).select(*keys, *(f"c{f}{c}" for f in ("min", "max") for c in AXES))
    mid = ", ".join(f"named_struct('axis', {i}, 'c', (min{c} + max{c}) / 2e0, 'lo', cmin{c}, 'hi', cmax{c})" for i, c in enumerate(AXES))
    each = open_.join(span, keys).select(*keys, *BOX, F.expr(f"explode(array({mid})) as e")).select(*keys, *BOX, "e.*").where("hi > lo")
    # A bin is the number of edges that the centre has reached, as the builder in a task counts them.
    binned = each.withColumn("bin", F.expr(f"size(filter(sequence(1, {BINS - 1}), i -> c >= lo + (hi - lo) * i / {BINS}e0))"))
    held = binned.groupBy(*keys, "axis", "bin").agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), *(F.expr(x).alias(n) for n, x in bounds.union_of().items()))

    def choose(table: pa.Table) -> pa.Table:
        """Of the 96 bins of a node."""
        axis, slot, n = (table.column(c).to_numpy() for c in ("axis", "bin", "n"))
        box = np.stack([table.column(x).to_numpy() for x in BOX], 1)
        edge = np.stack([table.column(x).to_numpy() for x in ("lo", "hi")], 1)
        best = (PRIMITIVE_COST * n[axis == axis[0]].sum(), -1, 0.0)
        some = axis == axis[0]
        d = box[some, 3:].max(0) - box[some, :3].min(0)
        whole = 2 * (d[0] * d[1] + d[1] * d[2] + d[2] * d[0])
        for i in np.unique(axis):
            on = axis == i
            lows, highs, count = np.full((BINS, 3), np.inf), np.full((BINS, 3), -np.inf), np.zeros(BINS, np.int64)
            lows[slot[on]], highs[slot[on]], count[slot[on]] = box[on, :3], box[on, 3:], n[on]
            best = min(best, cheapest(int(i), bin_edges(*edge[on][0]), lows, highs, count, whole), key=lambda x: x[0])
        found = [[x] if best[1] >= 0 else [] for x in (table.column("root_id")[0].as_py(), table.column("path")[0].as_py(), *best[1:])]
        return pa.table({k: pa.array(v, t) for k, v, t in zip((*keys, "axis", "position"), found, (pa.int32(), pa.int64(), pa.int32(), pa.float64()))})

    chosen = held.groupBy(*keys).applyInArrow(choose, "root_id int, path long, axis int, position double")
    return chosen.unionByName(centre.join(stats.where(flat).select(*keys), keys, "left_semi"))


def _by_levels(rows: DataFrame, strategy: str, leaf_size: int, max_depth: int, task_rows: int) -> tuple[DataFrame, DataFrame]:
    keys, most = ["root_id", "path"], max(task_rows, leaf_size)
    stats = cut(node_bounds(rows, keys))
    below, above, giant, depth = [rows.join(stats.where(F.col("n") <= most).select(*keys), keys, "left_semi")], [], [], 0
    large = stats.where(F.col("n") > most)
    open_ = rows.join(large.select(*keys), keys, "left_semi")
    while not large.isEmpty():
        if depth >= max_depth:
            giant.append((open_, large, depth))
            break
        centre = "case axis " + " ".join(f"when {i} then (min{c} + max{c}) / 2e0" for i, c in enumerate(AXES)) + " end"
        sided = open_.join(_splits(open_, large, strategy), keys, "left")
        sided = cut(sided.withColumn("to", F.expr(f"case when axis is not null then path * 2 + case when {centre} < position then 0 else 1 end end")))
        sides = cut(node_bounds(sided, [*keys, "axis", "to"]))
        # A node that has nothing on one side, or no good split, is a leaf, however large.
        split = sides.groupBy(*keys, "axis").agg(F.count("to").alias("sides")).where("sides = 2").select(*keys, "axis")
        above.append(large.join(split, keys).withColumn("depth", F.lit(depth)))
        giant.append((sided.join(split, keys, "left_anti"), large.join(split, keys, "left_anti"), depth))
        sides = sides.join(split.select(*keys), keys, "left_semi").drop("path", "axis").withColumnRenamed("to", "path")
        down = sided.join(split.select(*keys), keys, "left_semi").select("root_id", "box_id", *BOX, F.col("to").alias("path"), F.lit(depth + 1).alias("depth"))
        below.append(down.join(sides.where(F.col("n") <= most).select(*keys), keys, "left_semi"))
        large, depth = sides.where(F.col("n") > most), depth + 1
        open_ = down.join(large.select(*keys), keys, "left_semi")

    grown = _grown(reduce(DataFrame.unionByName, below), strategy, leaf_size, max_depth)
    sizes = grown.groupBy("root_id", F.col("top").alias("path")).agg(F.count(F.when(F.col("kind") == 0, 1)).alias("size"), F.count(F.when(F.col("kind") == 1, 1)).alias("slots"))
    depth_of = grown.where("kind = 0 and path = top").select(*keys, "depth")
    tops = sizes.join(depth_of, keys).selectExpr(*keys, "depth", "size", "slots", "1 as kind", "-1 as axis", *(f"cast(null as double) as {x}" for x in BOX))
    for split in above:
        tops = tops.unionByName(split.selectExpr(*keys, "depth", "1 as size", "0 as slots", "0 as kind", "axis", *BOX))
    for _, leaf, at in giant:
        tops = tops.unionByName(leaf.selectExpr(*keys, f"{at} as depth", "1 as size", "n as slots", "2 as kind", "-1 as axis", *BOX))
    # Pre-order: by the path, filled up on the right, then by depth. A root has about two rows for each `task_rows` boxes.
    place = Window.partitionBy("root_id").orderBy(F.expr(f"shiftleft(path, {DEEPEST} - depth)"), "depth").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumns({"first_node": F.coalesce(F.sum("size").over(place), F.lit(0)), "first_slot": F.coalesce(F.sum("slots").over(place), F.lit(0))})
    tops = cut(tops)
    number = tops.select("root_id", F.col("path").alias("of"), F.col("first_node").alias("number"))
    tops = tops.withColumn("up", F.shiftright("path", 1)).withColumn("beside", F.col("path") * 2 + 1)
    tops = tops.join(number.select("root_id", F.col("of").alias("up"), F.col("number").alias("parent_id")), ["root_id", "up"], "left")
    tops = tops.join(number.select("root_id", F.col("of").alias("beside"), F.col("number").alias("right_id")), ["root_id", "beside"], "left")
    tops = cut(tops.withColumns({x: F.coalesce(x, F.lit(-1)) for x in ("parent_id", "right_id")}))
    # What lies in the subtree of a node above: its slots.
    slots = tops.where("slots > 0").select("root_id", F.explode(ancestors(own=False)).alias("path"), "slots").groupBy(*keys).agg(F.sum("slots").alias("count"))
    inner = tops.where("kind = 0").join(slots, keys).selectExpr("root_id", "first_node as node_id", "parent_id", "right_id", "depth", "false as is_leaf", "axis as split_axis", "first_slot as offset", "count", *BOX, "path")
    leaves = tops.where("kind = 2").selectExpr("root_id", "first_node as node_id", "parent_id", "-1l as right_id", "depth", "true as is_leaf", "-1 as split_axis", "first_slot as offset", "slots as count", *BOX, "path")
    base = tops.where("kind = 1").selectExpr("root_id", "path as top", "first_node", "first_slot", "parent_id as above")
    placed = grown.join(base, ["root_id", "top"])
    own = placed.where("kind = 0").withColumns({
        "parent_id": F.expr("case when parent_id < 0 then above else parent_id + first_node end"), "right_id": F.expr("case when right_id < 0 then -1l else right_id + first_node end"),
        "node_id": F.expr("node_id + first_node"), "offset": F.expr("offset + first_slot"),
    })
    nodes = inner.unionByName(leaves).select(*_NAMES).unionByName(own.select(*_NAMES))
    order = placed.where("kind = 1").selectExpr("root_id", "node_id + first_slot as slot", "parent_id as box_id")
    held = [boxes.select(F.struct(*keys).alias("leaf"), "box_id") for boxes, _, _ in giant]
    if held:
        numbered_ = numbered(reduce(DataFrame.unionByName, held), "leaf", ["box_id"], "place")
        first = tops.where("kind = 2").select(F.struct(*keys).alias("leaf"), "first_slot")
        order = order.unionByName(numbered_.join(first, "leaf").selectExpr("leaf.root_id", "place + first_slot as slot", "box_id"))
    return nodes, order


def tree_extremes(nodes: DataFrame) -> DataFrame:
    """Per root: counts, leaf depths, leaf sizes, splits by axis and the surface-area score."""
    area = bounds.surface_area()
    leaf, inner = F.col("is_leaf"), ~F.col("is_leaf")
    return nodes.groupBy("root_id").agg(
        F.count("*").alias("node_count"), F.count(F.when(leaf, 1)).alias("leaf_count"),
        F.min(F.when(leaf, F.col("depth"))).alias("min_depth"), F.max(F.when(leaf, F.col("depth"))).alias("max_depth"),
        F.min(F.when(leaf, F.col("count"))).alias("min_primitives"), F.max(F.when(leaf, F.col("count"))).alias("max_primitives"),
        *(F.count(F.when(inner & (F.col("split_axis") == i), 1)).alias(f"splits_{c}") for i, c in enumerate(AXES)),
        F.sum(F.expr(f"{area} * case when is_leaf then {PRIMITIVE_COST!r}D * count else {TRAVERSAL_COST!r}D end")).alias("area_score"),
    )


def validate_bounds(nodes: DataFrame, order: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per root: nodes outside their parents and primitives outside their leaves."""
    p = nodes.select("root_id", F.col("node_id").alias("parent_id"), *(F.col(x).alias(f"p_{x}") for x in BOX))
    child = nodes.join(p, ["root_id", "parent_id"]).groupBy("root_id").agg(F.count(F.when(~F.expr(bounds.contains_box("p_", "")), 1)).alias("bad_nodes"))
    leaf = nodes.where("is_leaf").select("root_id", F.explode(F.sequence("offset", F.col("offset") + F.col("count") - 1)).alias("slot"), *(F.col(x).alias(f"p_{x}") for x in BOX))
    held = leaf.join(order, ["root_id", "slot"]).join(boxes.select("box_id", *BOX), "box_id")
    prims = held.groupBy("root_id").agg(F.count(F.when(~F.expr(bounds.contains_box("p_", "")), 1)).alias("bad_primitives"), F.count("*").alias("primitives"))
    return prims.join(child, "root_id", "left").select("root_id", "primitives", F.coalesce("bad_nodes", F.lit(0)).alias("bad_nodes"), "bad_primitives")


def slots_of(leaves: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, slot): a row for each slot of each leaf."""
    return leaves.select(*keep, F.explode(F.sequence("offset", F.col("offset") + F.col("count") - 1)).alias("slot"))


def leaves_of(nodes: DataFrame, order: DataFrame, boxes: DataFrame) -> DataFrame:
    """(root_id, node_id) of the leaves that hold some of the boxes (box_id)."""
    held = slots_of(nodes.where("is_leaf"), ["root_id", "node_id"]).join(order, ["root_id", "slot"])
    return held.join(boxes.select("box_id"), "box_id", "left_semi").select("root_id", "node_id").distinct()


def refit(nodes: DataFrame, order: DataFrame, boxes: DataFrame, dirty: DataFrame | None = None) -> DataFrame:
    """nodes with bounds anew from changed boxes, topology kept.

    Leaves take the bounds of their slots; each then adds its bounds to all its
    ancestors, known by their paths: one aggregation, added up before its
    exchange, for a root of any size. With `dirty` (root_id, node_id) just the
    leaves at or below those nodes read their primitives, and their ancestors
    follow, from these leaves and from the bounds that the clean nodes beside the way
    have; the others keep their bounds. A leaf none of whose boxes are given keeps its own.
    """
    keys = ["root_id", "path"]
    leaves = nodes.where("is_leaf").select("root_id", "node_id", "path", "depth", "offset", "count", *BOX)
    if dirty is not None:
        hit = nodes.join(dirty.select("root_id", "node_id").distinct(), ["root_id", "node_id"], "left_semi").select("root_id", F.col("path").alias("up"))
        below = leaves.select("root_id", "node_id", F.explode(ancestors()).alias("up")).join(hit, ["root_id", "up"], "left_semi").select("root_id", "node_id").distinct()
        leaves = leaves.join(below, ["root_id", "node_id"], "left_semi")
    placed = slots_of(leaves, ["root_id", "node_id"]).join(order, ["root_id", "slot"]).join(boxes.select("box_id", *BOX), "box_id")
    fresh = placed.groupBy("root_id", "node_id").agg(*(F.expr(x).alias(f"new_{n}") for n, x in bounds.union_of().items()))
    parts = leaves.join(fresh, ["root_id", "node_id"], "left").select(*keys, "depth", *(F.coalesce(f"new_{x}", x).alias(x) for x in BOX), ancestors().alias("ups"))
    if dirty is not None:
        parts = cut(parts)  # read for the way up and for what it changes
        way = parts.select("root_id", F.explode("ups").alias("path")).distinct()
        beside = nodes.withColumn("up", F.shiftright("path", 1)).join(way.withColumnRenamed("path", "up"), ["root_id", "up"], "left_semi").join(way, keys, "left_anti")
        parts = parts.unionByName(beside.select(*keys, "depth", *BOX, ancestors(own=False).alias("ups")))
    lifted = parts.select("root_id", F.explode("ups").alias("path"), *BOX).groupBy(*keys).agg(*(F.expr(x).alias(f"new_{n}") for n, x in bounds.union_of().items()))
    return nodes.join(lifted, keys, "left").withColumns({x: F.coalesce(f"new_{x}", x) for x in BOX}).select(*nodes.columns)


def shift_offsets(order: DataFrame, n: int) -> DataFrame:
    """Primitive ids moved by n."""
    return order.withColumn("box_id", F.col("box_id") + n)


def cluster_cut(nodes: DataFrame, most: int = 64) -> DataFrame:
    """The first nodes on each path with fewer than `most` primitives (or leaves): a partition of all slots."""
    fits = (F.col("count") < most) | F.col("is_leaf")
    cut = nodes.where(fits).select("root_id", "node_id", "parent_id", "offset", "count", *BOX)
    above = nodes.where(fits).select("root_id", F.col("node_id").alias("parent_id"))
    return cut.join(above, ["root_id", "parent_id"], "left_anti")


def traverse(nodes: DataFrame, depth: int | None = None, enter: Column | None = None) -> DataFrame:
    """Nodes to a depth if given; with `enter` (a condition over a node's columns) just those of which all ancestors meet it: a node that does not is reported, its subtree is not.

    node_id numbers a root's nodes in pre-order; sort by (root_id, node_id) to
    visit them so.
    """
    some = nodes if depth is None else nodes.where(F.col("depth") <= depth)
    if enter is None:
        return some
    # What is below a node that was left has it among its ancestors.
    left = nodes.where(~F.coalesce(enter, F.lit(False))).select("root_id", F.col("path").alias("up"))
    below = some.select("root_id", "path", F.explode(ancestors(own=False)).alias("up")).join(left, ["root_id", "up"], "left_semi").select("root_id", "path")
    return some.join(below, ["root_id", "path"], "left_anti")


def tree_json(nodes: DataFrame, root_id: int = 0) -> str:
    """One root as nested JSON: bounds with left and right, or with offset and count. For inspection: a root fits the driver."""
    rows = {r["node_id"]: r for r in nodes.where(F.col("root_id") == root_id).toLocalIterator()}

    def told(i: int) -> dict:
        r = rows[i]
        out: dict = {"bounds": [r[x] for x in BOX]}
        return out | ({"offset": r["offset"], "count": r["count"]} if r["is_leaf"] else {"left": told(i + 1), "right": told(r["right_id"])})

    return json.dumps(told(0)) if rows else "{}"


def wireframe(nodes: DataFrame, depth: int) -> DataFrame:
    """(root_id, node_id, corner, x, y, z): corners of the nodes at a depth, or of leaves above it."""
    shown = nodes.where((F.col("depth") == depth) | (F.col("is_leaf") & (F.col("depth") < depth)))
    at = shown.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(7))))
    pick = {c: F.when(F.shiftright("corner", i).bitwiseAND(F.lit(1)) == 1, F.col(f"max{c}")).otherwise(F.col(f"min{c}")) for i, c in enumerate(AXES)}
    return at.select("root_id", "node_id", "corner", *(v.alias(k) for k, v in pick.items()))


def pack(nodes: DataFrame) -> DataFrame:
    """(root_id, packed): a root's nodes in pre-order, 32 bytes each.

    A record has the bounds as six floats, outwards, then for a leaf its offset and count, for
    another node the distance to its right child and its split axis with the
    highest bit set (little-endian).
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node_id")
        n = table.num_rows
        box = np.stack([table.column(x).to_numpy() for x in BOX], 1)
        record = np.zeros(n, _PACKED)
        near = box.astype(np.float32)
        out = np.concatenate([near[:, :3].astype(float) > box[:, :3], near[:, 3:].astype(float) < box[:, 3:]], 1)
        to = np.where(np.arange(6) < 3, np.float32(-np.inf), np.float32(np.inf))
        record["box"] = np.where(out, np.nextafter(near, to), near)  # rounding must not cut anything off
        leaf = table.column("is_leaf").to_numpy(zero_copy_only=False)
        right, ids = table.column("right_id").to_numpy(), table.column("node_id").to_numpy()
        record["first"] = np.where(leaf, table.column("offset").to_numpy(), right - ids)
        record["second"] = np.where(leaf, table.column("count").to_numpy(), table.column("split_axis").to_numpy().astype(np.int64) | 1 << 31)
        return pa.table({"root_id": table.column("root_id").slice(0, 1), "packed": pa.array([record.tobytes()])})

    return nodes.groupBy("root_id").applyInArrow(run, "root_id int, packed binary")


_PACKED = np.dtype([("box", "<f4", 6), ("first", "<u4"), ("second", "<u4")])


def unpack(packed: DataFrame) -> DataFrame:
    """(root_id, node_id, right_id, is_leaf, split_axis, offset, count, minx..maxz) of packed roots; offset and count are of leaves alone."""
    kinds = {"root_id": "int", "node_id": "long", "right_id": "long", "is_leaf": "boolean", "split_axis": "int", "offset": "long", "count": "long"} | {x: "double" for x in BOX}

    def run(batches):
        for batch in batches:
            for root, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                r = np.frombuffer(raw, _PACKED)
                n, leaf = len(r), r["second"] < 1 << 31
                first, second, ids = r["first"].astype(np.int64), r["second"].astype(np.int64), np.arange(n)
                cols = [np.full(n, root, np.int32), ids, np.where(leaf, -1, ids + first), leaf, np.where(leaf, -1, second & 3).astype(np.int32)]
                spans = [pa.array(x, mask=~leaf) for x in (first, second)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *spans, *(pa.array(r["box"][:, i].astype(float)) for i in range(6))], names=list(kinds))

    return packed.select("root_id", "packed").mapInArrow(run, ", ".join(f"{k} {t}" for k, t in kinds.items()))


def memory_estimate(nodes: DataFrame) -> DataFrame:
    """Bytes of the packed nodes of each root, 32 a node."""
    return nodes.groupBy("root_id").agg((F.count("*") * 32).alias("bytes"))
