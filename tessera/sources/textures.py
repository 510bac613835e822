"""Layouts of attributes, indices and hierarchies as texels: what a renderer's textures hold, as rows.

Textures are square. A texel has its place in one dimension, and x and y in
the texture; texels beyond the last value are left out, as they are zero.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


CHANNELS = ("r", "g", "b", "a")
#: Fixed value of the format: marks the contents of a leaf, above its count.
LEAF_MARK = 0xFFFF0000


def _placed(df: DataFrame, side: int) -> list:
    return [F.col("texel"), (F.col("texel") % side).alias("x"), F.floor(F.col("texel") / side).alias("y")]


def attribute_texels(values: DataFrame, index: str, names: list[str], channels: int | None = None) -> DataFrame:
    """(texel, x, y, r, g, ..): an attribute of 1 to 4 columns `names` at places `index` from 0 on, without gaps.

    Three channels are filled up with a = 1. `channels` deals the values out
    anew, as for indices of one column that become texels of three; their
    number has to be divisible by it.
    """
    n, own = values.count(), len(names)
    size = channels or own
    if n * own % size:
        raise ValueError(f"{n * own} values are not divisible by {size}")
    side = max(1, math.ceil(math.sqrt(n * own // size)))
    if size == own:
        texels = values.select(F.col(index).alias("texel"), *(F.col(v).alias(c) for v, c in zip(names, CHANNELS)))
    else:
        each = values.select(F.posexplode(F.array(*names)).alias("k", "value"), F.col(index).alias("i")).select((F.col("i") * own + F.col("k")).alias("flat"), "value")
        at = each.withColumns({"texel": F.floor(F.col("flat") / size), "c": F.col("flat") % size})
        texels = at.groupBy("texel").agg(*(F.max(F.when(F.col("c") == i, F.col("value"))).alias(c) for i, c in enumerate(CHANNELS[:size])))
    filled = [F.lit(1).cast(dict(texels.dtypes)["r"]).alias("a")] if size == 3 else []
    return texels.select(*_placed(texels, side), *CHANNELS[:size], *filled)


def hierarchy_texels(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bounds, contents) of a hierarchy with one root: two texels (r, g, b) for a node's least and greatest corner, and one (r, g).

    Contents are a leaf's marked count and offset, or a node's split axis and
    the distance to its right child.
    """
    if nodes.select("root_id").distinct().count() > 1:
        raise ValueError("more than one root")
    n = nodes.count()
    wide, side = 2 * math.ceil(math.sqrt(n / 2)), math.ceil(math.sqrt(n))
    ends = F.array(*(F.struct(F.lit(k).alias("k"), *(F.col(f"{f}{c}").alias(t) for c, t in zip("xyz", CHANNELS))) for k, f in enumerate(("min", "max"))))
    corners = nodes.select("node_id", F.explode(ends).alias("e")).select((F.col("node_id") * 2 + F.col("e.k")).alias("texel"), "e.r", "e.g", "e.b")
    leaf = F.col("is_leaf")
    first = F.when(leaf, F.col("count").bitwiseOR(F.lit(LEAF_MARK))).otherwise(F.col("split_axis").cast("long"))
    second = F.when(leaf, F.col("offset")).otherwise(F.col("right_id") - F.col("node_id"))
    contents = nodes.select(F.col("node_id").alias("texel"), first.alias("r"), second.alias("g"))
    return corners.select(*_placed(corners, wide), "r", "g", "b"), contents.select(*_placed(contents, side), "r", "g")


def dereferenced(index: DataFrame, order: DataFrame) -> DataFrame:
    """(root_id, place, vid): the vertices of triangles in the order of a hierarchy's slots. index: slot, vid, three for each triangle, which are the boxes of order."""
    corner = index.select(F.floor(F.col("slot") / 3).alias("box_id"), (F.col("slot") % 3).alias("corner"), "vid")
    return order.join(corner, "box_id").select("root_id", (F.col("slot") * 3 + F.col("corner")).alias("place"), "vid")


def subtree_spans(nodes: DataFrame) -> DataFrame:
    """(root_id, node_id, n_nodes, levels): nodes of each subtree, its own included, and the levels below it; a root's nodes fit a task."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node_id")
        parent, depth = table.column("parent_id").to_numpy(), table.column("depth").to_numpy()
        size, deep = np.ones(len(parent), np.int64), np.zeros(len(parent), np.int32)
        for d in range(int(depth.max()), 0, -1):
            some = np.flatnonzero(depth == d)
            np.add.at(size, parent[some], size[some])
            np.maximum.at(deep, parent[some], deep[some] + 1)
        return pa.table({"root_id": table.column("root_id"), "node_id": table.column("node_id"), "n_nodes": size, "levels": deep})

    return nodes.select("root_id", "node_id", "parent_id", "depth").groupBy("root_id").applyInArrow(run, "root_id int, node_id long, n_nodes long, levels int")
