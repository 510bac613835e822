"""Structured Streaming forms of index maintenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.vectors import AXES
from ..operators.index import leaves_of, refit
from ..plans.durable import cut


def running_bounds(points: DataFrame, key: str, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bounds of the points (key, time, x, y, z) by key and time window; windows close once the watermark has passed."""
    timed = points.withWatermark(time, late) if points.isStreaming else points
    made = timed.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n"), *(f(c).alias(f"{n}{c}") for n, f in (("min", F.min), ("max", F.max)) for c in AXES))
    return made.select(F.col("w.start").alias("window_start"), key, "n", *(f"{n}{c}" for n in ("min", "max") for c in AXES))


def latest(changes: DataFrame, key: str, at: str | None = None) -> DataFrame:
    """One row for each key: the one with the greatest `at` (of equal ones, or without `at`, the greatest of the other columns)."""
    rest = [c for c in changes.columns if c not in (key, at)]
    order = F.struct(*([at] if at else []), *rest)
    return changes.groupBy(key).agg(F.max(order).alias("m")).select(key, "m.*").select(changes.columns)


def maintain(changes: DataFrame, load: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], store: Callable[[DataFrame, DataFrame], None], at: str | None = None) -> DataStreamWriter:
    """Refit an index per micro-batch of changed boxes (box_id, minx..maxz).

    load gives (nodes, order, boxes) as stored last; store takes the nodes and the
    boxes as they are from then on, so that a later batch that touches the same
    leaves finds what this one has moved. Just the leaves of changed boxes and
    their ancestors are computed anew. Of several rows of a box in one batch the one with the greatest `at`
    counts. Boxes that the index doesn't have are left out: they need a rebuild.
    """

    def apply(batch: DataFrame, _: int) -> None:
        nodes, order, boxes = load()
        fresh = latest(batch, "box_id", at).select(boxes.columns).join(order.select("box_id"), "box_id", "left_semi")
        now = cut(boxes.join(fresh.select("box_id"), "box_id", "left_anti").unionByName(fresh))
        store(refit(nodes, order, now, leaves_of(nodes, order, fresh)), now)

    return changes.writeStream.foreachBatch(apply).outputMode("update")


class _Changes(StatefulProcessor):
    """Remembers the last values of each key, and passes on a newer row that differs from them."""

    def __init__(self, key: str, at: str, schema: StructType):
        self.key, self.at, self.schema = key, at, schema
        self.kept = [f.name for f in schema.fields if f.name != key]

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [f for f in self.schema.fields if f.name != self.key]
        self.state = handle.getValueState("last", StructType(fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.state.get() if self.state.exists() else None
        place, out = self.kept.index(self.at), None
        for frame in rows:
            for row in frame[self.kept].sort_values(self.at).itertuples(index=False):
                told = tuple(x.tolist() if hasattr(x, "tolist") else x for x in row)
                if last is None or told[place] > last[place]:
                    new = last is None or any(a != b for i, (a, b) in enumerate(zip(told, last)) if i != place)
                    last, out = told, told if new or out is not None else out
        if last is not None:
            self.state.update(last)
        if out is not None:
            yield pd.DataFrame([(key[0], *last)], columns=[self.key, *self.kept])[[f.name for f in self.schema.fields]]

    def close(self) -> None:
        pass


def changed_rows(updates: DataFrame, key: str, at: str) -> DataFrame:
    """The updates (key, at, values) that change something, by state kept for each key.

    Of each key and micro-batch the row with the greatest `at` passes on, if
    it is later than all that came before and its values differ from the last
    ones; a late or repeated update passes nothing on. The values are numbers or
    texts. The session needs a state store for
    transformWithState, as RocksDB's.
    """
    schema = updates.schema
    return updates.groupBy(key).transformWithStateInPandas(_Changes(key, at, schema), outputStructType=schema, outputMode="Update", timeMode="None")


def visible_transforms(updates: DataFrame, objects: DataFrame) -> DataFrame:
    """Stream-static join of transform updates (object_id, matrix) with objects (object_id, geom_id, visible)."""
    return updates.join(objects.where("visible").select("object_id", "geom_id"), "object_id")
