"""Minimax contiguous sharding (DataFrame functions only).

Documents with equal texts form one atomic group; groups are ordered by their
smallest id and laid end to end, so a group ends at a prefix sum of sizes. The
smallest shard capacity that lets `shards` contiguous pieces hold everything is
found by binary search, each capacity checked greedily: a shard takes groups
while they fit.

Many cuts keep every shard within that capacity, and the largest shard of each
of them has just that size, as no smaller one is feasible. Of these cuts those
are taken that are nearest to equal parts, rather than the greedy walk's own,
which would fill the first shards and leave the last ones empty.

The ends stay in a table. The driver sees at most `resolution` buckets of them,
each with its smallest and largest end. Greedy walks over the buckets' lower
and upper bounds prove a capacity feasible or infeasible; where they can't
tell, just the buckets that the walks touch are read again at a finer width.
The result is exact at any size, and the driver's share doesn't grow.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import materialize, small_table

#: Bytes counted for a row besides its text.
ROW_BYTES = 16


class Ends:
    """What the driver knows of the sorted group ends: buckets of 2^shift bytes with their least and greatest end."""

    def __init__(self, total: int, read: Callable[[int, int | None, list[int] | None], list[tuple[int, int, int]]], resolution: int):
        self.total, self.read, self.resolution = total, read, resolution
        self.shift = max(0, total.bit_length() - resolution.bit_length() + 1)
        self.buckets = {(self.shift, k): (lo, hi) for k, lo, hi in read(self.shift, None, None)}
        self._index()

    def _index(self) -> None:
        self.order = sorted((lo, hi, key) for key, (lo, hi) in self.buckets.items())
        self.lows, self.highs = [x[0] for x in self.order], [x[1] for x in self.order]

    def before(self, x: int) -> tuple[int, int]:
        """Bounds of the greatest end <= x (0 if there is none)."""
        i = bisect_right(self.lows, x) - 1
        if i < 0:
            return 0, 0
        low, high, _ = self.order[i]
        return (high, high) if high <= x else (low, x)

    def known_from(self, x: int) -> int:
        """The least end >= x that is known by value."""
        i = bisect_left(self.highs, x)
        low, high, _ = self.order[min(i, len(self.order) - 1)]
        return low if low >= x else high

    def walk(self, capacity: int, shards: int, upper: bool) -> list[int]:
        at, cuts = 0, []
        for _ in range(shards):
            at = self.before(at + capacity)[upper]
            cuts.append(at)
        return cuts

    def refine(self, spans: list[tuple[int, int]]) -> bool:
        """Read the open buckets at the finest shift within the spans again, finer; False if there are none."""
        touched = {key for a, b in spans for _, _, key in self.order[max(0, bisect_left(self.highs, a)) : bisect_right(self.lows, b)] if self.buckets[key][0] < self.buckets[key][1]}
        if not touched:
            return False
        shift = max(s for s, _ in touched)
        keys = [k for s, k in touched if s == shift]
        finer = max(0, shift - max(1, (self.resolution // len(keys)).bit_length() - 1))
        fresh = self.read(finer, shift, keys)
        for k in keys:
            del self.buckets[shift, k]
        self.buckets.update({(finer, k): (lo, hi) for k, lo, hi in fresh})
        self._index()
        return True


def smallest_capacity(ends: Ends, shards: int, largest: int) -> int:
    """The least capacity at which a greedy walk of `shards` steps reaches the total."""
    while True:
        def least(upper: bool) -> int:
            lo, hi = max(largest, -(-ends.total // shards)) - 1, ends.total
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if ends.walk(mid, shards, upper)[-1] >= ends.total else (mid, hi)
            return hi

        sure, maybe = least(False), least(True)
        if sure == maybe:
            return sure
        low, high = ends.walk(maybe, shards, False), ends.walk(sure, shards, True)
        if not ends.refine(list(zip(low, high))):
            return sure


def balanced_cuts(ends: Ends, shards: int, capacity: int) -> list[int]:
    """Ends of the shards: none over the capacity, each near an equal part of what is left."""
    must = [ends.total] * (shards + 1)  # where shard j must end at least, so that the rest still fits
    for j in range(shards - 1, 0, -1):
        must[j] = ends.known_from(must[j + 1] - capacity) if must[j + 1] > capacity else 0
    if must[1] > capacity:
        return ends.walk(capacity, shards, False)
    cuts, at = [], 0
    for j in range(1, shards):
        target = at + -(-(ends.total - at) // (shards - j + 1))
        over, under = ends.known_from(target) if target < ends.total else ends.total, ends.before(target)[0]
        end = over if over - at <= capacity and over - target < target - under else under
        at = max(at, end, must[j])
        cuts.append(at)
    return [*cuts, ends.total]


def _numbered(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """df written with its range partition's number as `part`, ordered by the columns."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), label)


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", resolution: int = 1 << 16) -> DataFrame:
    """One row per document: id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    The largest shard is as small as contiguous shards of whole groups can be.
    A null text is empty. Rows with equal texts share a shard. Slots count a
    shard's rows from 0 by id; null ids come first and repeated ids in any
    order. With fewer groups than shards some shards stay empty. A text of any
    length is one group's. Other columns are ignored, so their names cannot
    clash. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("nth"), F.unhex(F.sha2(text, 256)).alias("digest"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = materialize(rows, "shard-rows")
    groups = rows.groupBy("digest").agg(F.min("id").alias("lead"), F.sum("size").alias("group_bytes"))
    groups = _numbered(groups, ["lead", "digest"], "shard-groups")
    ends = _ends(groups)
    total, largest = ends.agg(F.max("end"), F.max("group_bytes")).first()
    cuts = _cuts(ends, total, largest, shards, resolution) if total else []
    start = F.col("end") - F.col("group_bytes")
    shard = reduce(lambda a, b: a + b, [(start >= c).cast("int") for c in cuts[:-1]], F.lit(0))
    placed = rows.join(materialize(ends.select("digest", shard.alias("shard")), "shard-places"), "digest")
    return _slots(placed).select("id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _ends(groups: DataFrame) -> DataFrame:
    """Each group's end: the prefix sum of sizes over (lead, digest), by parts and then over the parts' sums."""
    spark = groups.sparkSession
    sums = sorted(groups.groupBy("part").agg(F.sum("group_bytes")).collect())  # a row per shuffle partition
    offsets, at = [], 0
    for part, size in sums:
        offsets.append((part, at))
        at += size
    offset = small_table(spark, offsets, "part int, offset long")
    inside = Window.partitionBy("part").orderBy("lead", "digest").rowsBetween(Window.unboundedPreceding, 0)
    running = groups.withColumn("end", F.sum("group_bytes").over(inside))
    placed = running.join(F.broadcast(offset), "part").select("digest", "group_bytes", (F.col("end") + F.col("offset")).alias("end"))
    return materialize(placed, "shard-ends")


def _cuts(ends: DataFrame, total: int, largest: int, shards: int, resolution: int) -> list[int]:
    spark: SparkSession = ends.sparkSession

    def read(shift: int, coarse: int | None, keys: list[int] | None) -> list[tuple[int, int, int]]:
        found = ends.select("end")
        if keys is not None:  # at most `resolution` keys
            wanted = small_table(spark, [(k,) for k in keys], "coarse long")
            found = found.withColumn("coarse", F.shiftright("end", coarse)).join(F.broadcast(wanted), "coarse", "left_semi")
        return [tuple(r) for r in found.groupBy(F.shiftright("end", shift).alias("key")).agg(F.min("end"), F.max("end")).collect()]

    known = Ends(total, read, resolution)
    return balanced_cuts(known, shards, smallest_capacity(known, shards, largest))


def _slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0, by range parts, so that a shard or group of any size spreads."""
    spark = placed.sparkSession
    rows = _numbered(placed, ["shard", "id", "nth"], "shard-slots")
    offsets, at, last = [], 0, None
    for shard, part, n in sorted(rows.groupBy("shard", "part").count().collect()):  # at most shards + shuffle partitions
        at = at if shard == last else 0
        offsets.append((shard, part, at))
        at, last = at + n, shard
    offset = small_table(spark, offsets, "shard int, part int, offset long")
    inside = Window.partitionBy("part", "shard").orderBy("id", "nth")
    return rows.withColumn("nr", F.row_number().over(inside)).join(F.broadcast(offset), ["shard", "part"]).withColumn("slot", F.col("nr") - 1 + F.col("offset"))
