"""Choosing how two tables of boxes meet.

nested  one side is broadcast after a check of its estimated size; the
        predicate runs inside the generated code of the nested-loop join.
cells   both sides are large: boxes go to the cells of a grid whose level fits
        their extent, and meet by an equi-join on (level, cell). A pair is
        kept in just the cell that holds the least corner of its overlap, so
        no distinct is needed. AQE splits crowded cells. Joins that test pairs
        themselves (operators.boxes) deal the cells to tasks instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from ..functions import bounds
from ..functions.vectors import AXES

#: A side is broadcast up to this estimate; beyond it the pair meets by cells.
BROADCAST_BYTES = 64 << 20
#: Pairs of rows that a nested loop over boxes may try, by estimate.
NESTED_PAIRS = 4_000_000_000
#: Estimates from here on are products of defaults, as for tables made from local rows.
UNKNOWN_BYTES = 1 << 60
#: Kernels hold a broadcast index of at most this many primitive rows, which the driver builds in about a second; beyond it they work by tiles.
TREE_ROWS = 250_000
#: Finest and coarsest cell sizes are powers of two with these exponents.
LEVELS = (-30, 1000)
#: What names a cell of the grid: a power of two for its size, and its place along the axes.
CELL = ["level", *(f"cell_{c}" for c in AXES)]
#: Rows that are not dealt out to more than one task.
LEAST_PART = 2_000


def _estimate(df: DataFrame) -> int:
    """Catalyst's estimate; UNKNOWN_BYTES for any beyond, which joins of unknown sizes multiply to thousands of digits."""
    try:
        return min(UNKNOWN_BYTES, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    except ValueError:  # more digits than Python reads
        return UNKNOWN_BYTES


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df's result, or a count of its rows where Catalyst has no idea."""
    size = _estimate(df)
    return size if size < UNKNOWN_BYTES else counted_bytes(df)


def counted_bytes(df: DataFrame) -> int:
    """The size of a table of numbers by a count of its rows."""
    return df.count() * (16 + 8 * len(df.columns))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return estimated_bytes(df) <= limit


def bounded(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A table that is small by its meaning, with its size checked: an error beyond `rows`."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"a table meant to be small has more than {rows} rows")
    return df.sparkSession.createDataFrame(found, df.schema)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it is so small that its files may make a few tasks only."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _estimate(df) < cores * (16 << 20) else df


def cross_small(left: DataFrame, right: DataFrame) -> DataFrame | None:
    """left x right with the smaller of the small sides broadcast, or None if neither is small."""
    a, b = estimated_bytes(left), estimated_bytes(right)
    if min(a, b) > BROADCAST_BYTES:  # an estimate may be far too high: Catalyst knows neither arrays' lengths nor what a condition leaves
        a, b = counted_bytes(left), counted_bytes(right)
        if min(a, b) > BROADCAST_BYTES:
            return None
    return spread(left).crossJoin(F.broadcast(right)) if b <= a else F.broadcast(left).crossJoin(spread(right))


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """left x right of any sizes: where neither side can be sent to all tasks, each task pairs a part of the one with a part of the other."""
    pairs = cross_small(left, right)
    return left.crossJoin(right) if pairs is None else pairs


def _levelled(df: DataFrame, p: str) -> DataFrame:
    extent = F.expr("greatest(" + ", ".join(f"{p}max{c} - {p}min{c}" for c in AXES) + ")")
    level = F.when(extent <= 2.0 ** LEVELS[0], F.lit(LEVELS[0])).otherwise(F.least(F.ceil(F.log2(extent)).cast("int"), F.lit(LEVELS[1])))
    return df.withColumn(f"{p}level", level)


def _in_cells(df: DataFrame, p: str, theirs: set[int]) -> DataFrame:
    """A row for each cell the box touches, at its own level, where finer boxes of the other side look for it, and at the coarser levels of the other side."""
    coarser = F.filter(F.array([F.lit(x) for x in sorted(theirs)]), lambda x: x > F.col(f"{p}level"))
    own = F.when(F.col(f"{p}level") >= min(theirs), F.array(f"{p}level")).otherwise(F.array().cast("array<int>"))
    at = df.withColumn("level", F.explode(F.concat(own, coarser)))
    size = F.pow(F.lit(2.0), F.col("level"))
    for c in AXES:
        at = at.withColumn(f"cell_{c}", F.explode(F.sequence(F.floor(F.col(f"{p}min{c}") / size), F.floor(F.col(f"{p}max{c}") / size))))
    return at


def celled(left: DataFrame, right: DataFrame, a: str = "a_", b: str = "b_") -> tuple[DataFrame, DataFrame]:
    """Both sides with their level and CELL, a row for each cell they are to be looked for in.

    The tenth of the boxes that is finest goes to the cells of the finest of the rest: a hierarchy finds them there.
    """
    left, right = _levelled(left, a), _levelled(right, b)
    counts = [{r[0]: r[1] for r in df.groupBy(f"{p}level").count().collect()} for df, p in ((left, a), (right, b))]  # one of each level at most
    if not all(counts):
        return tuple(df.limit(0).withColumns({"level": F.lit(0), **{f"cell_{c}": F.lit(0).cast("long") for c in AXES}}) for df in (left, right))
    finest = max(next(x for x in sorted(n) if 10 * sum(n[y] for y in n if y <= x) > sum(n.values())) for n in counts)
    left, right = (df.withColumn(f"{p}level", F.greatest(f"{p}level", F.lit(finest))) for df, p in ((left, a), (right, b)))
    mine, theirs = ({max(x, finest) for x in n} for n in counts)
    return _in_cells(left, a, theirs), _in_cells(right, b, mine)


def cell_join(left: DataFrame, right: DataFrame, a: str = "a_", b: str = "b_") -> DataFrame:
    """All pairs of overlapping boxes (columns a_minx.., b_minx..) by an equi-join on grid cells."""
    left, right = _levelled(spread(left), a), _levelled(spread(right), b)
    mine = {r[0] for r in left.select(f"{a}level").distinct().collect()}  # one of each level at most
    theirs = {r[0] for r in right.select(f"{b}level").distinct().collect()}
    if not mine or not theirs:
        return left.crossJoin(right).limit(0).drop(f"{a}level", f"{b}level")
    left, right = _in_cells(left, a, theirs), _in_cells(right, b, mine)
    # Boxes of a cell's own level meet all, finer ones just those: two of them meet in a finer cell.
    met = left.where(f"{a}level = level").join(right, CELL)
    if min(mine) < max(theirs):
        met = met.unionByName(left.where(f"{a}level < level").join(right.where(f"{b}level = level"), CELL))
    met = met.where(F.expr(bounds.overlap(a, b)))
    size = F.pow(F.lit(2.0), F.col("level"))
    for c in AXES:  # the cell with the least corner of the overlap owns the pair
        met = met.where(F.col(f"cell_{c}") == F.floor(F.greatest(f"{a}min{c}", f"{b}min{c}") / size))
    return met.drop(*CELL, f"{a}level", f"{b}level")


def _known(df: DataFrame, p: str) -> DataFrame:
    """df with bounds that are never null (NaN overlaps nothing): else the optimizer would test for nulls below all that computes them, and so compute it twice."""
    return df.withColumns({f"{p}{f}{c}": F.coalesce(F.col(f"{p}{f}{c}").cast("double"), F.lit(float("nan"))) for f in ("min", "max") for c in AXES})


def _rows(df: DataFrame) -> int:
    return estimated_bytes(df) // (8 * len(df.columns)) + 1


def dealt(left: DataFrame, right: DataFrame, key: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column `part`: rows of `left` with one key go to as many parts as it takes for at most about `limit` each, rows of `right` to each of them.

    Keys that `left` does not have are left out of `right`.
    """
    counts = left.groupBy(*key).count()
    # Where a few keys hold all rows there are parts for all cores, four for each, though none for a few rows.
    share = F.greatest(F.lit(min(limit, LEAST_PART)), F.ceil(F.sum("count") / (4 * left.sparkSession.sparkContext.defaultParallelism)))
    counts = counts.crossJoin(F.broadcast(counts.agg(F.least(F.lit(limit), share).alias("most"))))
    parts = counts.select(*(F.col(k).alias(f"of_{k}") for k in key), F.ceil(F.col("count") / F.col("most")).cast("int").alias("parts"))
    on = lambda df: reduce(lambda x, y: x & y, [df[k] == F.col(f"of_{k}") for k in key])
    # A hash of three columns: what is inferred of one of all columns doubles with each that gets another name, and takes the optimizer minutes.
    spread_ = F.pmod(F.xxhash64(*[c for c in left.columns if c not in key][:3]), F.col("parts")).cast("int").alias("part")
    return left.join(parts, on(left)).select(*left.columns, spread_), right.join(parts, on(right)).select(*right.columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def streamed(left: DataFrame, right: DataFrame, keys: list[str], run: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """Rows of `ddl` that run(left, right) yields for the rows of both sides with one key, without the keys.

    As a cogroup, but what is found leaves batch by batch, however much it is: a task holds the two sides alone.
    """
    rest = {t: [c for c in df.columns if c not in keys] for t, df in (("l", left), ("r", right))}
    kinds = {t: dict(df.dtypes) for t, df in (("l", left), ("r", right))}
    shown = lambda t, own: [(F.col(c) if own else F.lit(None).cast(kinds[t][c])).alias(f"{t}_{c}") for c in rest[t]]
    both = left.select(*keys, F.lit(False).alias("of_right"), *shown("l", True), *shown("r", False)).unionAll(right.select(*keys, F.lit(True).alias("of_right"), *shown("l", False), *shown("r", True)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict = {"l": [], "r": []}
        for batch in batches:
            for t, on in (("l", pa.compute.invert(batch.column("of_right"))), ("r", batch.column("of_right"))):
                some = batch.filter(on)
                if some.num_rows:
                    parts[t].append(pa.RecordBatch.from_arrays([some.column(f"{t}_{c}") for c in rest[t]], names=rest[t]))
        if parts["l"] and parts["r"]:
            yield from run(*(pa.Table.from_batches(parts[t]).combine_chunks() for t in "lr"))

    # A fixed number of partitions: AQE would merge them by their bytes, which say little about the work.
    return both.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).groupBy(*keys).applyInArrow(each, ddl)


def nested_join(left: DataFrame, right: DataFrame, a: str = "a_", b: str = "b_") -> DataFrame | None:
    """All pairs of overlapping boxes by a nested loop, or None where there are too many pairs or neither side is small."""
    left, right = _known(left, a), _known(right, b)
    crossed = cross_small(left, right) if _rows(left) * _rows(right) <= NESTED_PAIRS else None
    return None if crossed is None else crossed.where(F.expr(bounds.overlap(a, b)))


def box_join(left: DataFrame, right: DataFrame, a: str = "a_", b: str = "b_", strategy: str = "auto") -> DataFrame:
    """All pairs of overlapping boxes; the strategy changes the plan, never the rows."""
    if strategy == "auto":
        pairs = nested_join(left, right, a, b)
        if pairs is not None:
            return pairs
    left, right = _known(left, a), _known(right, b)
    if strategy == "nested":
        crossed = cross_small(left, right)
        if crossed is None:
            raise ValueError("neither side is small enough to broadcast")
        return crossed.where(F.expr(bounds.overlap(a, b)))
    return cell_join(left, right, a, b)
