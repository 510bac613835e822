"""Hard negatives by a vector-approximation file.

Rows are packed into blocks. In a block each dimension is quantised into cells
between quantiles of its own values; the file holds a byte per component, the
least and greatest value of each cell, and the exact vectors. For an anchor a
table gives each cell's least and greatest product with the anchor's component,
so that adding up one entry for each dimension bounds a row's score from below
and above. Exact products are computed only for rows whose bounds let them
enter: the first positives, or a window below a positive.

Blocks of rows meet blocks of anchors, each pair as one small row of its own,
so no key gathers rows, and neither anchors nor rows pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .shared import lean_batches, materialize

#: Rows of a block, and anchors of one.
BLOCK_ROWS, BLOCK_ANCHORS = 4096, 2048
#: Cells of a dimension: at most 256, as a code is a byte.
CELLS = 64
#: Quantised components are below this, so that sums of products stay within 64 bits.
LARGEST = 1 << 24
#: Stands for a null id, as such ids come last.
_NO_ID = np.iinfo(np.int64).max

_BLOCK = "block int, n int, width int, ids binary, labels binary, vectors binary, codes binary, edges binary"
_PACKED = pa.schema([("block", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "vectors", "codes", "edges"))])


def quantised(vector: str) -> str:
    """SQL: floor(256 * component) of each, as whole numbers."""
    return f"transform({vector}, x -> cast(floor(256 * cast(x as double)) as bigint))"


def cells_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes: dimensions x rows, edges: least and greatest value of each cell, 2 x dimensions x CELLS)."""
    n, width = x.shape
    codes, edges = np.zeros((width, n), np.uint8), np.zeros((2, width, CELLS), np.int64)
    for d in range(width):
        column = x[:, d]
        cuts = np.unique(np.quantile(column, np.arange(1, CELLS) / CELLS, method="lower"))
        code = np.searchsorted(cuts, column, side="right")
        codes[d] = code
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        there = code[order][first]
        edges[0, d, there] = np.minimum.reduceat(column[order], first)
        edges[1, d, there] = np.maximum.reduceat(column[order], first)
    return codes, edges


def _packed(with_cells: bool) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        vectors = table.column("x").combine_chunks()
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        width = int(sizes.max())
        x = np.zeros((len(sizes), width), np.int64)  # what a shorter vector lacks is 0
        x[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = vectors.flatten().to_numpy()
        if len(x) and width and np.abs(x).max() >= LARGEST:
            raise ValueError(f"a component times 256 is {LARGEST} or more")
        ids = table.column("id").combine_chunks().fill_null(_NO_ID).to_numpy()
        labels = table.column("label").to_numpy().astype(np.int64)
        order = np.lexsort((ids, labels))
        ids, labels, x = ids[order], labels[order], x[order]
        codes, edges = cells_of(x) if with_cells else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
        told = [ids, labels, x.astype(np.int32), codes, edges]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([width], pa.int32()), *(pa.array([a.tobytes()]) for a in told)], schema=_PACKED)

    return pack


def _blocks(rows: DataFrame, count: int, with_cells: bool, label: str) -> DataFrame:
    """So many blocks of rows (id, label, x), dealt evenly; stored."""
    return materialize(rows.repartition(count).mapInArrow(_packed(with_cells), _BLOCK), label)


class Block:
    """A block as arrays: rows in order of label and id."""

    def __init__(self, row: dict, p: str):
        n, width = row[f"{p}n"], row[f"{p}width"]
        self.ids, self.labels = (np.frombuffer(row[f"{p}{c}"], np.int64) for c in ("ids", "labels"))
        self.vectors = np.frombuffer(row[f"{p}vectors"], np.int32).reshape(n, width)
        self.codes = np.frombuffer(row[f"{p}codes"], np.uint8).reshape(-1, n)
        self.edges = np.frombuffer(row[f"{p}edges"], np.int64).reshape(2, -1, CELLS)

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, side="right"))

    def bounds(self, anchor: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that the codes of rows low..high allow, by a look at a table of CELLS entries for each dimension."""
        least, most = (np.zeros(high - low, np.int64) for _ in range(2))
        shared = min(len(anchor), len(self.codes))
        products = self.edges[:, :shared] * anchor[None, :shared, None]
        below, above = products.min(0), products.max(0)
        found = np.empty(high - low, np.int64)
        for d in range(shared):
            codes = self.codes[d, low:high]
            least += np.take(below[d], codes, out=found, mode="clip")
            most += np.take(above[d], codes, out=found, mode="clip")
        return least, most

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        shared = min(len(anchor), self.vectors.shape[1])
        return self.vectors[rows, :shared].astype(np.int64) @ anchor[:shared]


def _greatest(values: np.ndarray, k: int) -> int | None:
    """The k-th greatest, None if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def first_positives(block: Block, anchor: np.ndarray, anchor_id: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k best rows of a label, but for those with the anchor's id; only rows whose upper bound reaches the k-th lower one are scored."""
    low, high = block.of_label(label)
    if low == high:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, most = block.bounds(anchor, low, high)
    other = block.ids[low:high] != anchor_id
    floor = _greatest(least[other], k)
    rows = low + np.flatnonzero(other & (most >= floor) if floor is not None else other)
    return best(block, rows, block.scores(anchor, rows), k)


def best(block: Block, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((block.ids[rows], -scores))[:k]
    return rows[order], scores[order]


def window_negatives(block: Block, anchor: np.ndarray, label: int, tops: list[int], share: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each score of a positive: (rows, scores) of the k best rows of other labels whose score lies in the window below it.

    A row surely inside raises the floor of those that come after it; only rows
    that may lie inside and whose upper bound reaches the floor are scored, once for all windows.
    """
    low, high = block.of_label(label)
    spans = [block.bounds(anchor, i, j) for i, j in ((0, low), (high, len(block.ids)))]
    rows = np.concatenate([np.arange(low), np.arange(high, len(block.ids))])
    least, most = (np.concatenate(x) for x in zip(*spans))
    wanted, chosen = np.zeros(len(rows), bool), []
    for top in tops:
        bottom = -((-share * top) // 100)
        may = (most >= bottom) & (least <= top)
        floor = _greatest(least[(least >= bottom) & (most <= top)], k)
        chosen.append((bottom, top, may if floor is None else may & (most >= floor)))
        wanted |= chosen[-1][2]
    at = np.flatnonzero(wanted)
    exact = np.zeros(len(rows), np.int64)
    exact[at] = block.scores(anchor, rows[at])
    out = []
    for bottom, top, may in chosen:
        inside = np.flatnonzero(may & (exact >= bottom) & (exact <= top))
        out.append(best(block, rows[inside], exact[inside], k))
    return out


#: An anchor is numbered by its block and its place there.
_PLACES = 1 << 20
_FOUND = pa.schema([(c, pa.int64()) for c in ("anchor", "anchor_id", "top", "found_id", "score")])


def _meet(file: DataFrame, anchors: DataFrame, blocks: int, search: Callable[[Block, Block, dict], Iterator[tuple]]) -> DataFrame:
    """search(block, block of anchors, their row) -> (place of the anchor, top, rows, scores), for every block with every block of anchors.

    Anchors, a hundredth of the rows, are copied to the blocks by number: a
    pair of blocks is a group of its own.
    """
    sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("block").alias("slot"), *(F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "block"))
    pairs = file.join(sent.hint("merge"), "block")

    def run(table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        block, asked = Block(row, ""), Block(row, "a_")
        found = [(row["slot"] * _PLACES + place, asked.ids[place], top, block.ids[rows], scores) for place, top, rows, scores in search(block, asked, row) if len(rows)]
        if not found:
            return _FOUND.empty_table()
        sizes = [len(f[3]) for f in found]
        columns = [np.repeat(np.array([f[i] for f in found], np.int64), sizes) for i in range(3)] + [np.concatenate([f[i] for f in found]) for i in (3, 4)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=_FOUND)

    return pairs.groupBy("block", "slot").applyInArrow(run, ", ".join(f"{n} long" for n in _FOUND.names))


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, share: int = 80, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of the vectors, each component taken as floor(256
    x); higher ones come first, of equal ones the smaller id, a null id last.
    Anchors are the rows whose id `every` divides. An anchor's positives are
    the first rows of its label with another id; for each of them the result has the
    first rows of other labels whose score is no more than the positive's and
    no less than `share` hundredths of it, ranked from 1. A positive of a
    negative score has none.

    Rows with a null label, a null vector, or a component that is null or not
    finite take no part. A vector that is shorter than another counts as filled
    up with zeros, so an empty one scores 0. Repeated rows are rows of their own: as
    anchors each has results, but a row with an anchor's id is never its
    positive. A component times 256 of 2^24 or more is an error. Ids and labels are
    whole numbers. Other columns are ignored, so their names cannot clash. An
    empty table gives an empty result.
    """
    lean_batches(rows.sparkSession)
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    valid = named.where("label is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(cast(x as double)) = double('infinity'))")
    taken = materialize(valid.select("id", "label", F.expr(quantised("v")).alias("x")), "vectors")
    blocks = max(1, -(-taken.count() // BLOCK_ROWS))
    file = _blocks(taken, blocks, True, "approximations")
    asked = taken.where(F.col("id") % every == 0)
    anchors = _blocks(asked, max(1, -(-asked.count() // BLOCK_ANCHORS)), False, "anchors")

    def of_positives(block: Block, asked: Block, row: dict) -> Iterator[tuple]:
        for place, (anchor, own, label) in enumerate(zip(asked.vectors.astype(np.int64), asked.ids, asked.labels)):
            yield (place, 0, *first_positives(block, anchor, own, label, positives))

    good = materialize(_first(_meet(file, anchors, blocks, of_positives), ["anchor"], positives), "positives")
    tops = good.groupBy("anchor").agg(F.collect_set("score").alias("tops"))  # as many as positives at most
    slot, place = F.floor(F.col("anchor") / _PLACES).cast("int").alias("block"), (F.col("anchor") % _PLACES).cast("int").alias("place")
    windows = tops.groupBy(slot).agg(F.collect_list(F.struct(place, "tops")).alias("windows"))  # of the anchors of one block

    def of_negatives(block: Block, asked: Block, row: dict) -> Iterator[tuple]:
        for window in row["a_windows"]:
            place = window["place"]
            above = [t for t in window["tops"] if t >= 0]
            found = window_negatives(block, asked.vectors[place].astype(np.int64), asked.labels[place], above, share, negatives) if above else []
            yield from ((place, top, *one) for top, one in zip(above, found))

    bad = _first(_meet(file, anchors.join(windows, "block"), blocks, of_negatives), ["anchor", "top"], negatives)
    told = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    pairs = good.select(F.col("anchor"), F.col("score").alias("top"), told("found_id").alias("positive_id"))
    out = bad.withColumn("negative_id", told("found_id")).join(pairs, ["anchor", "top"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("top").alias("positive_score"), F.col("score").alias("negative_score"))
