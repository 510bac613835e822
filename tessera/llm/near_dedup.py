"""Near-duplicate detection with ProbMinHash.

A text is the weighted set of its shingles (five words, A-Z folded), a weight
being a shingle's count. Each shingle sends out a Poisson process of arrivals
at its weight's rate, every arrival at a random register; a register keeps the
shingle that came first, so that two texts agree in a register with their
probability Jaccard similarity. A shingle stops once its next arrival is later
than all registers of the text; most stop at their first.

Registers form bands; texts that agree in a whole band meet in its bucket, and
what meets there is verified by the exact similarity. No bucket is paired off
in full: first every member meets a few leaders (those with the least share of
shingles of their own, then others by hash), links are joined into
components, and just members outside their bucket's largest component are
compared with the rest of it. That loses no component that all pairs of the
bucket would give.

Before any comparison, shingles that no other candidate has bound what is
possible: if shares u and v of two texts' weights are such shingles, their
similarity is at most (1 - u)(1 - v) / (1 - uv). Pairs below the threshold by
this bound are never formed, and a text with more than 1 - threshold of its
own leaves the buckets. In a large group of loosely related copies, whose
pairs are many and nearly all too far apart, this leaves few pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import words as W
from .components import connected_components
from .shared import lean_batches, materialize, numbered_columns, slices

SHINGLE = 5
#: 16 bands of 4: two texts of similarity 0.8 meet with probability 0.9998.
BANDS, ROWS = 16, 4
REGISTERS = BANDS * ROWS
#: Leaders of a bucket in a round: one of each part of its members.
LEADERS = 8
#: Members of a block in the last comparison.
BLOCK = 256

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SIGNED = "nth long, doc long, tag long, d1 long, d2 long, size long, bands array<long>"


def shingles(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 48-bit shingle, count), sorted; a text of fewer than five words is one shingle."""
    k = SHINGLE
    if words.n_rows > 1 << 16:
        raise ValueError("a slice has 65,536 rows at most")
    h, row = W.grams(words.hash, k), words.row[: max(0, len(words.row) - k + 1)]
    inside = W.within(words.row, k)
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < k))
    base = np.concatenate([[0], np.cumsum(counts)])
    whole = [W.grams(words.hash, n)[base[short[counts[short] == n]]] for n in range(1, k)]
    short = np.concatenate([short[counts[short] == n] for n in range(1, k)])
    key = np.concatenate([h[inside], *whole]) >> np.uint64(16)
    key |= np.concatenate([row[inside], short]).astype(np.uint64) << np.uint64(48)
    key.sort()
    first, last = W.runs(key)
    key = key[first]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), last - first


def prob_min_hash(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_rows: int, registers: int = REGISTERS) -> np.ndarray:
    """n_rows x registers: the shingle that arrived first; 0 for a row without shingles."""
    time = np.full(n_rows * registers, np.inf)
    kept = np.zeros(n_rows * registers, np.uint64)
    seed, clock, rate = W.mix(shingle * _GOLDEN + np.uint64(1)), np.zeros(len(row)), weight.astype(np.float64)
    step = 0
    with np.errstate(over="ignore"):
        while len(row):
            step += 1
            draw = W.mix(seed + np.uint64(step) * _GOLDEN)
            clock = clock - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate
            place = row * registers + (draw & np.uint64(registers - 1)).astype(np.int64)
            if step > 1:
                early = clock < time[place]
                np.minimum.at(time, place[early], clock[early])
            else:
                np.minimum.at(time, place, clock)
            won = clock == time[place]
            kept[place[won]] = shingle[won]
            present, where = np.unique(row, return_inverse=True)
            latest = time.reshape(n_rows, registers)[present].max(axis=1)
            go = clock < latest[where]
            row, shingle, seed, clock, rate = row[go], shingle[go], seed[go], clock[go], rate[go]
    return kept.reshape(n_rows, registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """n x BANDS: a key for each band."""
    grouped = signature.reshape(len(signature), BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN
        key = np.broadcast_to(key, grouped.shape[:2])
        for j in range(ROWS):
            key = W.mix(key ^ W.mix(grouped[:, :, j] + np.uint64(j + 1)))
    return key


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([*((n, pa.int64()) for n in ("nth", "doc", "tag", "d1", "d2", "size")), ("bands", pa.list_(pa.int64()))])
    for batch in batches:
        for part in slices(batch, 3):
            words = W.tokenize(part.column(3), W.SPACED_LOWER)
            row, key, count = shingles(words)
            n = words.n_rows
            ends = np.searchsorted(row, np.arange(n + 1))
            with np.errstate(over="ignore"):
                item = W.mix(key * _GOLDEN + count.astype(np.uint64))
                other = W.mix(item ^ _GOLDEN)
            # Sums over a set whose items are hashed each for itself.
            d1, d2 = (np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])[ends]) for x in (item, other))
            size = np.bincount(row, count, n).astype(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(W.signed(band_keys(prob_min_hash(row, key, count, n))).ravel()))
            yield numbered_columns(out, [part.column(0), part.column(1), part.column(2), W.signed(d1), W.signed(d2), size, bands])


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets: sorted elements a, b with weights x, y."""
    both = np.union1d(a, b)
    u, v = np.zeros(len(both)), np.zeros(len(both))
    u[np.searchsorted(both, a)], v[np.searchsorted(both, b)] = x, y
    kinds, n = np.unique(np.stack([u, v], 1), axis=0, return_counts=True)
    u, v = kinds[:, 0], kinds[:, 1]
    shared = (u > 0) & (v > 0)
    if not shared.any():
        return 0.0
    total = np.maximum(u[None, :] / u[shared, None], v[None, :] / v[shared, None]) @ n
    return float((n[shared] / total).sum())


def _pack(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """node, packed shingles and counts of the documents named by chosen (doc, tag, node)."""
    out = pa.schema([("node", pa.int64()), ("packed", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                words = W.tokenize(part.column(1), W.SPACED_LOWER)
                row, key, count = shingles(words)
                ends = np.searchsorted(row, np.arange(words.n_rows + 1))
                # 48 bits of shingle in eight bytes each, then the weights in four bytes each.
                packed = [key[i:j].astype("<u8").tobytes() + count[i:j].astype("<u4").tobytes() for i, j in zip(ends[:-1], ends[1:])]
                yield numbered_columns(out, [part.column(0), packed])

    # Rows with one id and one text are the same node: one of them will do.
    wanted = chosen.select("node", F.col("doc").alias("node_doc"), F.col("tag").alias("node_tag"))
    found = docs.join(wanted, F.col("doc").eqNullSafe(F.col("node_doc")) & (F.col("tag") == F.col("node_tag"))).select("node", "t")
    return found.mapInArrow(pack, "node long, packed binary").dropDuplicates(["node"])


def _own_shares(packed: DataFrame) -> DataFrame:
    """(node, own): the share of each node's weight in shingles that no other node of the table has."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = batch.column(0).to_numpy(), [_unpack(x) for x in batch.column(1).to_pylist()]
            if not len(nodes):
                continue
            sizes = [len(k) for k, _ in sets]
            key, weight, node = np.concatenate([k for k, _ in sets]), np.concatenate([w for _, w in sets]), np.repeat(nodes, sizes)
            order = np.argsort(key, kind="stable")
            first, last = W.runs(key[order])
            one = order[first]
            yield pa.RecordBatch.from_arrays([pa.array(key[one].astype(np.int64)), pa.array(last - first), pa.array(node[one]), pa.array(weight[one].astype(np.int64))], names=["shingle", "n", "node", "weight"])

    each = packed.mapInArrow(spread, "shingle long, n long, node long, weight long")
    alone = each.groupBy("shingle").agg(F.sum("n").alias("n"), F.min("node").alias("node"), F.min("weight").alias("weight")).where("n = 1")
    own = alone.groupBy("node").agg(F.sum("weight").alias("own"))
    total = packed.mapInArrow(_totals, "node long, total long")
    return total.join(own, "node", "left").select("node", (F.coalesce("own", F.lit(0)) / F.col("total")).alias("own"))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(_unpack(x)[1].sum()) for x in batch.column(1).to_pylist()], pa.int64())], names=["node", "total"])


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(packed) // 12
    return np.frombuffer(packed, "<u8", n), np.frombuffer(packed, "<u4", n, 8 * n)


def _verified(pairs: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(a, b, probability_jaccard(*_unpack(p), *_unpack(q))) for a, b, p, q in zip(*(batch.column(i).to_pylist() for i in range(4)))]
            got = [x for x in got if x[2] >= threshold]
            yield numbered_columns(out, [list(c) for c in zip(*got)] if got else [[], [], []])

    left = packed.select(F.col("node").alias("a"), F.col("packed").alias("p"))
    right = packed.select(F.col("node").alias("b"), F.col("packed").alias("q"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q").mapInArrow(verify, "a long, b long, similarity double")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_duplicate_links(spark: SparkSession, rows: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Verified links (a, b) between nodes (node, d1, d2, doc, tag, bands) that join all components of the full graph.

    Members meet new leaders for as long as that leaves a quarter fewer of
    them outside their bucket's largest component than before. Leaders, and a
    bucket's largest of several components, are chosen by d1 and d2, the hashes
    of a node's shingles: a node's number tells nodes apart and decides nothing,
    so that the links don't depend on how the rows were dealt out.
    """
    banded = nodes.select("node", "d1", "d2", F.posexplode("bands").alias("band", "key"))
    bucket = ["band", "key"]
    full = banded.groupBy(*bucket).agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select(*bucket, "n")
    members = materialize(banded.join(materialize(full, "buckets"), bucket), "members")
    chosen = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc", "tag")
    packed = materialize(_pack(rows, chosen), "packed")
    near = materialize(_own_shares(packed).where(F.col("own") <= 1 - threshold + 1e-9), "own-shares")
    members = materialize(members.drop("n").join(near, "node"), "near-members")
    possible = lambda u, v: (1 - F.col(u)) * (1 - F.col(v)) >= (threshold - 1e-9) * (1 - F.col(u) * F.col(v))

    seen = links = component = None
    turn, left = 0, None
    while True:
        placed = members if component is None else members.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # Each member against its bucket's leaders.
        rank = F.struct("own", "d1", "d2") if turn == 0 else F.struct(F.xxhash64("d1", "band", F.lit(turn)), "d1", "d2")
        kept = "component" if component is not None else "node"
        part = F.pmod(F.xxhash64("d1", F.lit(turn + 1)), F.lit(LEADERS)).alias("part")
        top = F.min(F.struct(rank.alias("rank"), F.col("node").alias("leader"), F.col(kept).alias("home"), F.col("own").alias("leader_own"))).alias("top")
        leaders = placed.groupBy(*bucket, part).agg(top, F.min(kept).alias("low"), F.max(kept).alias("high"))
        mixed = leaders.groupBy(*bucket).agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select(*bucket)
        leaders = materialize(leaders.join(mixed, bucket, "left_semi").select(*bucket, "top.leader", "top.home", "top.leader_own"), "leaders")
        pairs = placed.join(leaders, bucket).where(F.col(kept) != F.col("home")).where(possible("own", "leader_own")).select(*_ordered("node", "leader"))
        pairs = pairs.distinct()
        if seen is not None:  # what has met before is settled
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        fresh = materialize(_verified(pairs, packed, threshold), "links")
        links = fresh if links is None else links.unionAll(fresh)
        seen = pairs if seen is None else seen.unionAll(pairs)
        component = materialize(connected_components(links), "components")
        mixed = _mixed(members, component, bucket)
        outside = mixed.where("component <> main").count()
        turn += 1
        if not outside or left is not None and outside > 0.75 * left:
            return links.unionAll(_across(mixed, bucket, packed, possible, threshold))
        left = outside


def _mixed(members: DataFrame, component: DataFrame, bucket: list[str]) -> DataFrame:
    """Members of the buckets that hold more than one component, with their own and the bucket's largest (main)."""
    placed = members.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy(*bucket, "component").agg(F.count("*").alias("count"), F.max(F.struct("d1", "d2")).alias("of"))
    largest = sizes.groupBy(*bucket).agg(F.max(F.struct("count", "of", "component")).alias("top"), F.min("component").alias("low"), F.max("component").alias("high"))
    largest = materialize(largest.where("low < high").select(*bucket, F.col("top.component").alias("main")), "mixed-buckets")
    return materialize(placed.select("node", "own", *bucket, "component").join(largest, bucket), "mixed")


def _across(mixed: DataFrame, bucket: list[str], packed: DataFrame, possible, threshold: float) -> DataFrame:
    """Links between the members outside their bucket's largest component and the rest of the bucket.

    Members without a possible partner go first, by semi-joins of ids alone. The others
    meet in blocks of BLOCK by BLOCK members: a task compares two blocks and
    emits links, never pairs.
    """
    named = lambda df, t: df.select(*bucket, *(F.col(c).alias(f"{t}_{c}") for c in ("node", "own", "component")))
    outside, inside = named(mixed.where("component <> main"), "o"), named(mixed, "i")
    partner = [*(outside[c] == inside[c] for c in bucket), outside["o_component"] != inside["i_component"], possible("o_own", "i_own")]
    outside = materialize(outside.join(inside, partner, "left_semi"), "outside")
    partner = [*(outside[c] == inside[c] for c in bucket), outside["o_component"] != inside["i_component"], possible("o_own", "i_own")]
    inside = materialize(inside.join(outside, partner, "left_semi"), "inside")

    number = lambda df, t: df.groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(f"{t}_blocks"))
    blocks = materialize(number(outside, "o").join(number(inside, "i"), bucket), "blocks")

    keys = [*bucket, "o", "i"]

    def dealt(df: DataFrame, t: str, u: str) -> DataFrame:
        own, other = F.pmod(F.xxhash64(f"{t}_node"), F.col(f"{t}_blocks")).cast("int").alias(t), F.explode(F.sequence(F.lit(0), F.col(f"{u}_blocks") - 1)).alias(u)
        at = df.join(blocks, bucket).select(*bucket, own, other, f"{t}_node", f"{t}_component")
        sets = packed.select(F.col("node").alias(f"{t}_node"), F.col("packed").alias(f"{t}_packed"))
        return at.join(sets, f"{t}_node").select(*(F.col(c).alias(f"{t}_{c}") for c in keys), f"{t}_node", f"{t}_component", f"{t}_packed")

    by = lambda t: [f"{t}_{c}" for c in keys]
    found = dealt(outside, "o", "i").groupBy(*by("o")).cogroup(dealt(inside, "i", "o").groupBy(*by("i"))).applyInArrow(_compare(threshold), "a long, b long, similarity double")
    return materialize(found.groupBy("a", "b").agg(F.first("similarity").alias("similarity")), "links")


def _compare(threshold: float):
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        sets = [_unpack(x) for x in right.column("i_packed").to_pylist()]
        nodes, component = right.column("i_node").to_numpy(), right.column("i_component").to_numpy()
        key, weight = np.concatenate([k for k, _ in sets]), np.concatenate([w for _, w in sets]).astype(np.float64)
        begin = np.cumsum([0, *(len(k) for k, _ in sets)])[:-1]
        total = np.add.reduceat(weight, begin)
        found = []
        for node, home, packed in zip(*(left.column(c).to_pylist() for c in ("o_node", "o_component", "o_packed"))):
            a, x = _unpack(packed)
            at = np.searchsorted(a, key)
            at[at == len(a)] = 0
            both = a[at] == key
            # Shares p and q of the two weights that are common bound the similarity by pq / (p + q - pq).
            p = np.add.reduceat(np.where(both, x[at], 0), begin) / x.sum()
            q = np.add.reduceat(np.where(both, weight, 0), begin) / total
            near = (component != home) & (p * q >= (threshold - 1e-9) * (p + q - p * q)) & (p > 0)
            for i in np.flatnonzero(near):
                j = probability_jaccard(a, x, *sets[i])
                if j >= threshold:
                    found.append((min(node, int(nodes[i])), max(node, int(nodes[i])), j))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), out.types)], schema=out) if found else out.empty_table()

    return compare


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per document: id, class_id, group_id, kept, text_tag, n_links, similarity.

    class_id is the smallest id with the same shingles and counts; group_id
    the smallest id among all documents that links of similarity `threshold`
    or more connect. One row of each group is kept: the one with the smallest
    id (a null id is last; among repeated rows one). n_links and similarity:
    how many links of the document's class to other classes were verified, and
    the greatest of their similarities (null without a link); they join every
    group, but are not all pairs of it. Both depend on the texts alone, not on
    partitions or order.

    A null or empty text, or one without words, has no shingles: all these are
    one class and link to nothing else. A text of fewer than five words is one
    shingle. Texts of any length are read whole. Ids are whole numbers. Other
    columns are ignored, so their names cannot clash. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("nth"), F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("tag"), text.alias("t"))
    signed = materialize(rows.mapInArrow(_signatures, _SIGNED), "signatures")
    same, order = ["d1", "d2", "size"], [F.col("doc").isNull().alias("no_id"), F.col("doc")]
    classes = signed.groupBy(*same).agg(F.min(F.struct(*order, "nth", "tag")).alias("lead"), F.first("bands").alias("bands"))
    classes = materialize(classes.select(*same, F.col("lead.nth").alias("node"), F.col("lead.doc").alias("doc"), F.col("lead.tag").alias("tag"), "bands"), "classes")
    links = materialize(near_duplicate_links(spark, rows.drop("nth"), classes.where("size > 0").select("node", "d1", "d2", "doc", "tag", "bands"), threshold), "all-links")
    component = materialize(connected_components(links), "components")
    ends = links.select(F.explode(F.array("a", "b")).alias("node"), "similarity")
    linked = ends.groupBy("node").agg(F.count("*").alias("n_links"), F.max("similarity").alias("similarity"))
    joined = classes.join(component, "node", "left").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = joined.groupBy("component").agg(F.min(F.struct(*order, "node")).alias("top"))
    final = joined.join(groups, "component").select(*same, F.col("doc").alias("class_id"), F.col("top.doc").alias("group_id"), F.col("top.node").alias("keep"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "similarity")
    return signed.drop("bands").join(materialize(final, "groups"), same).select(
        F.col("doc").alias("id"), "class_id", "group_id", (F.col("nth") == F.col("keep")).alias("kept"), F.col("tag").alias("text_tag"), "n_links", "similarity"
    )
