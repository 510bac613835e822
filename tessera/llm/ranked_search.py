"""Ranked lexical search by Fagin's threshold algorithm.

The corpus is read once into a forward index: for each document its length and
the terms of the queries that it holds, with their counts. Statistics over all
documents then turn counts into impacts, and every task searches its documents
in shards. A shard has one list for each term, sorted by impact, which are read
round-robin, some places of each list at a time; a document that a list shows
for the first time is looked up in the forward index, which gives its whole
score for every query that is still open. The impacts last read in a query's
lists add up to its threshold, which no document still unseen exceeds: the
query is done once the threshold falls strictly below its k-th score, so that
ties are kept. The k-th scores go from a task's shard to its next one, and the
best of all tasks meet by query.

Lists never leave a task, so a term that all documents hold is read in all
tasks, and nothing is dealt by term.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import words as W
from .shared import lean_batches, materialize, slices

#: What a query's terms, and the terms of a text, consist of: digits, letters and all above ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Queries, and characters of their texts, of a block: more queries are searched block by block.
BLOCK_ITEMS, BLOCK_CHARS = 4096, 1 << 25
#: Postings of a shard, and scores computed at once.
SHARD_POSTINGS, SCORES = 1 << 20, 1 << 21
#: Places of each list that the first round reads; each round reads twice as many as the one before.
FIRST_READ = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Vocabulary:
    """The terms of a block of queries, found in tokenised text by hash and then compared byte by byte."""

    def __init__(self, terms: list[str]):
        told = W.tokenize(pa.array(terms, pa.string()), W.ALNUM_LOWER)
        order = np.argsort(told.hash, kind="stable")
        self.terms = [terms[i] for i in order]
        self.hash, self.start, self.length = told.hash[order], told.start[order], (told.end - told.start)[order]
        self.data = told.data
        first, last = W.runs(self.hash)
        #: Terms that share a hash: 1 but for a collision.
        self.alike = int((last - first).max(initial=0))

    def numbers(self, words: W.Words) -> np.ndarray:
        """Each word's term, -1 if it is none."""
        found = np.full(len(words.hash), -1, np.int64)
        if not len(self.hash):
            return found
        at = np.searchsorted(self.hash, words.hash)
        length = words.end - words.start
        for step in range(self.alike):
            place = np.minimum(at + step, len(self.hash) - 1)
            some = np.flatnonzero((self.hash[place] == words.hash) & (self.length[place] == length))
            size = length[some]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            one = W.ALNUM_LOWER.fold[words.data[np.repeat(words.start[some], size) + inner]]
            same = one == self.data[np.repeat(self.start[place[some]], size) + inner]
            if len(some):
                some = some[np.logical_and.reduceat(same, np.cumsum(size) - size)]
            found[some] = place[some]
        return found


class Queries:
    """A block of queries: the distinct terms of each, by query and by term."""

    def __init__(self, ids: pa.Array, terms: list[list[str]]):
        self.ids = ids
        self.vocabulary = Vocabulary(sorted({t for one in terms for t in one}))
        number = {t: i for i, t in enumerate(self.vocabulary.terms)}
        self.sizes = np.array([len(x) for x in terms], np.int64)
        self.term = np.array([number[t] for one in terms for t in one], np.int64)
        self.item = np.repeat(np.arange(len(terms)), self.sizes)
        order = np.argsort(self.term, kind="stable")
        #: Queries by term: by_term[first[t] : first[t + 1]].
        self.by_term = self.item[order]
        self.first = np.searchsorted(self.term[order], np.arange(len(number) + 1))

    def __len__(self) -> int:
        return len(self.sizes)


class Best:
    """The k best documents of each query so far: by score, then by the smaller id, a null one last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.no_id = np.zeros(0, bool)
        #: What a document has to reach: the k-th score, or 1 where there are fewer.
        self.least = np.ones(items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, no_id: np.ndarray) -> None:
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, score])
        doc, no_id = np.concatenate([self.doc, doc]), np.concatenate([self.no_id, no_id])
        order = np.lexsort((doc, no_id, -score, item))
        item = item[order]
        first, last = W.runs(item)
        rank = np.arange(len(item)) - np.repeat(first, last - first)
        kept = order[rank < self.k]
        self.item, self.score, self.doc, self.no_id = item[rank < self.k], score[kept], doc[kept], no_id[kept]
        full = rank == self.k - 1
        self.least[item[full]] = score[order[full]]


class Shard:
    """Documents of a task: the forward index, and a list for each term in order of impact."""

    def __init__(self, n_terms: int, doc: np.ndarray, no_id: np.ndarray, ends: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.doc, self.no_id, self.ends, self.term, self.impact = doc, no_id, ends, term, impact
        row = np.repeat(np.arange(len(doc)), np.diff(ends))
        order = np.lexsort((row, -impact, term))
        self.list_row, self.list_impact = row[order], impact[order]
        self.list_first = np.searchsorted(term[order], np.arange(n_terms + 1))

    def scores(self, rows: np.ndarray, queries: Queries, exact: bool) -> np.ndarray:
        """queries x rows: the forward index looked up for some documents."""
        size = self.ends[rows + 1] - self.ends[rows]
        at = np.repeat(self.ends[rows], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        column, term, impact = np.repeat(np.arange(len(rows)), size), self.term[at], self.impact[at]
        out = np.zeros(len(queries) * len(rows), np.int64 if exact else np.float64)
        count = queries.first[term + 1] - queries.first[term]
        cuts = np.searchsorted(np.cumsum(count), np.arange(SCORES, int(count.sum()) + SCORES, SCORES))
        for i, j in zip([0, *(cuts[:-1] + 1)], [*(cuts[:-1] + 1), len(count)]):
            some = count[i:j]
            item = queries.by_term[np.repeat(queries.first[term[i:j]], some) + np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)]
            key, value = item * len(rows) + np.repeat(column[i:j], some), np.repeat(impact[i:j], some)
            if exact:
                np.add.at(out, key, value)
            else:
                out += np.bincount(key, value, len(out))
        return out.astype(np.int64).reshape(len(queries), len(rows))


def threshold_search(shard: Shard, queries: Queries, best: Best, exact: bool = False) -> int:
    """Put the shard's best documents into `best`; the number of documents that were looked up."""
    seen = np.zeros(len(shard.doc), bool)
    length = np.diff(shard.list_first)
    open_ = np.bincount(queries.item, length[queries.term], len(queries)) > 0
    depth, step = 0, FIRST_READ
    while open_.any():
        lists = np.unique(queries.term[open_[queries.item]])
        low = shard.list_first[lists] + np.minimum(depth, length[lists])
        size = np.minimum(length[lists], depth + step) - np.minimum(depth, length[lists])
        shown = shard.list_row[np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        fresh = np.unique(shown[~seen[shown]])
        seen[fresh] = True
        width = max(1, SCORES // len(queries))
        for i in range(0, len(fresh), width):
            rows = fresh[i : i + width]
            scores = shard.scores(rows, queries, exact)
            reach = best.least
            if len(rows) > best.k:  # what these rows alone rule out
                reach = np.maximum(reach, np.partition(scores, len(rows) - best.k, axis=1)[:, len(rows) - best.k])
            item, at = np.nonzero((scores >= reach[:, None]) & open_[:, None])
            best.add(item, scores[item, at], shard.doc[rows[at]], shard.no_id[rows[at]])
        depth, step = depth + step, step * 2
        # The impact last read of each list that goes on.
        head = np.zeros(len(length), np.int64)
        on = length > depth
        head[on] = shard.list_impact[shard.list_first[:-1][on] + depth - 1]
        threshold = np.zeros(len(queries), np.int64)
        np.add.at(threshold, queries.item, head[queries.term])
        open_ &= threshold >= best.least
    return int(seen.sum())


_FORWARD = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def forward_index(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc, n, terms, counts) of each document (doc, t): how many terms it has, and which of the vocabulary, how often."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        for batch in batches:
            for part in slices(batch, 1):
                words = W.tokenize(part.column(1), W.ALNUM_LOWER)
                term = held.numbers(words)
                known = term >= 0
                key = (words.row[known].astype(np.int64) << 40) | term[known]
                key.sort()
                first, last = W.runs(key)
                one = key[first]
                ends = pa.array(np.searchsorted(one >> 40, np.arange(words.n_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (one & ((1 << 40) - 1), last - first)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.counts().astype(np.int64)), *lists], schema=_FORWARD)

    return docs.mapInArrow(index, "doc long, n long, terms array<int>, counts array<int>")


def _statistics(forward: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all their terms, documents that hold each term of the vocabulary): a row for each term and task is added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, some, every = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            n = batch.column(0).to_numpy()
            some, every = some + int((n > 0).sum()), every + int(n.sum())
            held += np.bincount(batch.column(1).flatten().to_numpy(), minlength=terms)
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], there])), pa.array(np.concatenate([[some, every], held[there]]))], names=["term", "n"])

    found = forward.select("n", "terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(terms + 2, np.int64)
    out[found.column("term").to_numpy() + 2] = found.column("n").to_numpy()
    return int(out[0]), int(out[1]), out[2:]


def weights(documents: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in held], np.int64)


def _shards(batches: Iterator[pa.RecordBatch], weight: np.ndarray, documents: int, every: int) -> Iterator[Shard]:
    """The batches' documents, in shards of about SHARD_POSTINGS postings."""

    def shard(held: list[pa.RecordBatch]) -> Shard:
        table = pa.Table.from_batches(held).combine_chunks()
        doc = table.column("doc").combine_chunks()
        no_id = doc.is_null().to_numpy(zero_copy_only=False)
        terms, counts = (table.column(c).combine_chunks() for c in ("terms", "counts"))
        term, count = (x.flatten().to_numpy().astype(np.int64) for x in (terms, counts))
        ends = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        m = 100 - 50 + (50 * table.column("n").to_numpy() * documents) // max(every, 1)
        impact = weight[term] * ((1_000_000_000 * count) // (1000 * count + 20 * np.repeat(m, np.diff(ends))))
        return Shard(len(weight), doc.fill_null(0).to_numpy(), no_id, ends, term, impact)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column(2).flatten())
        if size >= SHARD_POSTINGS:
            yield shard(held)
            held, size = [], 0
    if held:
        yield shard(held)


def _search_block(docs: DataFrame, block: pa.Table, kind: str, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): the k best documents of each query of a block in each task."""
    spark = docs.sparkSession
    queries = Queries(block.column("item_id").combine_chunks(), block.column("terms").to_pylist())
    forward = materialize(forward_index(docs, queries.vocabulary), "forward-index")
    documents, every, held = _statistics(forward, len(queries.vocabulary.terms))
    weight = weights(documents, held)
    # Sums of floats are exact below 2^53.
    exact = int(queries.sizes.max(initial=0)) * int(weight.max(initial=0)) * 1_000_000 >= 1 << 53
    shipped = spark.sparkContext.broadcast((queries, weight))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = shipped.value
        best = Best(len(queries), k)
        for shard in _shards(batches, weight, documents, every):
            threshold_search(shard, queries, best, exact)
        doc = pa.array(best.doc, mask=best.no_id)
        yield pa.RecordBatch.from_arrays([pa.array(best.item), queries.ids.take(pa.array(best.item)), doc, pa.array(best.score)], names=["item", "item_id", "doc_id", "score"])

    return forward.mapInArrow(search, f"item long, item_id {kind}, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 for each row of items, fewer if there are fewer.

    Terms are the maximal matches of TERM in the whole text, A-Z lowered. With
    N documents that have a term, L terms in all and df documents that hold a
    term, its weight w is floor(1000 ln((2N + 2) / (2 df + 1))); a document of
    n terms has m = 50 + (50 n N) div L; it scores the sum of w ((10^9 tf) div
    (1000 tf + 20 m)) over the distinct terms of the query.

    Ranks start at 1, highest score first; of equal scores the smaller id comes
    first, a null one last. Null and empty texts have no terms: as documents
    they are not counted, as queries they get no rows. Texts of any length are
    read whole. Repeated rows of docs are documents of their own, repeated rows
    of items queries of their own. Ids of documents are whole numbers. Other
    columns are ignored, so their names cannot clash; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    kind = dict(items.dtypes)[item_id]
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc"), text.alias("t"))
    asked = items.select(F.col(item_id).alias("item_id"), text.alias("t"))
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_CHARS))
    terms = F.array_distinct(F.regexp_extract_all(F.translate("t", _UPPER, _LOWER), F.lit(TERM), F.lit(0)))
    asked = asked.select("item_id", terms.alias("terms"), F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).alias("block"))
    if blocks > 1:
        asked = materialize(asked, "queries")
    found = None
    for b in range(blocks):
        block = asked.where(F.col("block") == b).select("item_id", "terms").toArrow()  # BLOCK_ITEMS queries or so
        best = _search_block(docs, block, kind, k)
        best = best.withColumn("block", F.lit(b))
        found = best if found is None else found.unionAll(best)
    place = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
