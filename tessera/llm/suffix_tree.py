"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the words that training rows hold `least` times or more, one
symbol for all rarer words, the end, and the start, which occurs in contexts
alone. A context is a candidate if training rows hold it `least` times; it
becomes a state if its next-symbol distribution diverges from that of its
longest suffix that is a state by more than its own description costs. A
state's distribution is its counts, smoothed by that suffix's distribution,
down to the unigrams. A token is scored by the longest state that is a suffix
of what precedes it; a rare word's probability is its class's, shared out by
its smoothed unigram count.

The floors are counts, so the tree grows with the corpus, and nothing of it is
held in one place. Documents are written in batches of word numbers. A batch
sends each of its distinct tuples (the last `depth` symbols, the next one) once,
with its training count and the documents that have it, to a range of the
tuples' order. The order has all tuples of a context together, whatever its
length, so that the task of a range grows the whole tree below its contexts,
puts them to the test and scores its tuples. What returns are sums by document.

A context may be more than a range holds, or lie across a cut. Next-symbol
counts of all contexts that a cut goes through (at most depth - 1 blocks for a
cut) are added up beforehand and handed to every range that they reach; there
they stand for the range's own counts of these contexts. The cuts are chosen
from a sample of the order, so ranges are of like sizes however hot a word, a
pair or a line is. They change the work of a task and never a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .packed import bucket_of, column, loosened, record, runs_of, squeezed, written
from .shared import delete_path, lean_batches, slices

#: Least training count of a word with a symbol of its own, and of a context.
LEAST = 2
#: Most words of a context.
DEPTH = 5
#: Weight of the suffix's distribution, in tokens.
SMOOTHING = 8.0
#: Steps of a decimal logarithm: sums of whole steps don't depend on their order.
STEPS = 1e10
#: Text bytes of a batch, or one text.
BATCH_BYTES = 1 << 20
#: Ranges for each shuffle task, as a range is held whole.
RANGES = 6
#: Keys of the sample for each range.
SAMPLE = 200
#: Parts of the ranges that are scored one after another, so that the tuples of one are on disk at a time.
ROUNDS = 2

#: One schema for all that is sent: batches of documents, word counts and their answers, tuples, counts of cut contexts, and sums.
_COLUMNS = "base long, kind int, bucket int, a binary, b binary, c binary, d binary, e binary, f binary"
_SCHEMA = pa.schema([("base", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), *((n, pa.binary()) for n in "abcdef")])
DOCUMENTS, WORDS, TUPLES, CUT, SUMS = range(5)
#: Low bits of the order, which no cut has: equal tuples are brought together by a hash there.
_TIE = np.uint64((1 << 12) - 1)
_MULTIPLIER = np.uint64(0x9FB21C651E98DF25)


def _record(rows: list[tuple], of=pa.RecordBatch):
    return record(_SCHEMA, rows, of)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of documents: words and learning by row, ids, which ids are null, the batch's sorted distinct hashes, and words by number in these."""
    for batch in batches:
        for piece in slices(batch, 2, BATCH_BYTES):
            words = W.tokenize(piece.column(2), W.SPACED_LOWER)
            kinds, number = np.unique(words.hash, return_inverse=True)
            learns = np.asarray(piece.column(1).to_numpy(zero_copy_only=False), np.uint8)
            ids = piece.column(3)
            null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.uint8)
            told = ids.cast(pa.int64()).fill_null(0).to_numpy().astype("<i8").tobytes()
            yield _record([(piece.column(0)[0].as_py(), DOCUMENTS, None, squeezed(words.counts()), squeezed(learns), told, squeezed(null), kinds.tobytes(), squeezed(number))])


def _send_words(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, rows, learns, kinds, number in zip(*(batch.column(c).to_pylist() for c in ("base", "a", "b", "e", "f"))):
                kinds = np.frombuffer(kinds, "<u8")
                told = np.repeat(loosened(learns), loosened(rows))
                count = np.bincount(loosened(number), told, len(kinds)).astype(np.int64)
                yield _record([(base, WORDS, b, kinds[i:j].tobytes(), squeezed(count[i:j])) for b, i, j in runs_of(bucket_of(kinds, buckets))])

    return send


def _answer_words(floor: int):
    def answer(table: pa.Table) -> pa.Table:
        """Training counts of a bucket's words, and the rank of each that reaches the floor among those, the most frequent first, from 1, or 0."""
        hashes = [np.frombuffer(x, "<u8") for x in table.column("a").to_pylist()]
        kinds, which = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(which, np.concatenate(column(table, "b")), len(kinds)).astype(np.int64)
        common = total >= floor
        rank = np.zeros(len(total), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(1, len(total) + 1)
        rank[~common] = 0
        bucket, at, rows = table.column("bucket")[0].as_py(), 0, []
        for base, h in zip(table.column("base").to_pylist(), hashes):
            mine = which[at : at + len(h)]
            at += len(h)
            rows.append((base, WORDS, bucket, squeezed(total[mine]), squeezed(rank[mine])))
        rows.append((None, WORDS, bucket, squeezed(np.array([total.sum(), (total > 0).sum(), common.sum(), total[common].sum()]))))
        return _record(rows, pa.Table)

    return answer


@dataclass
class Model:
    """Sums of the words; top: the greatest number of a frequent word. Small numbers are of frequent words, as each bucket counts by rank."""

    n: int
    types: int
    ends: int
    frequent: int
    frequent_n: int
    buckets: int
    top: int
    floor: int
    depth: int

    def number(self, bucket: int, rank: np.ndarray) -> np.ndarray:
        return np.where(rank > 0, 1 + (rank - 1) * self.buckets + bucket, 0)

    @property
    def size(self) -> int:
        return self.n + self.types + 1

    @property
    def rare(self) -> float:
        """Unigram probability of the class of rare words."""
        return max(1 / self.size, 1 - (self.frequent_n + self.frequent + self.ends + 1) / self.size)

    # Symbols: 0 rare, 1.. words, then these.
    @property
    def end(self) -> int:
        return self.top + 1

    @property
    def start(self) -> int:
        return self.top + 2

    @property
    def none(self) -> int:
        """Stands before the start."""
        return self.top + 3

    @property
    def symbols(self) -> int:
        return self.top + 4

    @property
    def bits(self) -> int:
        """Bits of each symbol in the order."""
        return 60 // self.depth

    def unigram(self, symbol: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.where(symbol == 0, self.rare, (count + 1) / self.size)


def _numbered(m: Model):
    def number(table: pa.Table) -> pa.Table:
        """A batch with the symbols and counts of its distinct words instead of their hashes."""
        rows = table.to_pylist()
        given = next(r for r in rows if r["kind"] == DOCUMENTS)
        told = sorted((r for r in rows if r["kind"] == WORDS), key=lambda r: r["bucket"])
        none = [np.zeros(0, np.int64)]
        count = np.concatenate([loosened(r["a"]) for r in told] or none)
        ranks = [loosened(r["b"]) for r in told]
        symbol = np.concatenate([m.number(r["bucket"], x) for r, x in zip(told, ranks)] or none)
        return _record([(given["base"], DOCUMENTS, None, given["a"], given["b"], given["c"], given["d"], squeezed(np.concatenate([symbol, count])), given["f"])], pa.Table)

    return number


class Batch:
    """The tokens of a batch's documents: each one's symbol, count and document, and the symbols before it."""

    def __init__(self, m: Model, row: dict):
        self.words, self.learns, number = loosened(row["a"]), loosened(row["b"]), loosened(row["f"])
        symbol, count = loosened(row["e"]).reshape(2, -1)
        n = len(self.words)
        begin = np.cumsum(self.words + 2) - self.words - 2
        at = np.arange(len(number)) + 2 * np.repeat(np.arange(n), self.words) + 1
        self.line = np.full(int((self.words + 2).sum()), m.end, np.int32)
        self.line[begin], self.line[at] = m.start, symbol[number]
        counts = np.full(len(self.line), m.ends, np.int64)
        counts[at] = count[number]
        self.doc = np.repeat(np.arange(n, dtype=np.int32), self.words + 1)
        self.place = np.arange(len(self.doc)) + self.doc + 1  # all but the starts
        self.past = self.place - begin[self.doc]
        self.next, self.count = self.line[self.place], counts[self.place]

    def before(self, m: Model, some: np.ndarray | slice = slice(None)) -> list[np.ndarray]:
        """The symbols before some tokens, the nearest first."""
        place, past = self.place[some], self.past[some]
        return [np.where(past >= d, self.line[place - np.minimum(d, past)], np.int32(m.none)) for d in range(1, m.depth + 1)]


def _keys(m: Model, before: list[np.ndarray]) -> np.ndarray:
    """Place of each tuple in the order: some bits of a hash of each symbol, the nearest first."""
    key = np.zeros(len(before[0]), np.uint64)
    with np.errstate(over="ignore"):
        for d, w in enumerate(before):
            key = (key << np.uint64(m.bits)) | W.mix((w.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER + np.uint64(d)) >> np.uint64(64 - m.bits)
    return key


def _batches_of(rows: pa.RecordBatch) -> Iterator[dict]:
    for i in range(rows.num_rows):
        yield rows.slice(i, 1).to_pylist()[0]


def _sample(m: Model, share: float):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _batches_of(batch):
                b = Batch(m, row)
                with np.errstate(over="ignore"):
                    draw = W.mix(np.arange(len(b.next), dtype=np.uint64) * _MULTIPLIER + np.uint64(row["base"] & 0xFFFFFFFFFFFF)) >> np.uint64(11)
                key = _keys(m, b.before(m, np.flatnonzero(draw < share * 2.0**53)))
                yield pa.RecordBatch.from_arrays([pa.array([key.tobytes()])], names=["keys"])

    return sample


def _send_tuples(m: Model, cuts: np.ndarray, low: int, high: int):
    """Distinct tuples of the ranges from low to high."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _batches_of(batch):
                b = Batch(m, row)
                before = b.before(m)
                key = _keys(m, before)
                inside = np.ones(len(key), bool)
                if low > 0 and low <= len(cuts):
                    inside &= key >= cuts[low - 1]
                if high < len(cuts):
                    inside &= key < cuts[high]
                some = np.flatnonzero(inside) if low <= len(cuts) else []
                if not len(some):
                    continue
                with np.errstate(over="ignore"):
                    tie = W.mix(key[some] * _MULTIPLIER + b.next[some].astype(np.uint64)) & _TIE
                order = (key[some] & ~_TIE) | tie
                some = some[np.argsort(order)]
                columns, doc = [c[some] for c in (*before, b.next)], b.doc[some]
                first, last = W.runs(*columns)
                one = some[first]
                columns, count = np.stack([c[first] for c in columns]), b.count[one]
                learned, out = np.add.reduceat(b.learns[doc], first), []
                ends = np.concatenate([[0], np.searchsorted(key[one] & ~_TIE, cuts, side="left"), [len(one)]])
                for bucket, i, j in [(k, int(i), int(j)) for k, (i, j) in enumerate(zip(ends[:-1], ends[1:])) if i < j]:
                    out.append((row["base"], TUPLES, bucket, squeezed(columns[:, i:j].ravel()), squeezed(count[i:j]), squeezed(learned[i:j]), squeezed((last - first)[i:j]), squeezed(doc[first[i] : last[j - 1]])))
                yield _record(out)

    return send


def _cut_blocks(m: Model, cuts: np.ndarray) -> list[np.ndarray]:
    """By depth (from 1), the sorted leading bits of the cuts."""
    return [np.unique(cuts >> np.uint64(m.bits * (m.depth - d))) for d in range(1, m.depth)]


def _lies_in(blocks: np.ndarray, lead: np.ndarray) -> np.ndarray:
    return blocks[np.minimum(np.searchsorted(blocks, lead), len(blocks) - 1)] == lead if len(blocks) else np.zeros(len(lead), bool)


def _send_cut(m: Model, cuts: np.ndarray, buckets: int):
    """Next-symbol counts of the contexts that a cut goes through, by bucket of the pair's hash."""
    blocks = _cut_blocks(m, cuts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _batches_of(batch):
                b, out = Batch(m, row), []
                before = b.before(m)
                key = _keys(m, before)
                some = np.flatnonzero(b.learns[b.doc] > 0)
                for d in range(1, m.depth):  # a longer context lies in a block only if the shorter does
                    some = some[_lies_in(blocks[d - 1], key[some] >> np.uint64(m.bits * (m.depth - d))) & (before[d - 1][some] != m.none)]
                    columns, h = [c[some] for c in (*before[:d], b.next)], np.zeros(len(some), np.uint64)
                    with np.errstate(over="ignore"):
                        for c in columns:
                            h = W.mix(h * _MULTIPLIER + c.astype(np.uint64) + np.uint64(d))
                    order = np.argsort(h)
                    columns = [c[order] for c in columns]
                    first, last = W.runs(*columns)
                    columns, count = np.stack(columns)[:, first], b.count[some][order][first]
                    for k, i, j in runs_of(bucket_of(h[order][first], buckets)):
                        out.append((row["base"], CUT, k, squeezed(columns[:, i:j].ravel()), squeezed(count[i:j]), squeezed((last - first)[i:j]), squeezed(np.array([d]))))
                yield _record(out)

    return send


def _add_cut(m: Model, cuts: np.ndarray):
    def add(table: pa.Table) -> pa.Table:
        """Counts added up, for each range that the contexts reach: one row for each range."""
        level = np.concatenate(column(table, "d"))
        parts: dict[int, list[list[np.ndarray]]] = {}
        for d in np.unique(level):
            mine = table.filter(pa.array(level == d))
            cols = np.concatenate([x.reshape(d + 1, -1) for x in column(mine, "a", np.int32)], axis=1)
            count, n = (np.concatenate(column(mine, c)) for c in "bc")
            with np.errstate(over="ignore"):
                h = np.zeros(len(n), np.uint64)
                for c in cols:
                    h = W.mix(h * _MULTIPLIER + c.astype(np.uint64))
            order = np.argsort(h)  # equal rows are next to each other; others that are, too, by a hash in common stay apart
            cols = cols[:, order]
            first, _ = W.runs(*cols)
            cols, count, n = cols[:, first], count[order[first]], np.add.reduceat(n[order], first)
            before = [*cols[:d], *np.full((m.depth - d, len(first)), m.none, np.int32)]
            shift = np.uint64(m.bits * (m.depth - int(d)))
            lead = _keys(m, before) >> shift
            low = np.searchsorted(cuts, lead << shift, side="right")
            size = np.searchsorted(cuts, ((lead + np.uint64(1)) << shift) - np.uint64(1), side="right") - low + 1
            at = np.repeat(np.arange(len(first)), size)
            bucket = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            order = np.argsort(bucket)
            at, rows = at[order], [*before, cols[d]]
            for b, i, j in runs_of(bucket[order]):
                held = at[i:j]
                parts.setdefault(b, []).append([np.stack([c[held] for c in rows]), count[held], n[held], np.full(j - i, d)])
        out = [(None, CUT, b, squeezed(np.concatenate([x[0] for x in p], axis=1).ravel()), *(squeezed(np.concatenate([x[k] for x in p])) for k in (1, 2, 3))) for b, p in parts.items()]
        return _record(out, pa.Table)

    return add


def probabilities(m: Model, cuts: np.ndarray, before: list[np.ndarray], following: np.ndarray, count: np.ndarray, n: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Probability of each tuple's next symbol by the longest state that is a suffix of the tuple's context.

    n: training counts; level: 0 for tuples, which count for each of their
    contexts that no cut goes through, or the one depth that a row of added-up
    counts counts for.
    """
    p, ids, live = m.unigram(following, count), np.zeros(len(n), np.int64), np.arange(len(n))
    key, blocks = _keys(m, before), _cut_blocks(m, cuts)
    for d in range(1, m.depth + 1):
        w = before[d - 1]
        live = live[(w[live] != m.none) & ((level[live] == 0) | (level[live] >= d))]
        if not len(live):
            break
        whole = level[live] == 0
        if d < m.depth:
            whole &= ~_lies_in(blocks[d - 1], key[live] >> np.uint64(m.bits * (m.depth - d)))
        weight = np.where(whole | (level[live] == d), n[live], 0)
        _, first, of = W.grouped(ids[live] * m.symbols + w[live])
        total = np.bincount(of, weight, len(first))
        enough = total[of] >= m.floor  # a longer context is not more frequent
        live, of, weight = live[enough], of[enough], weight[enough]
        if not len(live):
            break
        ids[live] = of
        order, first, which = W.grouped(of * m.symbols + following[live])
        at = order[first]  # all tuples of a pair have the same probability so far
        times, state = np.bincount(which, weight, len(first)), of[at]
        keep = diverging(state, times, p[live][at], total)
        used = keep[of]
        i = live[used]
        p[i] = (times[which[used]] + SMOOTHING * p[i]) / (total[of[used]] + SMOOTHING)
    return p


def diverging(state: np.ndarray, count: np.ndarray, p: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Which states differ from their suffixes by more than they cost; per pair its state, count and probability after the suffix."""
    seen = np.flatnonzero(count)
    s, c, n = state[seen], count[seen], len(total)
    gain = np.bincount(s, c * np.log(c / total[s] / p[seen]), n)
    return gain > 0.5 * np.log(np.maximum(total, 2)) * np.bincount(s, minlength=n)


def _score(m: Model, cuts: np.ndarray):
    def score(table: pa.Table) -> pa.Table:
        """By batch, sums of the scores of a range's tuples for each document."""
        sent = table.filter(pa.compute.equal(table.column("kind"), TUPLES))
        if not sent.num_rows:
            return _record([], pa.Table)
        added = table.filter(pa.compute.equal(table.column("kind"), CUT))
        *before, following = np.concatenate([x.reshape(m.depth + 1, -1) for x in (*column(sent, "a", np.int32), *column(added, "a", np.int32))], axis=1)
        count, n = (np.concatenate([*column(sent, c), *column(added, c)]) for c in "bc")
        postings, docs = column(sent, "d"), column(sent, "e")
        sizes = [len(x) for x in postings]
        level = np.concatenate([np.zeros(sum(sizes), np.int64), *column(added, "d")])
        steps = np.rint(-STEPS * np.log10(probabilities(m, cuts, before, following, count, n, level))).astype(np.int64)
        out, at = [], 0
        for base, times, doc in zip(sent.column("base").to_pylist(), postings, docs):
            told = np.repeat(steps[at : at + len(times)], times)
            at += len(times)
            kinds, which = np.unique(doc, return_inverse=True)
            sums = np.zeros(len(kinds), np.int64)
            np.add.at(sums, which, told)
            out.append((base, SUMS, None, squeezed(kinds), squeezed(sums)))
        return _record(out, pa.Table)

    return score


def _told(m: Model):
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each batch what scores need besides the sums: ids and, by document, tokens, known tokens, base scores and shares of rare words."""
        for batch in batches:
            for row in _batches_of(batch):
                b = Batch(m, row)
                n, base = len(b.words), np.log10((b.count + 1) / m.size)
                rare = np.where(b.next == 0, base - np.log10(m.rare), 0.0)
                known = np.bincount(b.doc, b.count > 0, n).astype(np.int64)
                sums = np.concatenate([np.bincount(b.doc, x, n) for x in (base, rare)])
                yield _record([(row["base"], DOCUMENTS, None, row["a"], row["b"], row["c"], row["d"], squeezed(known), sums.tobytes())])

    return tell


def _joined(m: Model):
    def join(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        given = next(r for r in rows if r["kind"] == DOCUMENTS)
        words, ids = loosened(given["a"]), np.frombuffer(given["c"], "<i8")
        base, rare = np.frombuffer(given["f"]).reshape(2, -1)
        steps = np.zeros(len(ids), np.int64)
        for r in rows:
            if r["kind"] == SUMS:
                steps[loosened(r["a"])] += loosened(r["b"])
        return pa.table({
            "id": pa.array(ids, mask=loosened(given["d"]) > 0), "held_out": pa.array(loosened(given["b"]) == 0), "n_tokens": pa.array(words + 1), "n_known": pa.array(loosened(given["e"])),
            "train_tokens": pa.array(np.full(len(ids), m.n, np.int64)), "base_score": pa.array(base), "score": pa.array(rare - steps / STEPS),
        })

    return join


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(id) mod `folds` is not `held` (a null id is
    learned from and not held out). Tokens are words between white space, A-Z
    folded, and one end for each text; a null or empty text has the end alone.
    Scores are log10 probabilities: base_score under add-one unigrams, score
    under the suffix tree, whose contexts have `depth` words at most (10 at
    the utmost); each token's is rounded to 10 places. Texts of any length are
    scored whole. Ids are whole numbers. Repeated rows count and score each.
    Other columns are ignored, so their names cannot clash; an empty table
    gives an empty result.
    """
    if not 1 <= depth <= 10 or least < 1:
        raise ValueError("depth is 1 to 10, and least 1 or more")
    spark = docs.sparkSession
    lean_batches(spark)
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
    learns = F.coalesce(fold, F.lit(-1)) != held
    rows = docs.select(F.monotonically_increasing_id().alias("nth"), learns.alias("learns"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(id_col).cast("long").alias("doc"))
    word_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = RANGES * word_buckets
    coded = written(rows.mapInArrow(_documents, _COLUMNS), "documents")
    ends = docs.where(learns).count()

    words = coded.mapInArrow(_send_words(word_buckets), _COLUMNS)
    answers = written(words.groupBy("bucket").applyInArrow(_answer_words(least), _COLUMNS), "word-counts")
    told = [loosened(r.a) for r in answers.where("base is null").select("a").collect()]  # a row for each bucket
    n, types, frequent, frequent_n = (sum(int(x[i]) for x in told) for i in range(4))
    top = word_buckets * max((int(x[2]) for x in told), default=0)
    m = Model(n + ends, types + (ends > 0), ends, frequent, frequent_n, word_buckets, top, least, depth)
    if m.symbols >= 1 << 31:
        raise ValueError("more frequent words than 31 bits number")
    batches = written(coded.unionAll(answers.where("base is not null")).groupBy("base").applyInArrow(_numbered(m), _COLUMNS), "numbered")
    for folder in {f.rsplit("/", 1)[0] for df in (coded, answers) for f in df.inputFiles()}:
        delete_path(spark, folder)

    share = min(1.0, SAMPLE * buckets / max(1, m.n))
    sampled = batches.mapInArrow(_sample(m, share), "keys binary").toArrow().column(0).to_pylist()  # about SAMPLE keys for each range
    keys = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in sampled)]))
    cuts = np.unique(keys[(np.arange(1, buckets) * len(keys)) // buckets] & ~_TIE) if len(keys) else keys
    added = batches.mapInArrow(_send_cut(m, cuts, max(8, buckets // 16)), _COLUMNS).groupBy("bucket").applyInArrow(_add_cut(m, cuts), _COLUMNS)
    added = written(added, "cut-contexts")
    scores = []
    for turn in range(ROUNDS):
        low, high = turn * buckets // ROUNDS, (turn + 1) * buckets // ROUNDS - 1
        tuples = batches.mapInArrow(_send_tuples(m, cuts, low, high), _COLUMNS).unionAll(added.where(F.col("bucket").between(low, high)))
        scores.append(written(tuples.groupBy("bucket").applyInArrow(_score(m, cuts), _COLUMNS), "scores"))
    kind = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return reduce(DataFrame.unionAll, scores, batches.mapInArrow(_told(m), _COLUMNS)).groupBy("base").applyInArrow(_joined(m), kind)
