"""Incremental substring deduplication over a log-structured fingerprint index.

The index is a list of immutable runs. A run holds the hashes of windows of
`window` consecutive words that entered with it, sorted, each with the place of
one text that has it: rows of compressed cells, one for each bucket, which is a
range of the hash. Runs are tables bucketed alike, so that a new batch is dealt
out once, by bucket, and merge-joined with each run where the run lies; no run
is exchanged or sorted again. A window that no run has makes the new run.
Whenever `fan_in` runs of one level have gathered they are compacted into one
run of the next level, bucket by bucket, likewise in place. A batch's answers
are written beside its run, in the same pass, and go when that is compacted.

A window that a run or a smaller id of the batch has is verified before it is
removed: stretches of such windows are read from the texts at their places and
compared word by word. The index keeps those texts as segments, slices of a
batch, so that it needs nothing but itself. If two windows had one hash, the
comparison would fail and the words would stay.

Batches must come in ascending order of ids: a window belongs to the smallest
id that has it, so what is in the index is never revised.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import words as W
from .packed import ascended, ascending, bucket_of, chosen, column, loosened, record, runs_of, squeezed, taken, tidy, written
from .shared import delete_path, fresh_path, lean_batches, slices, small_table

#: Text bytes of a segment, or one text.
SEGMENT_BYTES = 1 << 20
#: Requests of one segment that a task answers at most, about.
REQUESTS = 2000

#: One schema for all that is sent. Segments: ids, ends of the texts, texts. Sent windows: hashes, ids, places. Runs: hashes, segments
#: (two cells), places. Answers: which of the windows sent, segments (two cells), places. Requests: places there, windows, places here.
_COLUMNS = "seg long, kind int, bucket int, level int, other long, a binary, b binary, c binary, d binary"
_SCHEMA = pa.schema([("seg", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("level", pa.int32()), ("other", pa.int64()), *((n, pa.binary()) for n in "abcd")])
SEGMENT, SENT, RUN, ANSWER, REQUEST, REPLY = range(6)

RESULT = "doc long, n_words long, n_removed long, kept string, kept_sha256 string"
_RESULT = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])


def _segments(number: int):
    """Slices of a batch's documents, numbered by batch, task and order in the task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = (number << 48) + (TaskContext.get().partitionId() << 20)
        for batch in batches:
            for part in slices(batch, 1, SEGMENT_BYTES):
                offsets, data = W.text_buffer(part.column(1))
                ids = part.column(0).to_numpy().astype("<i8")
                yield record(_SCHEMA, [(seg, SEGMENT, None, None, None, ids.tobytes(), squeezed(offsets[1:]), zstandard.ZstdCompressor(level=1).compress(data.tobytes()))])
                seg += 1

    return pack


class Segment:
    """A segment's words, and its windows in order of their hashes."""

    def __init__(self, row: dict):
        self.ids, ends = np.frombuffer(row["a"], "<i8"), loosened(row["b"])
        data = zstandard.ZstdDecompressor().decompress(row["c"])
        offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64).tobytes())
        self.words = W.tokenize(pa.LargeStringArray.from_buffers(len(ends), offsets, pa.py_buffer(data)), W.SPACED)

    def windows(self, window: int) -> None:
        """hash: the distinct hashes, sorted; place and id: where and in which document the smallest id has each; at, which: all places in order of their words, and the number of each one's hash."""
        inside = W.within(self.words.row, window)
        self.at = np.flatnonzero(inside)
        h, doc = W.grams(self.words.hash, window)[self.at], self.ids[self.words.row[self.at]]
        order, first, self.which = W.grouped(h)
        self.hash = h[order][first]
        if not len(first):
            self.id = self.place = np.zeros(0, np.int64)
            return
        self.id = np.minimum.reduceat(doc[order], first)
        least = doc == self.id[self.which]
        self.place = np.minimum.reduceat(np.where(least, self.at, len(self.words.row))[order], first)

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, one space behind each, and where each begins."""
        return spaced(self.words, np.ones(len(self.words.start), bool))


def spaced(words: W.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words kept, one space behind each, and where each begins, with the end of the last."""
    start, end = words.start[keep], words.end[keep]
    to = np.concatenate([[0], np.cumsum(end - start + 1)])
    buffer, mask = np.full(to[-1], 32, np.uint8), np.ones(to[-1], bool)
    mask[to[1:] - 1] = False
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1  # a space or the text's end follows each word, so no two words touch
    buffer[mask] = words.data[np.cumsum(inside)[: len(words.data)].astype(bool)]
    return buffer, to


def _rows(table: pa.Table, kind: int) -> list[dict]:
    return table.filter(pa.compute.equal(table.column("kind"), kind)).to_pylist()


def _each(rows: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in rows:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _send(window: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            s = Segment(row)
            s.windows(window)
            out = []
            for b, i, j in runs_of(bucket_of(s.hash, buckets)):
                low = int(s.id[i:j].min())
                out.append((row["seg"], SENT, b, None, low, ascending(s.hash[i:j]), squeezed((s.id[i:j] - low).view(np.uint64)), squeezed(s.place[i:j])))
            yield record(_SCHEMA, out)

    return send


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted hashes among the sorted keys, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _run_of(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, segments and places of some runs' parts of one bucket, which share no hash."""
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, seg, place = (np.concatenate(x) for x in zip(*((ascended(r["a"]), taken(r["b"], r["c"]), loosened(r["d"])) for r in rows)))
    order = np.argsort(h) if len(rows) > 1 else slice(None)
    return h[order], seg[order], place[order]


def _answer(new_run: bool):
    """Answers to the windows sent that a run has; with `new_run` (of the last run) also to those that a smaller id of the batch has, and the new run."""

    def answer(sent: pa.Table, old: pa.Table) -> pa.Table:
        rows = _rows(sent, SENT)
        if not rows:
            return record(_SCHEMA, [], pa.Table)
        bucket, out = rows[0]["bucket"], []
        hashes = [ascended(r["a"]) for r in rows]
        sizes = [len(h) for h in hashes]
        h, of = np.concatenate(hashes), np.repeat(np.arange(len(rows)), sizes)
        run, run_seg, run_place = _run_of(_rows(old, RUN))
        at = _found(run, h)
        seg, place = np.where(at >= 0, run_seg[at], -1) if len(run) else np.full(len(h), -1), run_place[at] if len(run) else np.zeros(len(h), np.int64)
        if new_run:
            # Windows that other runs have were answered before: a segment has an answer of each run at most.
            begin, held = dict(zip((r["seg"] for r in rows), np.cumsum([0, *sizes]))), at >= 0
            for r in _rows(sent, ANSWER):
                held[begin[r["seg"]] + loosened(r["a"])] = True
            fresh = np.flatnonzero(~held)
            ids = np.concatenate([loosened(r["b"]) + r["other"] for r in rows])
            where = np.concatenate([loosened(r["c"]) for r in rows])
            segs = np.array([r["seg"] for r in rows])
            order, first, which = W.grouped(h[fresh])
            one = np.zeros(0, np.int64)
            if len(first):
                # The least id has a window, of equal ones the least segment; a segment sends a window once.
                rank = np.argsort(np.argsort(segs))[of[fresh]]
                least = ids[fresh] == np.minimum.reduceat(ids[fresh][order], first)[which]
                rank[~least] = len(rows)
                owns = rank == np.minimum.reduceat(rank[order], first)[which]
                one = np.empty(len(first), np.int64)
                one[which[owns]] = fresh[owns]
                owner = one[which]
                later = ids[owner] < ids[fresh]
                seg[fresh[later]], place[fresh[later]] = segs[of[owner[later]]], where[owner[later]]
            out.append((None, RUN, bucket, 0, None, ascending(h[one]), *chosen(segs[of[one]]), squeezed(where[one])))
        for i, j, r in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), rows):
            hit = np.flatnonzero(seg[i:j] >= 0)
            if len(hit):
                out.append((r["seg"], ANSWER, bucket, None, None, squeezed(hit), *chosen(seg[i:j][hit]), squeezed(place[i:j][hit])))
        return record(_SCHEMA, out, pa.Table)

    return answer


def _merge(level: int):
    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _rows(left, RUN) + _rows(right, RUN)
        if not rows:
            return record(_SCHEMA, [], pa.Table)
        h, seg, place = _run_of(rows)
        return record(_SCHEMA, [(None, RUN, rows[0]["bucket"], level, None, ascending(h), *chosen(seg), squeezed(place))], pa.Table)

    return merge


def _ask(window: int, buckets: int):
    """What has to be read to verify a segment's answers: stretches of windows that follow each other in both texts."""

    def ask(table: pa.Table) -> pa.Table:
        row = _rows(table, SEGMENT)[0]
        s = Segment(row)
        s.windows(window)
        seg, place = np.full(len(s.hash), -1), np.zeros(len(s.hash), np.int64)
        begin = {b: i for b, i, _ in runs_of(bucket_of(s.hash, buckets))}
        for r in _rows(table, ANSWER):
            which = begin[r["bucket"]] + loosened(r["a"])
            seg[which], place[which] = taken(r["b"], r["c"]), loosened(r["d"])
        # What no other segment has belongs to the least id here.
        mine = (seg[s.which] < 0) & (s.id[s.which] < s.ids[s.words.row[s.at]])
        there = np.where(mine, row["seg"], seg[s.which])
        at, there, place = s.at[there >= 0], there[there >= 0], np.where(mine, s.place[s.which], place[s.which])[there >= 0]
        follows = (np.diff(at) == 1) & (np.diff(place) == 1) & (np.diff(there) == 0)
        first = np.flatnonzero(np.concatenate([[True], ~follows]))[: len(at)]
        size = np.diff(np.append(first, len(at)))
        order = np.argsort(there[first], kind="stable")
        first, size = first[order], size[order]
        return record(_SCHEMA, [(int(o), REQUEST, None, None, row["seg"], squeezed(place[first[i:j]]), squeezed(size[i:j]), squeezed(at[first[i:j]])) for o, i, j in runs_of(there[first])], pa.Table)

    return ask


def _reply(window: int):
    """The words of the stretches asked for, as far as the segment goes."""

    def reply(table: pa.Table) -> pa.Table:
        asked = _rows(table, REQUEST)
        if not asked:
            return record(_SCHEMA, [], pa.Table)
        text, to = Segment(_rows(table, SEGMENT)[0]).spaced()
        out = []
        for r in asked:
            place, size = loosened(r["a"]), loosened(r["b"])
            low, high = to[place], to[np.minimum(place + size + window - 1, len(to) - 1)]
            told = b"".join(text[i:j].tobytes() for i, j in zip(low, high))
            out.append((r["other"], REPLY, None, None, None, squeezed(size), r["c"], squeezed(high - low), zstandard.ZstdCompressor(level=1).compress(told)))
        return record(_SCHEMA, out, pa.Table)

    return reply


def _cut(window: int):
    """The segment's documents without the words of stretches that are equal word by word."""

    def cut(table: pa.Table) -> pa.Table:
        row = _rows(table, SEGMENT)[0]
        s = Segment(row)
        text, to = s.spaced()
        depth = np.zeros(len(to), np.int64)
        for r in _rows(table, REPLY):
            told, at = zstandard.ZstdDecompressor().decompress(r["d"]) if r["d"] else b"", 0
            for size, place, n in zip(loosened(r["a"]).tolist(), loosened(r["b"]).tolist(), loosened(r["c"]).tolist()):
                end = place + size + window - 1
                if text[to[place] : to[end]].tobytes() == told[at : at + n]:
                    depth[place] += 1
                    depth[end] -= 1
                at += n
        words, counts = s.words, s.words.counts()
        keep = np.cumsum(depth)[:-1] == 0
        buffer, to = spaced(words, keep)
        who = words.row[keep]
        bounds = to[np.searchsorted(who, np.arange(words.n_rows + 1))]
        texts = [buffer[a : b - 1].tobytes() if b > a else b"" for a, b in zip(bounds[:-1], bounds[1:])]
        removed = counts - np.bincount(who, minlength=words.n_rows)
        sums = [hashlib.sha256(x).hexdigest() for x in texts]
        return pa.Table.from_arrays([pa.array(s.ids), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sums)], schema=_RESULT)

    return cut


class FingerprintIndex:
    """Segments and runs under a folder; `runs` lists (level, table)."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = 50, fan_in: int = 2, files: int | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "fingerprints")
        self.window, self.fan_in = window, fan_in
        #: Files of a run, and the buckets that lie in them; fixed for the index's life.
        self.files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = 3 * self.files
        self.runs: list[tuple[int, str]] = []
        self.segments: list[DataFrame] = []

    def _table(self, df: DataFrame) -> str:
        """df as a table bucketed as all runs are, one file for each task."""
        name = f"tessera_run_{uuid.uuid4().hex}"
        with tidy(self.spark):
            df.write.format("parquet").option("path", f"{self.path}/{name}").bucketBy(self.files, "bucket").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table {name}")
        delete_path(self.spark, f"{self.path}/{name}")

    def _of(self, name: str, kind: int) -> DataFrame:
        return self.spark.table(name).where(F.col("kind") == kind)

    def compact(self) -> None:
        """Merge each level that has `fan_in` runs into one run of the next level; the merged runs are deleted."""
        while full := next((x for level in {r[0] for r in self.runs} if len(x := [r for r in self.runs if r[0] == level]) >= self.fan_in), None):
            level, name = full[0]
            for _, other in full[1:]:
                both = self._of(name, RUN).groupBy("bucket").cogroup(self._of(other, RUN).groupBy("bucket"))
                merged = self._table(both.applyInArrow(_merge(level + 1), _COLUMNS))
                self._drop(name)
                self._drop(other)
                name = merged
            self.runs = [r for r in self.runs if r not in full] + [(level + 1, name)]

    def drop(self) -> None:
        """Delete all runs: no batch can follow, but results of earlier ones can still be read."""
        while self.runs:
            self._drop(self.runs.pop()[1])

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Add a batch (doc, t), of ids greater than all before; returns a row per document of the batch: doc, n_words, n_removed, kept, kept_sha256."""
        segments = written(batch.select("doc", "t").mapInArrow(_segments(len(self.segments)), _COLUMNS), "segments")
        self.segments.append(segments)
        sent = segments.mapInArrow(_send(self.window, self.buckets), _COLUMNS)
        # All runs but the largest answer first; the largest is joined with the windows sent and these answers.
        *small, large = [self._of(name, RUN) for _, name in sorted(self.runs)] or [small_table(self.spark, [], _COLUMNS)]
        answers = [written(sent.groupBy("bucket").cogroup(run.groupBy("bucket")).applyInArrow(_answer(False), _COLUMNS), "answers") for run in small]
        name = self._table(reduce(DataFrame.unionAll, answers, sent).groupBy("bucket").cogroup(large.groupBy("bucket")).applyInArrow(_answer(True), _COLUMNS))
        self.runs.append((0, name))
        told = reduce(DataFrame.unionAll, answers, self._of(name, ANSWER))
        requests = written(segments.unionAll(told).groupBy("seg").applyInArrow(_ask(self.window, self.buckets), _COLUMNS), "requests")
        replies = written(self._replies(requests), "replies")
        self.compact()
        return segments.unionAll(replies).groupBy("seg").applyInArrow(_cut(self.window), RESULT)

    def _replies(self, requests: DataFrame) -> DataFrame:
        """Requests meet the segments they are for; one that many ask goes to several tasks."""
        asked = requests.groupBy("seg").count().select(F.col("seg").alias("asked"), F.ceil(F.col("count") / REQUESTS).cast("int").alias("parts"))
        segments = reduce(DataFrame.unionAll, self.segments).join(asked, F.col("seg") == F.col("asked"))
        part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        own = [c.split()[0] for c in _COLUMNS.split(", ")]
        spread = requests.join(asked, F.col("seg") == F.col("asked")).select(*own, F.pmod(F.xxhash64("other"), F.col("parts")).cast("int").alias("part"))
        both = segments.select(*own, part).unionAll(spread)
        return both.groupBy("seg", "part").applyInArrow(_reply(self.window), _COLUMNS)


def deduplicate_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 3, window: int = 50) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (text), kept_sha256.

    Words are what stands between white space, unchanged. A word goes if it is
    covered by a window whose words also start in a document with a smaller
    id. All windows are judged on the input. The table is ingested in `batches`
    id ranges, as if they had come one after another. A null or empty text has
    no words. Null ids count as the largest and as equal; rows with equal ids,
    repeated ones too, don't remove from each other. Texts of any length are
    read whole. Ids are whole numbers. Other columns are ignored, so their
    names cannot clash. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted({int(c) for c in rows.where("doc is not null").approxQuantile("doc", shares, 0.01)}) if shares else []
    index = FingerprintIndex(spark, window=window)
    out = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        batch: Column = F.col("doc").isNotNull()
        batch = batch if low is None else batch & (F.col("doc") >= low)
        batch = batch if high is None else batch & (F.col("doc") < high)
        out.append(index.ingest(rows.where(batch)))
    if not rows.where("doc is null").isEmpty():
        null = index.ingest(rows.where("doc is null").withColumn("doc", F.lit(0).cast("long")))
        out.append(null.withColumn("doc", F.lit(None).cast("long")))
    index.drop()
    return reduce(DataFrame.unionAll, out).withColumnRenamed("doc", "id")
