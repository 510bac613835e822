"""Benchmark decontamination by winnowing.

The fingerprint of a window of words is the least hash among its k-grams, so
two texts that share a window share its fingerprint, wherever it lies. Test
fingerprints are joined with those of the corpus, and each hit is extended to
the whole windows around it, compared by two independent 64-bit hashes of all
their words. No shared window is missed.

A bitmap made of all test fingerprints, sixteen bits for each up to 128 MB in
all, goes to every task and sifts the corpus before the join. It only saves
work: whatever passes is joined with the full tables, so a fuller bitmap
changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .shared import lean_batches, materialize, numbered_columns, slices

#: log2 of the bitmap's bits, least and greatest: 128 KB to 128 MB.
SIFT_BITS = (20, 30)

FOUND = pa.schema([
    ("id", pa.int64()), ("nth", pa.int64()), ("text_tag", pa.int64()), ("n_words", pa.int64()),
    ("hits", pa.list_(pa.struct([("fp", pa.int64()), ("length", pa.int32()), ("at", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())]))),
])
FOUND_DDL = "id long, nth long, text_tag long, n_words long, hits array<struct<fp: long, length: int, at: long, h1: long, h2: long>>"


def windows(words: W.Words, length: int, gram: int):
    """(start, fingerprint, hash1, hash2) of all windows of `length` words inside one row."""
    k = min(gram, length)
    inside = W.within(words.row, length)
    fp = W.sliding(W.grams(words.hash, k), length - k + 1)
    return np.flatnonzero(inside), fp[inside], W.grams(words.hash, length)[inside], W.grams(words.hash2, length)[inside]


def _item_windows(items: DataFrame, window: int, gram: int) -> DataFrame:
    """item (string), length, fp, h1, h2 of all windows of the items; a shorter item is one window."""
    out = pa.schema([("item", pa.string()), ("length", pa.int32()), ("fp", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                words = W.tokenize(part.column(1), W.ALNUM_LOWER, second=True)
                counts = words.counts()
                for length in np.unique(np.minimum(counts[counts > 0], window)):
                    at, fp, h1, h2 = windows(words, int(length), gram)
                    row = words.row[at]
                    fit = np.minimum(counts[row], window) == length
                    yield numbered_columns(out, [part.column(0).take(pa.array(row[fit])), np.full(fit.sum(), length, np.int32), *(W.signed(x[fit]) for x in (fp, h1, h2))])

    return items.mapInArrow(cut, "item string, length int, fp long, h1 long, h2 long")


def _bitmap(fingerprints: DataFrame) -> tuple[int, np.ndarray]:
    """log2 of the number of bits, and the bits of all fingerprints: the rows that come to the driver are words of 64 bits."""
    n = fingerprints.select("fp").distinct().count()
    bits = min(max((16 * n).bit_length(), SIFT_BITS[0]), SIFT_BITS[1])
    bit = F.shiftrightunsigned("fp", 64 - bits)
    cell = fingerprints.select(F.shiftright(bit, 6).cast("int").alias("cell"), bit.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    cells = cell.groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[cells.column(0).to_numpy()] = cells.column(1).to_numpy().view(np.uint64)
    return bits, out


def find_overlap(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, gram: int = 5) -> DataFrame:
    """One row per document: id, nth (row number), text_tag (hash of the text, that tells rows with one id apart), n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of digits, letters and non-ASCII characters, A-Z folded. A
    word is hit if it lies in an occurrence of any window of `window`
    consecutive words of an item; an item with fewer words is one window. A
    null or empty text has no words and is never contaminated; an item without
    words matches nothing, and one with a null id hits words but is not
    listed. Repeated items count once, and repeated rows are hit alike. Texts
    of any length are read whole. Ids of documents are whole numbers or null.
    Other columns are ignored, so their names cannot clash. An empty table of
    documents gives an empty result, and one of items hits nothing.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    test = materialize(_item_windows(items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("t")), window, gram), "test-windows")
    lengths = sorted(r[0] for r in test.select("length").distinct().collect())  # `window` values at most
    shipped = spark.sparkContext.broadcast(_bitmap(test))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_bits, bits = shipped.value
        shift = np.uint64(64 - n_bits)
        for batch in batches:
            for part in slices(batch, 3):
                words = W.tokenize(part.column(3), W.ALNUM_LOWER, second=True)
                found = []
                for length in lengths:
                    at, fp, h1, h2 = windows(words, length, gram)
                    bit = fp >> shift
                    hit = np.flatnonzero((bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
                    found.append((words.row[at[hit]], W.signed(fp[hit]), np.full(len(hit), length, np.int32), at[hit], W.signed(h1[hit]), W.signed(h2[hit])))
                row, *cols = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int32)] + [np.zeros(0, np.int64)] * 5
                order = np.argsort(row, kind="stable")
                counts = words.counts()
                first = np.concatenate([[0], np.cumsum(counts)])
                cols[2] = cols[2] - first[row]
                hits = pa.StructArray.from_arrays([pa.array(c[order].astype(t.type.to_pandas_dtype())) for c, t in zip(cols, FOUND.field("hits").type.value_type)], fields=list(FOUND.field("hits").type.value_type))
                ends = np.searchsorted(row[order], np.arange(words.n_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), hits, type=FOUND.field("hits").type)], schema=FOUND)

    text = F.coalesce(F.col(text_col), F.lit(""))
    sifted = materialize(docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("nth"), F.xxhash64(text).alias("text_tag"), text.alias("t")).mapInArrow(sift, FOUND_DDL), "sifted")
    hits = sifted.select("nth", F.inline("hits"))
    joined = hits.join(test.select("fp").distinct(), "fp", "left_semi")
    window_key = ["length", "h1", "h2"]
    known = joined.join(test.select(*window_key).distinct(), window_key, "left_semi")
    spans = known.groupBy("nth").agg(F.collect_set(F.struct("at", "length")).alias("spans"))
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))))
    named = known.select("nth", *window_key).distinct().join(test.where("item is not null").select("item", *window_key).distinct(), window_key)
    listed = named.groupBy("nth").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = spans.select("nth", n_hit.cast("long").alias("n_hit")).join(listed, "nth", "left")
    n_hit, items_found = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return sifted.select("id", "nth", "text_tag", "n_words").join(found, "nth", "left").select(
        "id", "nth", "text_tag", "n_words", n_hit.alias("n_hit"), F.size(items_found).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_found, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
