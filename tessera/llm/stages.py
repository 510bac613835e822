"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from . import pieces
from .decontaminate import find_overlap
from .exact_dedup import exact_dedup, normalised
from .language_id import UNKNOWN, identify
from .near_dedup import near_duplicates
from .shared import SLICE_BYTES, delete_path, free_names, fresh_path, lean_batches, materialize, scratch

#: The public SentencePiece model; its folder is a parameter and the same on all machines.
MODEL_PATH = os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")

_loaded: dict[str, pieces.Vocabulary] = {}


def _vocabulary(path: str) -> pieces.Vocabulary:
    if path not in _loaded:
        _loaded[path] = pieces.load(path)
    return _loaded[path]


def _parts(texts: pa.Array, limit: int = 4 * SLICE_BYTES):
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > limit:
            yield texts.slice(start, i - start)
            start, size = i, 0
        size += int(n)
    yield texts.slice(start)


def encoder(spark: SparkSession, model: str = MODEL_PATH, digests: bool = False, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> Callable[[DataFrame], DataFrame]:
    """docs -> id and ids (array of int), with `decoded` also round_trip; with `digests`: id, n_ids, ids_sha256 (little-endian int32) and round_trip.

    round_trip: whether decoding the ids gives the text back. A null or empty
    text has no ids. The mark U+2581 is encoded as a space, as the format has
    it, and so comes back as one. Long texts are encoded whole, in a bounded
    window. Rows are encoded each for itself, so ids may be null or repeated;
    other columns are left out, so their names cannot clash; an empty table
    gives an empty result.
    """

    lean_batches(spark)

    @arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pieces.encode_texts(_vocabulary(model), x) for x in _parts(texts)])

    @arrow_udf("n_ids long, ids_sha256 string, round_trip boolean")
    def digest(texts: pa.Array) -> pa.Array:
        v, out = _vocabulary(model), []
        for part in _parts(texts):
            lists = pieces.encode_texts(v, part)
            ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<i4")
            back = pieces.decode_lists(v, lists)
            same = pa.compute.equal(back, pa.compute.fill_null(part.cast(pa.string()), ""))
            sums = [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(ends[:-1], ends[1:])]
            out.append(pa.StructArray.from_arrays([pa.array(np.diff(ends), pa.int64()), pa.array(sums), same], ["n_ids", "ids_sha256", "round_trip"]))
        return pa.concat_arrays(out)

    @arrow_udf("ids array<int>, round_trip boolean")
    def both(texts: pa.Array) -> pa.Array:
        v, out = _vocabulary(model), []
        for part in _parts(texts):
            lists = pieces.encode_texts(v, part)
            same = pa.compute.equal(pieces.decode_lists(v, lists), pa.compute.fill_null(part.cast(pa.string()), ""))
            out.append(pa.StructArray.from_arrays([lists, same], ["ids", "round_trip"]))
        return pa.concat_arrays(out)

    if decoded:
        return lambda docs: docs.select(F.col(id_col).alias("doc_id"), both(F.col(text_col)).alias("d")).select("doc_id", "d.*")
    if digests:
        return lambda docs: docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("d")).select("doc_id", "d.*")
    return lambda docs: docs.select(F.col(id_col).alias("doc_id"), encode(F.col(text_col)).alias("ids"))


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the operator rejects go: those without a letter, or all if no row has a label to learn from.

    A guess between languages is no reason to reject; it is reported by the
    operator's own query. Null and empty texts go. Repeated rows stay or go
    alike, as do rows with a null id. Long texts are read whole. Any other
    columns pass through, whatever their names. An empty table stays empty.
    """
    held, guess = free_names(docs, "held_out", "guess")
    return identify(docs, held_col=held, guess_col=guess).where(F.col(f"{guess}.lang") != UNKNOWN).select(*docs.columns)


def _one_of_each(docs: DataFrame, tag: Column, keys: DataFrame, how: str) -> DataFrame:
    """docs with (how: left_semi) or without (left_anti) the rows that keys (id, tag) name; a null id matches a null id. Of the rows that stay with one id and tag, one if semi."""
    own, told = free_names(docs, "_id", "_tag")
    marked = docs.withColumns({own: F.col("doc_id"), told: tag})
    named = keys.select(F.col("id").alias("key_id"), F.col("tag").alias("key_tag"))
    found = marked.join(named, marked[own].eqNullSafe(named["key_id"]) & (marked[told] == named["key_tag"]), how)
    return (found.dropDuplicates([own, told]) if how == "left_semi" else found).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the smallest doc_id stays; of rows repeated whole, one.

    Null and empty texts are equal to each other. A null id counts as the
    largest. Texts of any length are compared whole. Any other columns pass
    through, whatever their names. An empty table stays empty.
    """
    kept = exact_dedup(docs).where("kept").select("id", F.unhex("text_sha256").alias("tag"))
    return _one_of_each(docs, F.unhex(F.sha2(normalised(F.col("text")), 256)), kept, "left_semi")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id.

    Texts without words are one group. A null id counts as the largest; of
    rows repeated whole, one stays. Texts of any length are read whole. Any
    other columns pass through, whatever their names. An empty table stays empty.
    """
    kept = near_duplicates(docs).where("kept").select("id", F.col("text_tag").alias("tag"))
    return _one_of_each(docs, F.xxhash64(F.coalesce("text", F.lit(""))), kept, "left_semi")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    A row goes by its own text: rows that share its id, or have a null id as
    it has, stay if they are clean. Null and empty texts stay. Repeated rows
    stay or go alike. Texts of any length are read whole. Any other columns
    pass through, whatever their names. An empty table stays empty.
    """
    found = find_overlap(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = found.where("contaminated").select("id", F.col("text_tag").alias("tag")).distinct()
    return _one_of_each(docs, F.xxhash64(F.coalesce("text", F.lit(""))), leaks, "left_anti")


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document: doc_id, the SentencePiece ids of its text, and whether decoding them gives the text back.

    A null or empty text has no ids and comes back as the empty text. A null
    id stays null; repeated rows are encoded alike; long texts are encoded
    whole. Other columns are left out, so their names cannot clash. An empty
    table gives an empty result.
    """
    return encoder(spark, decoded=True)(docs)


STAGES = [
    ("language ID", known_languages),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding and decoding", piece_ids),
]


def run_stages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; what a stage and its predecessor have written is deleted once its result stands."""
    before = None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            path = fresh_path(spark, name.replace(" ", "-"))
            docs = materialize(stage(spark, docs, sf_dir), name, path)
            keep(path)
        if before:
            delete_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
