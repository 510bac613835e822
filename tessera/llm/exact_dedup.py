"""Exact deduplication by a tree merge of sorted digest runs (DataFrame functions only).

Every input partition first becomes a run: its distinct text digests, sorted,
each with the smallest row that has it and a count. Runs are then merged in
binomial rounds, `fan_in` neighbouring runs at a time, until one is left. Each
round keeps the smallest identifier of a digest. A round's exchange is dealt
by (run, digest), so that a run is itself spread over many tasks and a text
that makes up a third of all rows arrives as one row from each run.

A text's identity is SHA-256 together with its length and an independent
64-bit hash; texts merge only where all three agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import materialize

WHITE = r"[\x20\x09-\x0D]+"
IDENTITY = ["digest", "check", "size"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def digest_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, order within equal ids, and the text's identity."""
    text = normalised(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("nth"), text.alias("t")).select(
        "id", "nth", F.unhex(F.sha2("t", 256)).alias("digest"), F.xxhash64("t").alias("check"), F.octet_length("t").alias("size")
    )


def merge_runs(rows: DataFrame, n_runs: int, fan_in: int = 8) -> DataFrame:
    """Distinct identities with their first row (struct: null ids last, then id, then nth) and their count."""
    first = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("nth"))
    # The nth of a row has its partition in the upper bits: partition p is run p at the leaves.
    runs = rows.select(*IDENTITY, F.shiftright("nth", 33).alias("run"), first.alias("first"), F.lit(1).cast("long").alias("n"))
    left = max(1, n_runs)
    while True:
        left = -(-left // fan_in)
        run = F.floor(F.col("run") / fan_in) if left > 1 else F.lit(0).cast("long")
        runs = runs.withColumn("run", run).groupBy("run", *IDENTITY).agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        runs = runs.sortWithinPartitions("run", *IDENTITY)
        if left == 1:
            return runs.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (lower-case hex of the normalised text).

    Texts are equal when identical after each run of white space is one space.
    The row with the smallest id stays; among repeated rows with the same id
    just one is kept, and a null id sorts last. A null text counts as empty,
    and empty texts are equal to each other. Texts of any length are compared
    whole. Other columns are ignored, so their names cannot clash. An empty
    table gives an empty result.
    """
    rows = materialize(digest_rows(docs, id_col, text_col), "digests")
    last = rows.agg(F.max(F.shiftright("nth", 33))).first()[0]
    merged = materialize(merge_runs(rows, 1 + (last or 0), fan_in), "merged-runs")
    same = [rows[c] == merged[c] for c in IDENTITY]
    return rows.join(merged, same).select(
        rows["id"].alias("id"),
        F.col("first.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (rows["nth"] == F.col("first.nth")).alias("kept"),
        F.lower(F.hex(rows["digest"])).alias("text_sha256"),
    )
