"""Orders within keys, also where one key has more rows than a task should sort.

Rows are then dealt by ranges of (key, order) and stored; what a range needs to
know of the ones before or after it in its key, a count or a value, comes from a
table with a row for each key and range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .durable import cut

#: Rows of one key that a task sorts for a window.
KEY_ROWS = 20_000_000


def large(df: DataFrame, key: str) -> bool:
    """Whether some key has more rows than that."""
    most = df.groupBy(key).count().agg(F.max("count")).first()[0]
    return (most or 0) > KEY_ROWS


def in_parts(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df stored with `part`: ranges of (key, order), in order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, key, *order).withColumn("part", F.spark_partition_id()))


def numbered(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """df with the number of each row in its key, from 0."""
    if not large(df, key):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
    p = in_parts(df, key, order)
    before = Window.partitionBy("of_key").orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = p.groupBy(F.col(key).alias("of_key"), F.col("part").alias("of_part")).count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    inside = Window.partitionBy("part", key).orderBy(*order)
    joined = p.withColumn(name, F.row_number().over(inside) - 1).join(counts, (F.col(key) == F.col("of_key")) & (F.col("part") == F.col("of_part")))
    return joined.withColumn(name, F.col(name) + F.col("base")).select(*df.columns, name)
