"""Session helpers: the shared work folder, written tables, byte-bounded batches."""

from __future__ import annotations

import contextlib
import json
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Text bytes that a numpy kernel holds at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows of a slice at most; kernels pack a row's number into 16 bits.
SLICE_ROWS = 1 << 15

_own_dir: str | None = None
#: Folders made and not yet deleted, by the scratch blocks that are open.
_made: list[list[str]] = [[]]


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    global _own_dir
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return qualified(spark, root)
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="tessera-work-")
    return _own_dir


def qualified(spark: SparkSession, path: str) -> str:
    """path as a full URI of Hadoop's file systems, so that readers other than Spark find the same place."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = str(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target))
    return (found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file://") else found).rstrip("/")


#: Rows that Spark hands to Python at once, where the session has the default of 10,000: texts may be long.
BATCH_ROWS = 1000


def lean_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it has set its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the folders made inside, but for those that are kept: its value is a function that keeps a path."""
    _made.append([])
    kept: list[str] = []
    try:
        yield kept.append
    finally:
        for path in _made.pop():
            if path in kept:
                _made[-1].append(path)
            else:
                delete_path(spark, path)


def discard(spark: SparkSession) -> None:
    """Delete every folder that this process has written and not yet deleted: results that were not written elsewhere are lost."""
    for made in _made:
        for path in list(made):
            delete_path(spark, path)


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = path or fresh_path(df.sparkSession, label)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    for made in _made:
        if path in made:
            made.remove(path)


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS):
    """Row slices of a batch of at most `rows` rows whose text column holds at most `limit` bytes, or of one row."""
    col = batch.column(column)
    n = len(col)
    if n == 0:
        return
    lengths = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i in range(n):
        if i > start and (size + lengths[i] > limit or i - start == rows):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(lengths[i])
    yield batch.slice(start)


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A table of a few rows from one SQL literal: no Python on executors."""
    names = [x.split()[0] for x in ddl.split(", ")]
    told = json.dumps([dict(zip(names, r)) for r in rows])
    kind = "array<struct<" + ", ".join(f"{n}: {x.split()[1]}" for n, x in zip(names, ddl.split(", "))) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(told), kind)))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind as it takes to be no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered_columns(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
