from tessera.plans import durable


def test_what_was_stored_can_be_discarded(spark):
    made = durable.cut(spark.range(10).repartition(2))
    path = durable.fresh(spark, "rows")
    made.write.parquet(path)
    stored = [p for p in durable._made if p != path][-1]
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda p: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))
    assert there(path) and there(stored) and made.count() == 10
    kept, durable._made[:] = durable._made[:-2], [stored, path]  # other tests may still read theirs
    durable.discard(spark)
    assert not there(path) and not there(stored) and not durable._made
    durable._made[:] = kept
