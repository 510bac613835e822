import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import index
from tessera.operators.regions import BOX
from tessera.streaming import maintenance


def test_running_bounds_closes_windows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i % 2, t0 + dt.timedelta(minutes=10 * i), float(i), -float(i), 0.0) for i in range(40)]
    made = spark.createDataFrame(rows, "key long, ts timestamp, x double, y double, z double")
    made.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    q = maintenance.running_bounds(stream, "key").writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.window_start, r.key): (r.n, r.minx, r.maxx) for r in spark.table("closed").collect()}
    want = {(r.window_start, r.key): (r.n, r.minx, r.maxx) for r in maintenance.running_bounds(made, "key").collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= 8


def boxes_of(spark, n=200):
    low, high = BOX[:3], BOX[3:]
    return spark.range(n).selectExpr("id as box_id", *(f"cast(id as double) + {i} as {x}" for i, x in enumerate(low)), *(f"cast(id as double) + {i} + 1 as {x}" for i, x in enumerate(high)), "0 as root_id")


class Stored:
    """An index in files, replaced as a whole by each batch."""

    def __init__(self, spark, path, boxes):
        self.spark, self.path, self.turn = spark, str(path), 0
        nodes, order = index.build_nodes(boxes)
        order.write.parquet(f"{self.path}/order")
        self.write(nodes, boxes.select("box_id", *BOX))

    def write(self, nodes, boxes):
        nodes.write.parquet(f"{self.path}/nodes{self.turn + 1}")
        boxes.write.parquet(f"{self.path}/boxes{self.turn + 1}")
        self.turn += 1

    def load(self):
        read = self.spark.read.parquet
        return read(f"{self.path}/nodes{self.turn}"), read(f"{self.path}/order"), read(f"{self.path}/boxes{self.turn}")


def run(spark, tmp_path, stored, batches, at=None):
    """The batches, one file each, through `maintain`."""
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.parquet(str(tmp_path / "changes" / f"part{i}"))
        q = maintenance.maintain(spark.readStream.schema(batch.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "changes")), stored.load, stored.write, at)
        q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()


def bounds_of(nodes):
    return sorted(map(tuple, nodes.select("node_id", *BOX).collect()))


def shifted(boxes, where, by):
    return boxes.where(where).select("box_id", *((F.col(x) + by).alias(x) for x in BOX))


def test_several_batches_equal_a_rebuild(spark, tmp_path):
    """The second batch touches a leaf that the first has moved, and moves another box of it."""
    boxes = boxes_of(spark)
    stored = Stored(spark, tmp_path, boxes)
    batches = [shifted(boxes, "box_id in (3, 77)", -500), shifted(boxes, "box_id in (4, 120)", 900), shifted(boxes, "box_id in (3)", 0), shifted(boxes, "box_id = 150", 5)]
    run(spark, tmp_path, stored, batches)
    nodes, order, now = stored.load()
    want = boxes.select("box_id", *BOX)
    for b in batches:
        want = want.join(b.select("box_id"), "box_id", "left_anti").unionByName(b)
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, want.collect()))
    assert bounds_of(nodes) == bounds_of(index.refit(*index.build_nodes(boxes), want))
    assert nodes.where("parent_id < 0").first().minx == -423.0


def test_the_latest_of_a_batch_counts_and_unknown_boxes_are_left_out(spark, tmp_path):
    boxes = boxes_of(spark, 60)
    stored = Stored(spark, tmp_path, boxes)
    twice = shifted(boxes, "box_id = 5", 100).withColumn("at", F.lit(2)).unionByName(shifted(boxes, "box_id = 5", 300).withColumn("at", F.lit(1)))
    run(spark, tmp_path, stored, [twice.unionByName(shifted(boxes, "box_id = 6", 0).withColumns({"box_id": F.lit(1000).cast("long"), "at": F.lit(1)}))], "at")
    nodes, _, now = stored.load()
    assert now.count() == 60 and now.where("box_id = 5").first().minx == 105.0
    assert nodes.where("parent_id < 0").first().maxx == 106.0


def test_state_passes_on_what_changes(spark, tmp_path):
    """Of each key the newest row of a batch, if it is later than what came before and differs from it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ddl = "object_id long, at long, m0 double, m12 double"
    batches = [
        [(1, 1, 1.0, 0.0), (2, 1, 1.0, 5.0), (2, 2, 1.0, 6.0)],
        [(1, 2, 1.0, 0.0), (2, 1, 9.0, 9.0), (3, 1, 2.0, 0.0)],  # the same, late, new
        [(1, 3, 1.0, 4.0), (2, 3, 1.0, 6.0), (3, 1, 2.0, 0.0)],  # changed, the same, repeated
    ]
    got, state = [], {}
    want = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
        stream = spark.readStream.schema(ddl).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = maintenance.changed_rows(stream, "object_id", "at").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
        q = q.foreachBatch(lambda df, n: got.append(sorted(map(tuple, df.collect())))).start()
        q.processAllAvailable()
        q.stop()
        told = {}
        for k, at, *values in sorted(rows, key=lambda r: r[1]):
            if k not in state or at > state[k][0]:
                if k not in state or state[k][1] != values:
                    told[k] = (k, at, *values)
                state[k] = (at, values)
        want.append(sorted(told.values()))
    spark.conf.set(key, before)
    assert [g for g in got if g] == [w for w in want if w]
