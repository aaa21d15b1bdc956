import pytest
from pyspark.sql import functions as F

from itemloom.operators import change_log, index
from itemloom.streaming import changes

SCHEMA = "k string, v long, image string"


@pytest.fixture()
def log(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 2, None), ("b", 1, "y"), ("b", 3, "z"), ("b", 3, "z"), ("c", 1, "w"), ("a", 3, "n")]
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return rows, str(tmp_path / "log"), tmp_path


def started(spark, stream, name, mode, tmp_path):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_fold_equals_the_batch_form(spark, log):
    rows, folder, tmp = log
    found = started(spark, changes.fold(changes.read_log(spark, folder, SCHEMA), ["k"], ["v"], "image"), "folded", "complete", tmp)
    batch = index.fold(spark.createDataFrame(rows, SCHEMA), ["k"], ["v"], "image")
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in batch.collect()}


def test_records_equal_the_batch_form(spark, log):
    rows, folder, tmp = log
    found = started(spark, changes.records(changes.read_log(spark, folder, SCHEMA), "k", "v", "image"), "recorded", "append", tmp)
    batch = change_log.records(spark.createDataFrame(rows, SCHEMA).distinct(), ["k"], "v", "image").select("k", "v", "event_name", "old_image", "new_image")
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in batch.collect()}


def test_snapshots(spark, log):
    rows, folder, tmp = log
    changes.put_into(changes.read_log(spark, folder, SCHEMA, 10), str(tmp / "state"), ["k"], "v", str(tmp / "checkpoint")).awaitTermination()
    found = spark.read.schema(SCHEMA).parquet(str(tmp / "state" / "batch=0"))
    assert {tuple(r) for r in found.collect()} == {("a", 3, "n"), ("b", 3, "z"), ("c", 1, "w")}


def test_expiry_stream(spark, tmp_path):
    spark.createDataFrame([(1, 5.0), (2, 500.0)], "id int, ttl double").write.parquet(str(tmp_path / "items"))
    stream = changes.removals(changes.read_log(spark, str(tmp_path / "items"), "id int, ttl double"), "ttl", 50, ["id"])
    assert [r.id for r in started(spark, stream, "expired", "append", tmp_path).collect()] == [1]


def test_retention(spark):
    made = spark.createDataFrame([(1, 10), (2, 100_000)], "id int, at long")
    assert [r.id for r in changes.retained(made, F.col("at"), 100_001).collect()] == [2]
