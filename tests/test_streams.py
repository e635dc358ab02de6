"""Streams over files that arrive one after another."""

from pyspark.sql import functions as F

from saltmarsh.streaming import monitor, schedule


def test_first_run_is_quiet_and_keys_come_back_later(spark, tmp_path):
    folder = str(tmp_path / "in")
    for k, day in enumerate(("2024-01-01", "2024-01-02", "2024-03-01", "2024-03-02", "2024-03-03")):
        rows = [(k, "a", day), (10 + k, "b" if k % 2 else "c", day)]
        spark.createDataFrame(rows, "id long, key string, day string").select("id", "key", F.to_timestamp("day").alias("at")).coalesce(1).write.mode("append").parquet(folder)
    said = []

    def put(batch, number):
        said.append(sorted(r.id for r in schedule.announced(batch, number == 0, 2).collect()))

    stream = monitor.new_rows(spark, folder, spark.read.parquet(folder).schema, files_a_batch=1)
    stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    assert said[0] == [] and [len(s) for s in said[1:5]] == [2, 2, 2, 2]
    batch = spark.range(31)
    assert schedule.announced(batch, False).count() == 0 and schedule.announced(batch.limit(30), False).count() == 30
    stream = monitor.new_rows(spark, folder, spark.read.parquet(folder).schema, files_a_batch=1)
    keys = [r.key for r in monitor.caught_up(schedule.forgetful(stream, "at", ["key"]), "forgetful").collect()]
    assert sorted(set(keys)) == ["a", "b", "c"] and keys.count("a") == 2
