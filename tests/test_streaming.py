import time

from pyspark.sql import functions as F

from cueweave.config import Segmentation
from cueweave.sources import state
from cueweave.streaming import words as S


def feed(tmp_path, spark, name, frames, schema):
    folder = tmp_path / name
    folder.mkdir()
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def drain(writer):
    q = writer.trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()


def test_groups(spark, tmp_path):
    w = [("a", f"w{i}" + ("." if i % 5 == 4 else ""), i * 0.5, i * 0.5 + 0.4) for i in range(20)]
    stream = feed(tmp_path, spark, "words", [w[:8], w[8:20]], "item_id string, word string, start double, end double")
    writer = S.groups(stream, Segmentation(min_duration=1.0)).writeStream.format("memory").queryName("groups").outputMode("append")
    q = writer.option("checkpointLocation", f"{tmp_path}/c1").start()
    try:  # a query with timeouts never runs out of batches
        end = time.time() + 60
        while time.time() < end and spark.table("groups").count() < 3:
            time.sleep(0.5)
    finally:
        q.stop()
    got = [(r.start, r.words, r.closed_by) for r in spark.table("groups").orderBy("start").collect()]
    assert got == [(0.0, 5, "sentence"), (2.5, 5, "sentence"), (5.0, 5, "sentence")]


def test_counts_and_late_rows(spark, tmp_path):
    t = lambda m: f"2024-01-01 00:{m:02d}:00"
    folder, schema = f"{tmp_path}/timed", "item_id string, s string"
    for i, rows in enumerate([[("a", t(1)), ("a", t(2))], [("a", t(40))], [("a", t(3)), ("a", t(59))], [("a", t(59))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder).select("item_id", F.to_timestamp("s").alias("ts"))
        drain(S.counts(stream).writeStream.format("parquet").option("path", f"{tmp_path}/counted").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2"))
    got = {str(r.window_start)[14:16]: r.words for r in spark.read.parquet(f"{tmp_path}/counted").collect()}
    assert got["00"] == 2 and got["40"] == 1


def test_state(spark, tmp_path):
    rows = [[("i", "s", "running", None, "2024-01-01 00:00:01"), ("i", "s", "done", None, "2024-01-01 00:00:02")], [("i", "s", "failed", None, "2024-01-01 00:00:03")]]
    stream = feed(tmp_path, spark, "log", rows, "item_id string, stage string, status string, detail string, at string")
    log = stream.select("item_id", "stage", "status", "detail", F.to_timestamp("at").alias("updated_at"))
    drain(S.keep_state(log, f"{tmp_path}/out", f"{tmp_path}/c3"))
    kept = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert kept.count() == 2 and state.latest(kept).first().status == "failed"
