import duckdb
from pyspark.sql import functions as F

from tabwright import storage
from tabwright.streaming import live

SF = "/root/testdata/sf0.001"


def test_running_totals_of_a_folder(spark, tmp_path):
    folder = tmp_path / "events.parquet"
    spark.read.parquet(f"{SF}/events.parquet").repartition(5).write.parquet(str(folder))
    found = {tuple(r)[:2] for r in live.running_totals(spark, str(folder), "event_type", "value").collect()}
    assert found == set(duckdb.sql(f"SELECT event_type, count(*) FROM '{SF}/events.parquet' WHERE value > 0 GROUP BY 1").fetchall())


def test_windowed_counts(spark, tmp_path):
    events = live.read_stream(spark, f"{SF}/events.parquet")
    counts = live.windowed_counts(events, "ts", "1 hour", "10 minutes", "event_type")
    place = str(tmp_path)
    run = counts.select(F.col("window.start").alias("start"), "event_type", "n").writeStream.outputMode("append").format("parquet")
    run = run.option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    # Windows that the watermark has closed are whole.
    rows = spark.read.parquet(f"{place}/out").collect()
    want = dict(((r[0], r[1]), r[2]) for r in duckdb.sql(f"SELECT date_trunc('hour', ts), event_type, count(*) FROM '{SF}/events.parquet' GROUP BY 1, 2").fetchall())
    assert rows and all(want[r["start"], r["event_type"]] == r["n"] for r in rows)


def test_storage(spark, tmp_path):
    frame = spark.range(10).repartition(3)
    with storage.recording() as paths:
        kept = storage.materialize(frame, "test")
    assert len(paths) == 1 and kept.count() == 10
    storage.discard(kept)
    assert storage.materialize(frame.limit(0), "test").count() == 0
    numbered = storage.global_order(spark.range(100).repartition(7), [F.desc("id")], "test", "place")
    assert all(r["place"] == 99 - r["id"] for r in numbered.collect())
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert storage.scratch_root(spark) == named if named else storage.scratch_root(spark).startswith("file:")
