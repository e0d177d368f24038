"""Streaming forms give what the batch forms give."""

from pyspark.sql import functions as F

from wayfield.operators import sync, zones
from wayfield.sources import adapter
from wayfield.streaming import live

DATA = "/root/testdata/sf0.001"


def test_live_coverage(spark, tmp_path):
    rows = adapter.measurements(spark, DATA)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.live_coverage(stream, 100.0, str(tmp_path / "sums"), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    want = zones.best_frequency(zones.frequency_stats(zones.grid(rows, 100.0)), -90.0, 5.0)
    got = live.coverage_so_far(spark, str(tmp_path / "sums"), -90.0, 5.0)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_live_sync(spark, tmp_path):
    rows = adapter.measurements(spark, DATA).withColumn("ts", F.timestamp_millis("time_ms"))
    own, known = rows.filter("nr = ''"), rows.filter("nr <> ''")
    # A last state long after everything lets the watermark pass.
    last = known.limit(1).withColumn("ts", F.expr("ts + INTERVAL 4000 DAYS"))
    own.coalesce(1).write.parquet(str(tmp_path / "rows"))
    known.coalesce(1).write.parquet(str(tmp_path / "states"))
    read = lambda p: spark.readStream.schema(rows.schema).parquet(str(tmp_path / p))
    pairs = live.nr_pairs(read("rows").select("seq", "mcc", "mnc", "ts"), read("states"), 60000)
    q = pairs.writeStream.format("memory").queryName("live_pairs").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    last.write.mode("append").parquet(str(tmp_path / "states"))
    own.limit(1).withColumns({"ts": F.expr("ts + INTERVAL 4000 DAYS"), "seq": F.lit(-1).cast("long")}).write.mode("append").parquet(str(tmp_path / "rows"))
    q.processAllAvailable()
    q.stop()
    got = {r.seq: r.nr for r in live.nr_of_pairs(spark.table("live_pairs")).collect() if r.seq >= 0}
    want = {r.seq: r.nr for r in sync.sync(own, known, 60000).collect()}
    assert got == want
