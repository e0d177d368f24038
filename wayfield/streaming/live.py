"""Structured Streaming forms of the sync and of grid coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import nr_of_score, nr_score, operator_code
from ..operators import zones


def nr_pairs(rows: DataFrame, states: DataFrame, tolerance_ms: int, lateness: str = "1 minute") -> DataFrame:
    """Streams ``rows`` (seq, mcc, mnc, ts) and ``states`` (mcc, mnc, ts, nr), joined within the tolerance.

    One row for each meeting, and one with a null ``found`` for rows that no state meets
    before the watermark passes. ``nr_of_pairs`` folds them into the sync's answer.
    """
    code = lambda df: df.withColumns({"k1": operator_code(F.col("mcc")), "k2": operator_code(F.col("mnc"))})
    left = code(rows).withWatermark("ts", lateness).alias("l")
    known = code(states.filter(F.col("nr").isin("yes", "no"))).select("k1", "k2", F.col("ts").alias("state_ts"), F.col("nr").alias("found"))
    right = known.withWatermark("state_ts", lateness).alias("r")
    step = F.expr(f"INTERVAL {tolerance_ms} MILLISECONDS")
    near = (F.col("state_ts") >= F.col("ts") - step) & (F.col("state_ts") <= F.col("ts") + step)
    return left.join(right, (F.col("l.k1") == F.col("r.k1")) & (F.col("l.k2") == F.col("r.k2")) & near, "left_outer").select("l.seq", "l.ts", "r.found")


def nr_of_pairs(pairs: DataFrame) -> DataFrame:
    """(seq, nr) of collected pairs: any yes wins, everything else is no."""
    return pairs.groupBy("seq").agg(F.when(F.max(F.coalesce((F.col("found") == "yes").cast("int"), F.lit(0))) == 1, "yes").otherwise("no").alias("nr"))


def partial_sums(batch: DataFrame, size: float) -> DataFrame:
    """Sums for each zone, operator, frequency and PCI, which add up over batches."""
    keys = ["zone_x", "zone_y", *zones.OPERATOR, "frequency", "pci"]
    return zones.grid(batch, size).groupBy(*keys).agg(
        F.sum("rsrp_c").alias("rsrp_sum"), F.count("*").alias("n"), F.sum("sinr_c").alias("sinr_sum"), F.count("sinr_c").alias("sinr_n"),
        F.max(nr_score(F.col("nr"))).alias("score"), F.min("seq").alias("first_seq"),
    )


def stats_of_sums(sums: DataFrame) -> DataFrame:
    """The zone statistics of all batches' sums."""
    keys = ["zone_x", "zone_y", *zones.OPERATOR, "frequency", "pci"]
    total = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("rsrp_sum", "n", "sinr_sum", "sinr_n")], F.max("score").alias("score"), F.min("first_seq").alias("first_seq"))
    return total.select(*keys, (F.col("rsrp_sum").cast("double") / F.col("n") / 100).alias("rsrp"), (F.col("sinr_sum").cast("double") / F.nullif(F.col("sinr_n"), F.lit(0)) / 100).alias("sinr"), "n", nr_of_score(F.col("score")).alias("nr"), "first_seq")


def live_coverage(stream: DataFrame, size: float, path: str, checkpoint: str):
    """Start a query that appends each batch's sums under ``path``, a folder for each batch.

    A batch that is run again after a failure overwrites its own folder, so sums count once.
    Read with ``coverage_so_far``.
    """

    def add(batch: DataFrame, number: int) -> None:
        partial_sums(batch, size).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def coverage_so_far(spark: SparkSession, path: str, rsrp: float, sinr: float) -> DataFrame:
    return zones.best_frequency(stats_of_sums(spark.read.parquet(path)), rsrp, sinr)
