"""Times of rows and what a data set's times are like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ZONE, datetime_ms, epoch_ms, parse_number


def timed(df: DataFrame, date: Column, time: Column, utc: Column, zone: str = ZONE) -> DataFrame:
    """``df`` with time_ms and time_kind, the cells a row's time came from (null without a time)."""
    filled = (F.trim(date) != "") & (F.trim(time) != "")
    local = F.when(filled, datetime_ms(F.concat_ws(" ", F.trim(date), F.trim(time)), zone))
    rows = df.withColumns({"_local": local, "_number": epoch_ms(parse_number(utc)), "_text": datetime_ms(utc, zone)})
    kind = F.when(F.col("_local").isNotNull(), "date_time").when(F.col("_number").isNotNull(), "utc_numeric").when(F.col("_text").isNotNull(), "utc_datetime")
    return rows.withColumns({"time_ms": F.coalesce("_local", "_number", "_text"), "time_kind": kind}).drop("_local", "_number", "_text")


def profile(rows: DataFrame) -> DataFrame:
    """One row: rows, rows with a time, first and last time, and where times come from."""
    kinds = {k: F.count_if(F.col("time_kind") == k) > 0 for k in ("date_time", "utc_numeric", "utc_datetime")}
    utc = kinds["utc_numeric"] | kinds["utc_datetime"]
    strategy = (
        F.when(kinds["date_time"] & utc, "date_time_with_utc_fallback").when(kinds["date_time"], "date_time")
        .when(kinds["utc_numeric"] & kinds["utc_datetime"], "utc_mixed").when(kinds["utc_numeric"], "utc_numeric").when(kinds["utc_datetime"], "utc_datetime").otherwise("missing")
    )
    return rows.agg(F.count("*").alias("total"), F.count("time_ms").alias("timed"), F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"), strategy.alias("strategy"))


def selector(rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(row id, time) of the rows with a time, for choosing windows."""
    return rows.filter(F.col("time_ms").isNotNull()).select(row_id, "time_ms")
