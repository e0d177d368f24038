"""Views of the ``events`` table as measurements and as route points.

The view's SQL is one text for Spark and for comparison SQL, apart from two words.
Signal values are integer hundredths, so that sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MEASUREMENTS = """
SELECT e.event_id AS seq, CAST(e.user_id % 3 AS INT) AS source_idx, {ms} AS time_ms,
 '231' AS mcc, CASE e.user_id % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' ELSE '6' END AS mnc,
 CAST(e.user_id % 7 AS {string}) AS pci,
 CASE e.event_type WHEN 'view' THEN '783000000' WHEN 'click' THEN '796000000' WHEN 'purchase' THEN '1827500000' WHEN 'signup' THEN '3500000000' ELSE '2140000000' END AS frequency,
 -6000 - least(CAST(round(e.value * 100) AS BIGINT), 8000) AS rsrp_c,
 CASE WHEN e.event_id % 5 = 0 THEN NULL ELSE CAST(round(e.value * 100) AS BIGINT) % 4000 - 1000 END AS sinr_c,
 CASE e.event_type WHEN 'purchase' THEN 'yes' WHEN 'error' THEN 'no' ELSE '' END AS nr,
 CAST(e.user_id % 25 AS DOUBLE) * CAST(37.5 AS DOUBLE) AS x, CAST(e.event_id % 40 AS DOUBLE) * CAST(12.5 AS DOUBLE) AS y,
 CAST(17.1 AS DOUBLE) + CAST(e.event_id % 500 AS DOUBLE) * CAST(0.0005 AS DOUBLE) AS lon,
 CAST(48.1 AS DOUBLE) + CAST(e.event_id % 300 AS DOUBLE) * CAST(0.0005 AS DOUBLE) AS lat
FROM events e
"""

#: The same with positions that spread as the table grows: a column of zones spans at most
#: three users, hence three of the four operators, so zones have gaps at every size.
SPREAD = MEASUREMENTS.replace("CAST(e.user_id % 25 AS DOUBLE)", "CAST(e.user_id AS DOUBLE)")
#: And with as many rows of zones as the events need.
WIDE = SPREAD.replace("CAST(e.event_id % 40 AS DOUBLE) * CAST(12.5 AS DOUBLE)", "CAST(e.event_id AS DOUBLE) * CAST(0.25 AS DOUBLE)")

ROUTE_POINTS = """
SELECT event_id AS seq, CAST(user_id % 3 AS INT) AS source_idx,
 CAST(CASE user_id % 3 WHEN 0 THEN event_id WHEN 1 THEN event_id + 4000 ELSE n - event_id END AS DOUBLE) * CAST(0.25 AS DOUBLE) AS x,
 CAST(user_id % 3 AS DOUBLE) * CAST(8 AS DOUBLE) AS y
FROM events CROSS JOIN (SELECT max(event_id) AS n FROM events) m
"""

SPARK = {"ms": "CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', e.ts) div 1000 AS BIGINT)", "string": "STRING"}
DUCKDB = {"ms": "epoch_us(e.ts)//1000", "string": "VARCHAR"}


def measurements(spark: SparkSession, sf_dir: str, view: str = MEASUREMENTS) -> DataFrame:
    return spark.sql(view.format(**SPARK).replace("FROM events e", "FROM {events} e"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def route_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ROUTE_POINTS.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
