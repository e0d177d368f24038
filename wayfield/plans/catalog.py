"""The registered queries, by name, with the SQL each is compared with.

All read the given tables through the adapter views. SQL is left out where it can't
say the same: the greedy placement of tracks, the iterated inverse projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, scalars
from ..operators import densify, filters, order, route, rules, sync, timeops, zones
from ..sources import adapter, sinks, text
from . import exports, outputs

SIZE, RSRP, SINR = 100.0, -90.0, 5.0
TOLERANCE = 60_000

#: Operator sharing rules (fixed values): name, conditions (MCC, MNC, frequency range), operator set.
RULES = [
    rules.Rule("share 1 with 3", ((("MCC", 231, 231), ("MNC", 3, 3), ("Frequency", 783000000, 783000000)),), {"MCC": (231,), "MNC": (1,)}),
    rules.Rule("share 2 with 6", ((("MCC", 231, 231), ("MNC", 6, 6), ("Frequency", 796000000, 796000000)),), {"MCC": (231,), "MNC": (2,)}),
    rules.Rule("share 3 with 1", ((("MCC", 231, 231), ("MNC", 1, 1), ("Frequency", 1827500000, 1827500000)),), {"MCC": (231,), "MNC": (3,)}),
    rules.Rule("share 6 with 2", ((("MCC", 231, 231), ("MNC", 2, 2), ("Frequency", 3500000000, 3500000000)),), {"MCC": (231,), "MNC": (6,)}),
    rules.Rule("band of 1", ((("Frequency", 778000000, 788000000),),), {"MCC": (231,), "MNC": (1,)}),
    rules.Rule("band of 2", ((("Frequency", 791000000, 801000000),),), {"MCC": (231,), "MNC": (2,)}),
    rules.Rule("band of 3", ((("Frequency", 1825000000, 1843000000),),), {"MCC": (231,), "MNC": (3, 6)}),
]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_M = adapter.MEASUREMENTS.format(**adapter.DUCKDB)
WITH_M = f"WITH m AS ({_M})"
_GRID = ", g AS (SELECT *, floor(x / 100) * 100.0 AS zone_x, floor(y / 100) * 100.0 AS zone_y FROM {rows})"
_STATS = """, s AS (SELECT zone_x, zone_y, mcc, mnc, frequency, pci, CAST(sum(rsrp_c) AS DOUBLE) / count(*) / 100 AS rsrp,
 CAST(sum(sinr_c) AS DOUBLE) / nullif(count(sinr_c), 0) / 100 AS sinr, count(*) AS n,
 CASE max(CASE nr WHEN 'yes' THEN 2 WHEN 'no' THEN 1 ELSE 0 END) WHEN 2 THEN 'yes' WHEN 1 THEN 'no' ELSE '' END AS nr, min(seq) AS first_seq
 FROM g GROUP BY ALL)"""
_BEST = """, b AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY zone_x, zone_y, mcc, mnc ORDER BY
 (rsrp >= -90 AND coalesce(sinr >= 5, false)) DESC, rsrp DESC, n DESC, CAST(frequency AS DOUBLE), frequency, CAST(pci AS DOUBLE), pci) AS r FROM s) WHERE r = 1)"""
WITH_B = WITH_M + _GRID.format(rows="m") + _STATS + _BEST
WITH_SPREAD = f"WITH m AS ({adapter.SPREAD.format(**adapter.DUCKDB)})" + _GRID.format(rows="m") + _STATS + _BEST
WITH_WIDE = f"WITH m AS ({adapter.WIDE.format(**adapter.DUCKDB)})" + _GRID.format(rows="m") + _STATS + _BEST
_GOOD = "(rsrp >= -90 AND coalesce(sinr >= 5, true))"


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _stats(spark: SparkSession, sf_dir: str, view: str = adapter.MEASUREMENTS) -> DataFrame:
    return zones.frequency_stats(zones.grid(filters.grouped_keys(adapter.measurements(spark, sf_dir, view)), SIZE))


def _best(spark: SparkSession, sf_dir: str, view: str = adapter.MEASUREMENTS) -> DataFrame:
    return zones.best_frequency(_stats(spark, sf_dir, view), RSRP, SINR)


@query(WITH_M + _GRID.format(rows="m") + " SELECT seq, zone_x, zone_y FROM g")
def grid_zones(spark, sf_dir):
    return zones.grid(adapter.measurements(spark, sf_dir), SIZE).select("seq", F.col("zone_x"), F.col("zone_y"))


@query(WITH_M + _GRID.format(rows="m") + _STATS + " SELECT * FROM s")
def zone_freq_agg(spark, sf_dir):
    return _stats(spark, sf_dir)


_FINE = "rsrp_c / 100.0 - (seq % 7) * 0.001"


@query(
    WITH_M + _GRID.format(rows="m") + f""", s AS (SELECT zone_x, zone_y, mcc, mnc, frequency, pci, avg(CAST({_FINE} AS DOUBLE)) AS rsrp, count(*) AS n FROM g GROUP BY ALL)
 SELECT zone_x, zone_y, mcc, mnc, frequency, pci, round(rsrp, 6) AS rsrp, n FROM s"""
)
def zone_means(spark, sf_dir):
    """Means of signals with thousandths, which are not rounded before."""
    rows = adapter.measurements(spark, sf_dir).withColumns({"rsrp_v": F.expr(_FINE).cast("double"), "sinr_v": F.lit(None).cast("double")})
    found = zones.frequency_stats(zones.grid(rows, SIZE))
    return found.select("zone_x", "zone_y", "mcc", "mnc", "frequency", "pci", F.round("rsrp", 6).alias("rsrp"), "n")


@query(WITH_B + " SELECT * FROM b")
def best_frequency(spark, sf_dir):
    return _best(spark, sf_dir)


@query(WITH_B + f" SELECT mcc, mnc, count(*) FILTER ({_GOOD}) AS good, count(*) FILTER (NOT {_GOOD}) AS bad FROM b GROUP BY mcc, mnc")
def operator_stats(spark, sf_dir):
    return zones.operator_stats(_best(spark, sf_dir), zones.good(RSRP, SINR))


@query(
    WITH_SPREAD + f" SELECT mcc, mnc, count(*) FILTER ({_GOOD}) AS good, count(*) FILTER (NOT {_GOOD}) + (SELECT count(*) FROM (SELECT DISTINCT zone_x, zone_y FROM b)) - count(*) AS bad FROM b GROUP BY mcc, mnc"
)
def operator_stats_dense(spark, sf_dir):
    best = _best(spark, sf_dir, adapter.SPREAD)
    return zones.operator_stats(best, zones.good(RSRP, SINR), total_zones=best.select("zone_x", "zone_y").distinct())


def _best_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, adapter.WIDE)


@query(
    WITH_WIDE + f" SELECT mcc, mnc, count(*) FILTER ({_GOOD}) AS good, count(*) FILTER (NOT {_GOOD}) + (SELECT count(*) FROM (SELECT DISTINCT zone_x, zone_y FROM b)) - count(*) AS bad FROM b GROUP BY mcc, mnc"
)
def operator_stats_dense_wide(spark, sf_dir):
    """All rows, in positions that leave gaps."""
    best = _best_wide(spark, sf_dir)
    return zones.operator_stats(best, zones.good(RSRP, SINR), total_zones=best.select("zone_x", "zone_y").distinct())


@query(
    WITH_B + """, c AS (SELECT count(DISTINCT (zone_x, zone_y)) AS unique_zones, count(DISTINCT (mcc, mnc)) AS unique_operators, count(*) AS zone_rows,
 min(zone_x) AS min_x, max(zone_x) AS max_x, min(zone_y) AS min_y, max(zone_y) AS max_y,
 (max(zone_x) - min(zone_x) + 100) / 100 * ((max(zone_y) - min(zone_y) + 100) / 100) AS theoretical FROM b) SELECT *, unique_zones / theoretical * 100 AS coverage_pct FROM c"""
)
def coverage_summary(spark, sf_dir):
    return zones.coverage_summary(_best(spark, sf_dir), SIZE)


@query(WITH_B + " SELECT b.zone_x, b.zone_y, b.mcc, b.mnc, b.first_seq, m.time_ms AS sample_time_ms, m.lon AS sample_lon, m.lat AS sample_lat FROM b JOIN m ON m.seq = b.first_seq")
def zone_sample_row(spark, sf_dir):
    rows = adapter.measurements(spark, sf_dir)
    return zones.sample_rows(_best(spark, sf_dir), rows, ["time_ms", "lon", "lat"]).select("zone_x", "zone_y", "mcc", "mnc", "first_seq", "sample_time_ms", "sample_lon", "sample_lat")


@query(WITH_B + " SELECT g.zone_x, g.zone_y, g.mcc, g.mnc, g.frequency, g.pci, g.seq, 'r' || CAST(g.seq AS VARCHAR) AS row_id FROM g JOIN b ON g.zone_x = b.zone_x AND g.zone_y = b.zone_y AND g.mcc = b.mcc AND g.mnc = b.mnc AND g.frequency = b.frequency AND g.pci = b.pci")
def zone_rows(spark, sf_dir):
    """The measurements behind each zone's chosen frequency."""
    rows = zones.grid(adapter.measurements(spark, sf_dir), SIZE).withColumn("row_id", F.concat(F.lit("r"), F.col("seq").cast("string")))
    return zones.members(rows, _best(spark, sf_dir))


@query(WITH_B + " SELECT zone_x, zone_y, mcc, mnc, pci, frequency, round(rsrp * 100) AS rsrp_c, round(sinr * 100) AS sinr_c, CASE WHEN nr = 'yes' THEN 'yes' ELSE 'no' END AS nr, n AS rows_in_zone, frequency AS frequencies FROM b")
def zones_export(spark, sf_dir):
    out = sinks.zones_table(_best(spark, sf_dir))
    hundredths = out.withColumns({"rsrp_c": F.round(F.col("rsrp") * 100), "sinr_c": F.round(F.col("sinr") * 100)})
    return hundredths.drop("rsrp", "sinr").orderBy(*sinks.zone_order(out))


@query(
    WITH_SPREAD + """, t AS (SELECT mcc, mnc, min(seq) AS template_seq FROM m GROUP BY mcc, mnc), z AS (SELECT DISTINCT zone_x, zone_y FROM b)
 SELECT zone_x, zone_y, mcc, mnc, template_seq, CAST(-174 AS DOUBLE) AS rsrp, 'no' AS nr, CAST(0 AS BIGINT) AS n FROM z CROSS JOIN t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.zone_x = z.zone_x AND b.zone_y = z.zone_y AND b.mcc = t.mcc AND b.mnc = t.mnc)"""
)
def empty_zones(spark, sf_dir):
    rows = adapter.measurements(spark, sf_dir, adapter.SPREAD)
    return densify.empty_zones(_best(spark, sf_dir, adapter.SPREAD), densify.operators_of(rows)).withColumn("rsrp", F.col("rsrp").cast("double"))


@query(
    WITH_WIDE + """, t AS (SELECT mcc, mnc, min(seq) AS template_seq FROM m GROUP BY mcc, mnc), z AS (SELECT DISTINCT zone_x, zone_y FROM b)
 SELECT zone_x, zone_y, mcc, mnc, template_seq, CAST(-174 AS DOUBLE) AS rsrp, 'no' AS nr, CAST(0 AS BIGINT) AS n FROM z CROSS JOIN t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.zone_x = z.zone_x AND b.zone_y = z.zone_y AND b.mcc = t.mcc AND b.mnc = t.mnc)"""
)
def empty_zones_wide(spark, sf_dir):
    rows = adapter.measurements(spark, sf_dir, adapter.WIDE)
    return densify.empty_zones(_best_wide(spark, sf_dir), densify.operators_of(rows)).withColumn("rsrp", F.col("rsrp").cast("double"))


CUSTOM = "231:03:30, 231:9 231:04:7;231:9:1"


@query(WITH_SPREAD + " SELECT zone_x, zone_y, mcc, mnc, pci, CAST(-174 AS DOUBLE) AS rsrp, 'no' AS nr FROM (SELECT DISTINCT zone_x, zone_y FROM b) CROSS JOIN (VALUES ('231', '9', ''), ('231', '04', '7')) o(mcc, mnc, pci)")
def custom_operators(spark, sf_dir):
    added = spark.createDataFrame(densify.custom_list(CUSTOM), "mcc string, mnc string, pci string")
    return densify.custom_zones(added, _best(spark, sf_dir, adapter.SPREAD)).select("zone_x", "zone_y", "mcc", "mnc", "pci", "rsrp", "nr")


@query(WITH_WIDE + " SELECT zone_x, zone_y, mcc, mnc, pci, CAST(-174 AS DOUBLE) AS rsrp, 'no' AS nr FROM (SELECT DISTINCT zone_x, zone_y FROM b) CROSS JOIN (VALUES ('231', '9', ''), ('231', '04', '7')) o(mcc, mnc, pci)")
def custom_operators_wide(spark, sf_dir):
    added = spark.createDataFrame(densify.custom_list(CUSTOM), "mcc string, mnc string, pci string")
    return densify.custom_zones(added, _best_wide(spark, sf_dir)).select("zone_x", "zone_y", "mcc", "mnc", "pci", "rsrp", "nr")


_CELLS = {
    "Latitude": "CAST(seq % 90 AS {s}) || ',5'", "Longitude": "CAST(seq % 80 AS {s}) || '.25'", "Frequency": "frequency", "PCI": "pci || '.0'", "MCC": "mcc", "MNC": "'0' || mnc", "RSRP": "CAST(rsrp_c AS {s})",
    "SINR": "coalesce(CAST(sinr_c AS {s}), '')", "5G NR": "nr", "Note": "'n;' || CAST(seq AS {s})",
}


def _zones_file_sql() -> str:
    cells = ", ".join(f'{x.format(s="VARCHAR")} AS "{c}"' for c, x in _CELLS.items())
    float_sinr = """CASE WHEN k."SINR" = '' THEN '' ELSE CAST(CAST(k."SINR" AS DOUBLE) AS VARCHAR) END"""
    made = f"""NULL AS "Latitude", NULL AS "Longitude", k."Frequency", {{pci}} AS "PCI", {{o}}.mcc AS "MCC", {{mnc}} AS "MNC", '-174' AS "RSRP", {float_sinr} AS "SINR", 'no' AS "5G NR", k."Note", NULL AS line, 0 AS piece, '' AS "Riadky_v_zone", '{{note}}' AS Frekvencie_v_zone"""
    short = "CAST(CAST(CAST({c} AS DOUBLE) AS BIGINT) AS VARCHAR)"
    return (
        WITH_SPREAD + f""", k AS (SELECT seq, {cells} FROM m), t AS (SELECT mcc, mnc, min(seq) AS seq FROM m GROUP BY mcc, mnc), z AS (SELECT DISTINCT zone_x, zone_y FROM b), l AS (SELECT zone_x, zone_y, mcc, mnc, frequency, pci, seq // {zones.PIECE} AS block, string_agg(CAST(seq + 1 AS VARCHAR), ',' ORDER BY seq) AS ids FROM g GROUP BY ALL), o(mcc, mnc, pci) AS (VALUES ('231', '9', ''), ('231', '04', '7'))
 SELECT 0 AS part, b.zone_x, b.zone_y, replace(k."Latitude", ',', '.') AS "Latitude", k."Longitude", b.frequency AS "Frequency", b.pci AS "PCI", k."MCC", {short.format(c='k."MNC"')} AS "MNC", printf('%.2f', b.rsrp) AS "RSRP",
 CASE WHEN b.sinr IS NULL THEN k."SINR" ELSE printf('%.2f', b.sinr) END AS "SINR", CASE WHEN b.nr = 'yes' THEN 'yes' ELSE 'no' END AS "5G NR", k."Note", b.first_seq AS line, l.block - b.first_seq // {zones.PIECE} AS piece, l.ids AS "Riadky_v_zone", b.frequency || ' # Meraní: ' || CAST(b.n AS VARCHAR) AS "Frekvencie_v_zone" FROM b JOIN k ON k.seq = b.first_seq JOIN l ON l.zone_x = b.zone_x AND l.zone_y = b.zone_y AND l.mcc = b.mcc AND l.mnc = b.mnc AND l.frequency = b.frequency AND l.pci = b.pci
 UNION ALL SELECT 1, zone_x, zone_y, {made.format(o="t", pci=short.format(c='k."PCI"'), mnc="t.mnc", note=outputs.EMPTY_NOTES[False])} FROM z CROSS JOIN t JOIN k ON k.seq = t.seq WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.zone_x = z.zone_x AND b.zone_y = z.zone_y AND b.mcc = t.mcc AND b.mnc = t.mnc)
 UNION ALL SELECT 2, zone_x, zone_y, {made.format(o="o", pci="o.pci", mnc=short.format(c="o.mnc"), note=outputs.ADDED_NOTES[False])} FROM z CROSS JOIN o JOIN k ON k.seq = (SELECT min(seq) FROM m)"""
    )


@query(_zones_file_sql())
def zones_file(spark, sf_dir):
    """The zones file's rows in the input's columns; where zones are made, their projected coordinates are left out of the comparison."""
    rows = adapter.measurements(spark, sf_dir, adapter.SPREAD)
    cells = rows.selectExpr("seq", *[f"{x.format(s='STRING')} AS `{c}`" for c, x in _CELLS.items()])
    best = order.checkpointed(_best(spark, sf_dir, adapter.SPREAD))
    custom = outputs.added_operators(spark, tuple(densify.custom_list(CUSTOM)))
    every = best.select("zone_x", "zone_y").distinct()
    templates = order.checkpointed(densify.operators_of(rows))
    placed = [outputs.positions(r, SIZE) for r in (best, densify.empty_zones(best, templates, every), outputs.added_rows(best, every, custom, rows))]
    lists = zones.row_lists(zones.grid(rows, SIZE).withColumn("row_id", F.col("seq") + 1))
    made = outputs.zones_file(*placed, cells, lists, outputs.layout_of(cells, {}), measured_coordinates=True, templates=templates)
    return made.withColumns({c: F.when(F.col("part") == 0, F.col(c)) for c in ("Latitude", "Longitude")})


_TEXTS = """CASE event_id % 8 WHEN 0 THEN ' 12,5 ' WHEN 1 THEN '1.5e2' WHEN 2 THEN '1d' WHEN 3 THEN '0x10' WHEN 4 THEN '' WHEN 5 THEN CAST(event_id AS {s}) || '.0' WHEN 6 THEN '-' || CAST(user_id AS {s}) || ',25' ELSE event_type END"""
_NUM = "CASE WHEN regexp_matches(replace(trim(t), ',', '.'), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(replace(trim(t), ',', '.') AS DOUBLE) END"


def _texts(spark: SparkSession, sf_dir: str, expression: str = _TEXTS) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), F.expr(expression.format(s="STRING")).alias("t"))


def _texts_sql(expression: str = _TEXTS) -> str:
    return f"WITH x AS (SELECT event_id AS seq, {expression.format(s='VARCHAR')} AS t FROM events)"


_HEADERS = "'  ' || event_type || ' [dBm] ' || CAST(user_id % 9 AS {s}) || '-É'"


@query(_texts_sql(_HEADERS) + " SELECT seq, regexp_replace(lower(trim(t)), '[^a-z0-9]', '', 'g') AS token FROM x")
def header_tokens(spark, sf_dir):
    return _texts(spark, sf_dir, _HEADERS).select("seq", scalars.header_token(F.col("t")).alias("token"))


@query(_texts_sql() + f" SELECT seq, {_NUM} AS number FROM x")
def parse_numbers(spark, sf_dir):
    return _texts(spark, sf_dir).select("seq", scalars.parse_number(F.col("t")).alias("number"))


_SHORT = "CASE WHEN n = floor(n) THEN CAST(CAST(n AS BIGINT) AS VARCHAR) WHEN n IS NOT NULL THEN CAST(n AS VARCHAR) ELSE t END"


@query(_texts_sql() + f", y AS (SELECT *, {_NUM} AS n FROM x) SELECT seq, {_SHORT} AS short FROM y")
def int_like(spark, sf_dir):
    return _texts(spark, sf_dir).select("seq", scalars.int_like(F.col("t")).alias("short"))


_CODES = "CASE event_id % 4 WHEN 0 THEN '0' || CAST(user_id % 10 AS {s}) WHEN 1 THEN CAST(user_id % 10 AS {s}) || '.0' WHEN 2 THEN ' ' || CAST(user_id % 10 AS {s}) ELSE 'x.50' || CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN '7' ELSE '.0' END END"


@query(_texts_sql(_CODES) + f", y AS (SELECT *, {_NUM} AS n FROM x) SELECT seq, CASE WHEN n IS NOT NULL THEN CAST(CAST(n AS BIGINT) AS VARCHAR) WHEN contains(t, '.') THEN rtrim(rtrim(trim(t), '0'), '.') ELSE trim(t) END AS code FROM y")
def op_keys(spark, sf_dir):
    return _texts(spark, sf_dir, _CODES).select("seq", scalars.operator_code(F.col("t")).alias("code"))


_STATES = "CASE event_id % 7 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'ÁNO' WHEN 2 THEN '0' WHEN 3 THEN 'False' WHEN 4 THEN 'unknown' WHEN 5 THEN '' ELSE NULL END"


@query(_texts_sql(_STATES) + " SELECT seq, CASE WHEN lower(trim(t)) IN ('yes','true','1','y','t','a','ano','áno') THEN 'yes' WHEN lower(trim(t)) IN ('no','false','0','n','f') THEN 'no' ELSE '' END AS nr FROM x")
def nr_normalise(spark, sf_dir):
    return _texts(spark, sf_dir, _STATES).select("seq", scalars.nr_state(F.col("t")).alias("nr"))


@query(WITH_M + " SELECT seq, CAST(CASE seq % 4 WHEN 0 THEN time_ms // 1000 * 1000 ELSE time_ms END AS BIGINT) AS ms FROM m")
def epoch_units(spark, sf_dir):
    """The same instants written as seconds, milli-, micro- and nanoseconds, read back."""
    ms = F.col("time_ms").cast("double")
    number = F.expr("case seq % 4 when 0 then cast(time_ms div 1000 as double) when 1 then cast(time_ms as double) when 2 then time_ms * 1e3 else time_ms * 1e6 end")
    rows = adapter.measurements(spark, sf_dir).filter(ms.isNotNull())
    return rows.select("seq", scalars.epoch_ms(number).alias("ms"))


_CLOCK = "CASE seq % 3 WHEN 0 THEN strftime(make_timestamp(time_ms * 1000), '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(make_timestamp(time_ms * 1000), '%-d.%-m.%Y %-H:%M:%S') ELSE strftime(make_timestamp(time_ms * 1000), '%Y-%m-%dT%H:%M') END"


@query(WITH_M + f", c AS (SELECT seq, {_CLOCK} AS t, CASE seq % 3 WHEN 2 THEN time_ms // 60000 * 60000 ELSE time_ms // 1000 * 1000 END AS wall FROM m) SELECT seq, t, CAST(epoch_ms(make_timestamp(wall * 1000) AT TIME ZONE 'Europe/Bratislava') AS BIGINT) AS ms FROM c")
def parse_times(spark, sf_dir):
    """Wall-clock texts in three forms, read as local time."""
    rows = adapter.measurements(spark, sf_dir).withColumn("ts", F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, time_ms div 1000)"))
    written = F.when(F.col("seq") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("seq") % 3 == 1, F.date_format("ts", "d.M.yyyy H:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm"))
    return rows.select("seq", written.alias("t")).withColumn("ms", scalars.datetime_ms(F.col("t")))


_SIGNAL = "CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(user_id AS {s}) || ',5' END AS rsrp, CASE WHEN event_id % 13 = 0 THEN ' ' ELSE '48.1' END AS lat, CASE WHEN event_id % 17 = 0 THEN '' ELSE '17,2' END AS lon"


_IS_NUMBER = "regexp_matches(replace(trim({c}), ',', '.'), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')"


@query(f"WITH x AS (SELECT event_id AS seq, {_SIGNAL.format(s='VARCHAR')} FROM events) SELECT seq FROM x WHERE {_IS_NUMBER.format(c='rsrp')} AND trim(lat) <> '' AND trim(lon) <> ''")
def usable_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS seq", *[f"{x.strip()}" for x in _SIGNAL.format(s="STRING").replace(", CASE", "\x00CASE").split("\x00")])
    return filters.usable(rows).select("seq")


@query(WITH_M + ", r AS (SELECT min(time_ms) AS a FROM m) SELECT seq FROM m, r WHERE NOT (time_ms BETWEEN a AND a + 3600000) AND NOT (time_ms BETWEEN a + 7200000 AND a + 10800000)")
def exclude_windows(spark, sf_dir):
    rows = adapter.measurements(spark, sf_dir)
    a = rows.agg(F.min("time_ms")).first()[0]
    return filters.exclude_windows(rows, [(a, a + 3600000), (a + 7200000, a + 10800000)]).select("seq")


@query(WITH_M + " SELECT seq FROM m WHERE seq % 10 <> 3")
def exclude_rows(spark, sf_dir):
    rows = adapter.measurements(spark, sf_dir)
    return filters.exclude_rows(rows, rows.filter("seq % 10 = 3").select("seq"), "seq").select("seq")


@query(WITH_M + " SELECT seq FROM m WHERE nr = 'yes'")
def nr_yes_only(spark, sf_dir):
    return filters.nr_yes(adapter.measurements(spark, sf_dir)).select("seq")


@query(WITH_M + " SELECT seq, CASE WHEN seq % 5 = 0 THEN 'k' || CAST(seq AS VARCHAR) ELSE CAST(row_number() OVER (ORDER BY seq) AS VARCHAR) END AS row_id FROM m")
def row_ids(spark, sf_dir):
    rows = adapter.measurements(spark, sf_dir).select("seq", F.expr("case when seq % 5 = 0 then ' k' || seq || ' ' else ' ' end").alias("old"))
    return order.row_ids(rows, "old").select("seq", "row_id")


_NULLED = "CASE WHEN seq % 7 = 0 THEN NULL ELSE time_ms END"


@query(WITH_M + f" SELECT seq, row_number() OVER (ORDER BY {_NULLED} ASC NULLS LAST, seq) - 1 AS sorted_seq FROM m")
def time_sort(spark, sf_dir):
    rows = adapter.measurements(spark, sf_dir).select("seq", F.expr(_NULLED).alias("time_ms"))
    return order.time_sort(rows).select("seq", "sorted_seq")


_WALL = "epoch_ms(make_timestamp(time_ms // 1000 * 1000000) AT TIME ZONE 'Europe/Bratislava')"


@query(
    WITH_M + f", t AS (SELECT seq % 4 AS k, CASE seq % 4 WHEN 0 THEN {_WALL} WHEN 1 THEN time_ms WHEN 2 THEN {_WALL} END AS ms FROM m) SELECT count(*) AS total, count(ms) AS timed, CAST(min(ms) AS BIGINT) AS first_ms, CAST(max(ms) AS BIGINT) AS last_ms,"
    " CASE WHEN bool_or(k = 0) AND bool_or(k IN (1, 2)) THEN 'date_time_with_utc_fallback' WHEN bool_or(k = 0) THEN 'date_time' WHEN bool_or(k = 1) AND bool_or(k = 2) THEN 'utc_mixed' WHEN bool_or(k = 1) THEN 'utc_numeric' WHEN bool_or(k = 2) THEN 'utc_datetime' ELSE 'missing' END AS strategy FROM t"
)
def time_profile(spark, sf_dir):
    """Times written in a date and a time cell, as a UTC number, as a UTC text, or not at all."""
    rows = adapter.measurements(spark, sf_dir).withColumn("ts", F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, time_ms div 1000)"))
    cell = lambda k, c: F.when(F.col("seq") % 4 == k, c).otherwise(F.lit(""))
    utc = F.when(F.col("seq") % 4 == 1, F.col("time_ms").cast("string")).when(F.col("seq") % 4 == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("")
    return timeops.profile(timeops.timed(rows.select("seq", cell(0, F.date_format("ts", "dd.MM.yyyy")).alias("d"), cell(0, F.date_format("ts", "HH:mm:ss")).alias("t"), utc.alias("u")), F.col("d"), F.col("t"), F.col("u")))


@query(
    WITH_M + """, p AS (SELECT DISTINCT mnc, frequency FROM m) SELECT 'mnc' || mnc || '_' || frequency || '.txt' AS rule, 0 AS group_id, 2 AS n_conditions, 'MNC' AS set_field, CAST(mnc AS DOUBLE) AS set_value, 'Frequency' AS field, CAST(frequency AS DOUBLE) - 100 AS low, CAST(frequency AS DOUBLE) + 100 AS high FROM p
 UNION ALL SELECT 'mnc' || mnc || '_' || frequency || '.txt', 0, 2, 'MNC', CAST(mnc AS DOUBLE), 'MCC', 231.0, 231.0 FROM p"""
)
def rules_table(spark, sf_dir):
    """Rule files written for the operators and frequencies of the measurements, read back as a table."""
    table = text.read_rules(spark, exports.rule_files(spark, sf_dir))
    rows = table.select("rule", "group_id", "n_conditions", F.explode("assignments").alias("a"), "conditions").select("*", F.explode("conditions").alias("c"))
    return rows.select("rule", "group_id", "n_conditions", F.col("a.field").alias("set_field"), F.col("a.low").alias("set_value"), "c.field", "c.low", "c.high")


def _rule_values() -> str:
    rows = []
    for r in RULES:
        for k, g in enumerate(r.groups):
            at = {f: (a, b) for f, a, b in g}
            eq = lambda f, at=at: str(at[f][0]) if f in at else "NULL"
            rows.append(f"('{r.name}', {k}, {len(g)}, {eq('MCC')}, {eq('MNC')}, {at['Frequency'][0]}, {at['Frequency'][1]})")
    return ", ".join(rows)


_RULED = WITH_M + f""", r AS (SELECT * FROM (VALUES {_rule_values()}) v(rule, g, n, mcc_eq, mnc_eq, lo, hi)),
 hit AS (SELECT m.seq, r.rule, row_number() OVER (PARTITION BY m.seq ORDER BY r.n DESC, r.rule) AS k FROM m JOIN r ON (r.mcc_eq IS NULL OR CAST(m.mcc AS DOUBLE) = r.mcc_eq)
 AND (r.mnc_eq IS NULL OR CAST(m.mnc AS DOUBLE) = r.mnc_eq) AND (CASE WHEN r.lo = r.hi THEN CAST(m.frequency AS DOUBLE) = r.lo ELSE CAST(m.frequency AS DOUBLE) >= r.lo AND CAST(m.frequency AS DOUBLE) < r.hi END)),
 ruled AS (SELECT m.*, hit.rule FROM m LEFT JOIN hit ON hit.seq = m.seq AND hit.k = 1)"""


@query(_RULED + " SELECT seq, rule FROM ruled")
def rule_match(spark, sf_dir):
    return rules.match(adapter.measurements(spark, sf_dir), RULES).select("seq", "rule")


@query(
    _RULED
    + " SELECT seq, 0 AS pos, mcc, mnc FROM ruled UNION ALL SELECT seq, v.pos, v.mcc, v.mnc FROM ruled JOIN (VALUES "
    + ", ".join(f"('{r.name}', {k}, '{int(c['MCC'])}', '{int(c['MNC'])}')" for r in RULES for k, c in enumerate(r.combinations(), 1))
    + ") v(rule, pos, mcc, mnc) ON v.rule = ruled.rule"
)
def rule_expand(spark, sf_dir):
    rows = rules.match(adapter.measurements(spark, sf_dir), RULES)
    return rules.expand(rows, RULES, keep_original=True).select("seq", "pos", "mcc", "mnc")


#: More rules than are compiled: one for each frequency, operator and PCI, and bands without an exact value.
MANY = [
    *(rules.Rule(f"cell {f} {m} {p}", ((("Frequency", f, f), ("MNC", m, m), ("PCI", p, p)),), {"MNC": (m + 10,)}) for f in (783000000, 796000000, 1827500000, 3500000000) for m in (1, 2, 3, 6) for p in range(0, 7, 2)),
    *(rules.Rule(f"band {k}", ((("Frequency", 700000000 + k * 50000000, 750000000 + k * 50000000),),), {"MNC": (k,)}) for k in range(60) if k % 3),
    rules.Rule("a pair", ((("Frequency", 2140000000, 2140000000), ("MNC", 2, 2)), (("PCI", 5, 5),)), {"MNC": (99,)}),
]


def _many_values() -> str:
    rows = []
    for r in MANY:
        for g in r.groups:
            at = {f: (float(a), float(b)) for f, a, b in g}
            rows.append("(" + ", ".join([f"'{r.name}'", str(len(g)), *(str(at[f][i]) if f in at else "NULL" for f in ("Frequency", "MNC", "PCI") for i in (0, 1))]) + ")")
    return ", ".join(rows)


_BETWEEN = "(r.{f}0 IS NULL OR CASE WHEN r.{f}0 = r.{f}1 THEN CAST(m.{c} AS DOUBLE) = r.{f}0 ELSE CAST(m.{c} AS DOUBLE) >= r.{f}0 AND CAST(m.{c} AS DOUBLE) < r.{f}1 END)"


@query(
    WITH_M + f", r AS (SELECT * FROM (VALUES {_many_values()}) v(rule, n, f0, f1, m0, m1, p0, p1)), k AS (SELECT DISTINCT frequency, mnc, pci FROM m), hit AS (SELECT m.*, r.rule, row_number() OVER (PARTITION BY m.frequency, m.mnc, m.pci ORDER BY r.n DESC, r.rule) AS place FROM k m JOIN r ON "
    + " AND ".join(_BETWEEN.format(f=f, c=c) for f, c in (("f", "frequency"), ("m", "mnc"), ("p", "pci")))
    + ") SELECT m.seq, hit.rule FROM m LEFT JOIN hit ON hit.frequency = m.frequency AND hit.mnc = m.mnc AND hit.pci = m.pci AND hit.place = 1"
)
def rule_match_many(spark, sf_dir):
    return rules.match(adapter.measurements(spark, sf_dir), MANY).select("seq", "rule")


_SYNC = """, p AS (SELECT * FROM m WHERE nr <> ''), q AS (SELECT seq, source_idx, time_ms, {mcc} AS mcc, mnc FROM m WHERE nr = ''),
 j AS (SELECT q.seq, count(*) FILTER (p.nr = 'yes') AS yes_n, count(*) FILTER (p.nr = 'no') AS no_n FROM q JOIN p ON ({on}) AND p.time_ms BETWEEN q.time_ms - 60000 AND q.time_ms + 60000 GROUP BY q.seq),
 y AS (SELECT q.seq, q.source_idx, q.time_ms, CASE WHEN coalesce(yes_n, 0) > 0 THEN 'yes' ELSE 'no' END AS nr, coalesce(yes_n, 0) AS yes_n, coalesce(no_n, 0) AS no_n, q.mcc = '' AS fallback FROM q LEFT JOIN j USING (seq))"""
_SYNC_ON = "p.mcc = q.mcc AND p.mnc = q.mnc"
_SYNCED = WITH_M + _SYNC.format(mcc="mcc", on=_SYNC_ON)
_FALLEN = WITH_M + _SYNC.format(mcc="CASE WHEN seq % 3 = 0 THEN '' ELSE mcc END", on=f"q.mcc = '' OR ({_SYNC_ON})")


def _synced(spark: SparkSession, sf_dir: str, drop: bool = False) -> DataFrame:
    rows = adapter.measurements(spark, sf_dir)
    own = rows.filter("nr = ''")
    if drop:
        own = own.withColumn("mcc", F.expr("case when seq % 3 = 0 then '' else mcc end"))
    return sync.sync(own, rows.filter("nr <> ''"), TOLERANCE)


@query(_SYNCED + " SELECT seq, nr, yes_n, no_n FROM y")
def nr_sync(spark, sf_dir):
    return _synced(spark, sf_dir).select("seq", "nr", "yes_n", "no_n")


@query(_FALLEN + " SELECT seq, nr, yes_n, no_n, fallback FROM y")
def nr_sync_fallback(spark, sf_dir):
    return _synced(spark, sf_dir, drop=True).select("seq", "nr", "yes_n", "no_n", "fallback")


@query(
    _FALLEN + " SELECT count(*) AS total, count(*) FILTER (nr = 'yes') AS yes, count(*) FILTER (nr = 'no') AS \"no\", count(*) FILTER (yes_n + no_n > 0) AS matched, count(*) FILTER (yes_n > 0 AND no_n > 0) AS conflicts, count(*) FILTER (fallback AND yes_n + no_n > 0) AS fallback_rows FROM y"
)
def nr_sync_stats(spark, sf_dir):
    return sync.sync_stats(_synced(spark, sf_dir, drop=True))


@query(_SYNCED + " SELECT source_idx, count(*) AS \"rows\", count(time_ms) AS timed, count(*) FILTER (yes_n + no_n > 0) AS matched FROM y GROUP BY source_idx")
def sync_source_check(spark, sf_dir):
    return sync.source_check(_synced(spark, sf_dir))


@query(WITH_M + " SELECT source_idx, count(*) AS \"rows\", count(*) FILTER (nr <> '') AS usable, count(*) FILTER (nr = 'yes') AS yes FROM m GROUP BY source_idx")
def lte_source_check(spark, sf_dir):
    return sync.state_check(adapter.measurements(spark, sf_dir))


_FILE = "CAST(source_idx AS BIGINT) * 100000 + seq // 5000"


@query(
    WITH_M + """ SELECT mcc, mnc, pci, frequency, CAST(rsrp_c AS VARCHAR) AS rsrp, CASE WHEN source_idx = 1 THEN coalesce(CAST(sinr_c AS VARCHAR), '') ELSE '' END AS sinr, CASE WHEN source_idx = 2 THEN 'r;"' || CAST(seq AS VARCHAR) || '"' ELSE '' END AS note, count(*) AS n FROM m GROUP BY ALL"""
)
def union_by_name(spark, sf_dir):
    """Measurements written as exports of three layouts, read back and united by name."""
    table = text.read(spark, exports.written(spark, sf_dir))
    return table.groupBy(F.col("MCC").alias("mcc"), F.col("MNC").alias("mnc"), F.col("PCI").alias("pci"), F.col("Frequency").alias("frequency"), F.col("RSRP").alias("rsrp"), F.col("SINR").alias("sinr"), F.col("note")).agg(F.count("*").alias("n"))


@query(WITH_M + " SELECT mcc, mnc, count(*) AS n, sum(rsrp_c) AS total FROM m GROUP BY mcc, mnc")
def ss_rsrp_union(spark, sf_dir):
    """Files in which the signal is called RSRP, rsrp and SS-RSRP, united."""
    rows = text.typed(text.read(spark, exports.written(spark, sf_dir, rsrp="SS-RSRP")))
    return rows.groupBy("mcc", "mnc").agg(F.count("*").alias("n"), F.sum(scalars.parse_number(F.col("rsrp")).cast("bigint")).alias("total"))


@query(WITH_M + " SELECT mcc, '0' || mnc AS mnc, nr, count(*) AS n, count(time_ms) AS timed, CAST(max(time_ms) AS BIGINT) AS last_ms FROM m GROUP BY mcc, mnc, nr")
def states_union(spark, sf_dir):
    """Files of states that call the state 5G NR, NR and 5GNR, united row by row."""
    rows = text.typed(text.read_states(spark, exports.states(spark, sf_dir)), {"nr": text.NR})
    return rows.groupBy("mcc", "mnc", "nr").agg(F.count("*").alias("n"), F.count("time_ms").alias("timed"), F.max("time_ms").alias("last_ms"))


_STATE_RULE = rules.Rule("states of 3 are of 1", ((("MCC", 231, 231), ("MNC", 3, 3)),), {"MNC": (1,)})


@query(
    WITH_M + """, p AS (SELECT CASE WHEN mnc = '3' THEN '1' ELSE mnc END AS mnc, mcc, time_ms, nr FROM m WHERE nr <> ''), q AS (SELECT * FROM m WHERE nr = ''),
 j AS (SELECT q.seq, count(*) FILTER (p.nr = 'yes') AS yes_n, count(*) FILTER (p.nr = 'no') AS no_n FROM q JOIN p ON p.mcc = q.mcc AND p.mnc = q.mnc AND p.time_ms BETWEEN q.time_ms - 60000 AND q.time_ms + 60000 GROUP BY q.seq)
 SELECT q.seq, CASE WHEN coalesce(yes_n, 0) > 0 THEN 'yes' ELSE 'no' END AS nr, coalesce(yes_n, 0) AS yes_n, coalesce(no_n, 0) AS no_n FROM q LEFT JOIN j USING (seq)"""
)
def nr_sync_ruled(spark, sf_dir):
    """States from files, rewritten by a rule before the sync."""
    table = text.read_states(spark, exports.states(spark, sf_dir))
    states = text.typed(rules.expand(rules.match(table, [_STATE_RULE]), [_STATE_RULE]), {"nr": text.NR})
    own = adapter.measurements(spark, sf_dir).filter("nr = ''")
    return sync.sync(own, states, TOLERANCE).select("seq", "nr", "yes_n", "no_n")


@query(WITH_M + f", f AS (SELECT DISTINCT source_idx, {_FILE} AS file FROM m) SELECT source_idx AS layout, 'utf-8' AS encoding, CAST(CASE source_idx WHEN 2 THEN 2 ELSE 0 END AS BIGINT) AS header_line, CASE source_idx WHEN 2 THEN '5g' ELSE 'unknown' END AS technology, count(*) AS files FROM f GROUP BY source_idx")
def preview_schema(spark, sf_dir):
    seen = text.preview(spark, exports.written(spark, sf_dir))
    layout = F.when(F.array_contains("columns", "SINR"), 1).when(F.array_contains("columns", "note"), 2).otherwise(0)
    return seen.groupBy(layout.alias("layout"), "encoding", "header_line", "technology").agg(F.count("*").alias("files"))


@query(WITH_M + f", f AS (SELECT source_idx, {_FILE} AS file, count(*) AS n FROM m GROUP BY ALL) SELECT source_idx = 0 AS latin1, CAST(CASE source_idx WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN n >= 2 THEN 31 ELSE 0 END ELSE 2 END AS BIGINT) AS header_line, CASE WHEN source_idx = 1 AND n < 2 THEN 9 ELSE 7 END AS width, CASE source_idx WHEN 0 THEN 'namérené' WHEN 1 THEN CASE WHEN n >= 2 THEN 'h1' ELSE 'r' END ELSE 'only' END AS first_cell, count(*) AS files FROM f GROUP BY ALL")
def header_by_width(spark, sf_dir):
    """Headers told by their width in files of two encodings."""
    seen = text.file_meta(text.blocks_of(spark, exports.unnamed(spark, sf_dir)))
    return seen.groupBy((~F.col("utf8")).alias("latin1"), "header_line", "width", F.split("header", ";")[0].alias("first_cell")).agg(F.count("*").alias("files"))


@query(WITH_M + f", f AS (SELECT DISTINCT source_idx, {_FILE} AS file FROM m) SELECT field, CASE source_idx WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS own_name, a AS common, count(*) AS files FROM f CROSS JOIN (VALUES ('latitude', 'Latitude', 'Lat', 'latitude'), ('longitude', 'Longitude', 'Lng', 'longitude'), ('frequency', 'Frequency', 'freq', 'NR-ARFCN'), ('rsrp', 'RSRP', 'rsrp', 'SSS-RSRP')) v(field, a, b, c) GROUP BY ALL")
def alias_union(spark, sf_dir):
    """The name each file uses for a field, and the one it has in the union."""
    table, meta = text.files(spark, exports.written(spark, sf_dir))
    names = text.canonical(meta)
    rows = [(k, f, c, names[m.path][c]) for k, m in enumerate(meta) for f in ("latitude", "longitude", "frequency", "rsrp") for c in m.columns if text.token(c) in text.FIELDS[f]]
    found = spark.createDataFrame(rows, "layout_no int, field string, own_name string, common string")
    return table.join(F.broadcast(found), "layout_no").groupBy("field", "own_name", "common").agg(F.count("*").alias("files"))


@query(WITH_M + f" SELECT source_idx AS layout, count(DISTINCT {_FILE}) AS files, 'rsrp' AS token FROM m WHERE source_idx = 1 GROUP BY source_idx")
def header_ambiguity(spark, sf_dir):
    """Files in which two columns mean the same by their letters; the second layout is written with one more RSRP column."""
    table, meta = text.files(spark, exports.written(spark, sf_dir, twice=True))
    number = {m.path: k for k, m in enumerate(meta)}
    found = spark.createDataFrame([(number[p], t) for p, t in text.ambiguous(meta)], "layout_no int, token string")
    return table.join(F.broadcast(found), "layout_no").groupBy(F.lit(1).alias("layout"), "token").agg(F.count("*").alias("files"))


@query(WITH_M + f" SELECT 'pci' AS field, count(DISTINCT {_FILE}) AS files FROM m WHERE source_idx = 0")
def required_columns(spark, sf_dir):
    """Files without a required field; the first layout is written without PCI."""
    table, meta = text.files(spark, exports.written(spark, sf_dir, without_pci=True))
    number = {m.path: k for k, m in enumerate(meta)}
    found = spark.createDataFrame([(number[p], f) for p, f in text.missing_fields(meta)], "layout_no int, field string")
    return table.join(F.broadcast(found), "layout_no").groupBy("field").agg(F.count("*").alias("files"))


_CUM = f"""WITH rp AS ({adapter.ROUTE_POINTS}), st AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM rp WINDOW w AS (PARTITION BY source_idx ORDER BY seq)),
 cu AS (SELECT *, sum(coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0.0)) OVER (PARTITION BY source_idx ORDER BY seq) AS cum FROM st),
 c AS (SELECT *, lag(cum) OVER (PARTITION BY source_idx ORDER BY seq) AS pcum FROM cu)"""


def _cum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.cumulative(adapter.route_points(spark, sf_dir), chunk=500)


@query(_CUM + " SELECT source_idx, seq, cum FROM c")
def cum_distance(spark, sf_dir):
    return _cum(spark, sf_dir).select("source_idx", "seq", "cum")


@query(_CUM + " SELECT source_idx, count(*) AS points, max(cum) AS length FROM c GROUP BY source_idx")
def track_lengths(spark, sf_dir):
    return route.tracks(_cum(spark, sf_dir)).select("source_idx", "points", "length")


@query(_CUM + " SELECT source_idx, seq, CAST(floor((cum + 1e-9) / 100) AS BIGINT) AS segment_id FROM c")
def segment_ids(spark, sf_dir):
    return route.single(_cum(spark, sf_dir)).select("source_idx", "seq", route.segment_id(F.col("distance"), SIZE).alias("segment_id"))


_CROSS = """ k AS (SELECT *, CAST(floor((least(pcum, cum) + 1e-9) / 100) AS BIGINT) + 1 AS lo, CAST(floor((greatest(pcum, cum) + 1e-9) / 100) AS BIGINT) AS hi FROM {rows} WHERE pcum IS NOT NULL),
 e AS (SELECT *, unnest(generate_series(lo, hi)) AS segment_id FROM k WHERE lo <= hi),
 h AS (SELECT *, least(1.0, greatest(0.0, (segment_id * 100 - pcum) / (cum - pcum))) AS f FROM e)"""


@query(
    _CUM + "," + _CROSS.format(rows="c") + """, u AS (SELECT segment_id, 0 AS p, source_idx, seq, px + (x - px) * f AS sx, py + (y - py) * f AS sy FROM h UNION ALL
 SELECT CAST(floor((cum + 1e-9) / 100) AS BIGINT), 1, source_idx, seq, x, y FROM c) SELECT segment_id, sx AS x, sy AS y FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY p, source_idx, seq) AS r FROM u) WHERE r = 1"""
)
def segment_starts(spark, sf_dir):
    return route.segment_starts(route.single(_cum(spark, sf_dir)), SIZE).select("segment_id", "x", "y")


#: Segment length and stretches (metres) taken out of the route in the gap query.
GAP_SIZE = 20.0
_HOLES = " AND ".join(f"(distance < {a} OR distance > {a + 70})" for a in (60, 1700))


@query(
    _CUM + f""", d AS (SELECT *, CAST(NULL AS DOUBLE) AS nothing FROM c WHERE {_HOLES.replace('distance', 'cum')}), v AS (SELECT DISTINCT cum, x, y FROM d),
 l AS (SELECT cum, x, y, lag(cum) OVER o AS pcum, lag(x) OVER o AS px, lag(y) OVER o AS py FROM v WINDOW o AS (ORDER BY cum, x, y)),""" + _CROSS.format(rows="l").replace("100", "20") + f""",
 own AS (SELECT DISTINCT CAST(floor((cum + 1e-9) / 20) AS BIGINT) AS s FROM d),
 kc AS (SELECT CAST(floor((least(pcum, cum) + 1e-9) / 20) AS BIGINT) + 1 AS lo, CAST(floor((greatest(pcum, cum) + 1e-9) / 20) AS BIGINT) AS hi FROM d WHERE pcum IS NOT NULL),
 inner_ids AS (SELECT DISTINCT unnest(generate_series(lo, hi)) AS s FROM kc WHERE lo <= hi)
 SELECT segment_id, px + (x - px) * f AS x, py + (y - py) * f AS y FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY cum, x, y) AS r FROM h) WHERE r = 1 AND segment_id NOT IN (SELECT s FROM own) AND segment_id NOT IN (SELECT s FROM inner_ids)"""
)
def gap_segments(spark, sf_dir):
    """Two stretches are taken out of the route; their segments are found again between their ends."""
    kept = route.single(_cum(spark, sf_dir)).filter(_HOLES)
    return route.gap_segments(kept, GAP_SIZE, strip=1000.0).select("segment_id", "x", "y")


_SAMPLED = _CUM + f""", t AS (SELECT source_idx, count(*) AS n, least(count(*), {route.SAMPLES}) AS m, max(cum) AS len, max(seq) AS last FROM c GROUP BY source_idx),
 pre AS (SELECT c.*, m, len, last, lag(seq) OVER (PARTITION BY c.source_idx ORDER BY seq) AS pseq FROM c JOIN t USING (source_idx)),
 g AS (SELECT source_idx, m, len, unnest(generate_series(0, m - 1)) AS k FROM t),
 hits AS (SELECT g.source_idx, g.k, g.len * g.k / (g.m - 1) AS target, pre.* EXCLUDE (source_idx, m, len) FROM g JOIN pre ON pre.source_idx = g.source_idx AND pre.cum >= g.len * g.k / (g.m - 1) AND (pre.pcum IS NULL OR pre.pcum < g.len * g.k / (g.m - 1))),
 pick AS (SELECT source_idx, k, CASE WHEN pcum IS NOT NULL AND abs(pcum - target) < abs(cum - target) THEN px ELSE x END AS x, CASE WHEN pcum IS NOT NULL AND abs(pcum - target) < abs(cum - target) THEN py ELSE y END AS y,
 CASE WHEN pcum IS NOT NULL AND abs(pcum - target) < abs(cum - target) THEN pcum ELSE cum END AS cum FROM hits UNION ALL SELECT source_idx, m, x, y, cum FROM pre WHERE seq = last),
 ld AS (SELECT *, lag(cum) OVER (PARTITION BY source_idx ORDER BY k) AS pc, lag(x) OVER (PARTITION BY source_idx ORDER BY k) AS lx, lag(y) OVER (PARTITION BY source_idx ORDER BY k) AS ly FROM pick),
 sm AS (SELECT source_idx, k, x, y, cum FROM ld WHERE pc IS NULL OR NOT (abs(cum - pc) <= 1e-6 AND sqrt((x - lx) * (x - lx) + (y - ly) * (y - ly)) <= 1e-6))"""
_PAIRED = _SAMPLED + """, pr AS (SELECT a.source_idx AS known, b.source_idx AS unknown, a.k AS known_k, b.k AS unknown_k, a.cum AS known_cum, b.cum AS unknown_cum FROM sm a JOIN sm b ON a.source_idx <> b.source_idx AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 75)"""


@query(_SAMPLED + " SELECT source_idx, k, x, y, cum FROM sm")
def track_samples(spark, sf_dir):
    return route.samples(_cum(spark, sf_dir)).select("source_idx", "k", "x", "y", "cum")


@query(_PAIRED + " SELECT known, unknown, known_k, unknown_k FROM pr")
def track_proximity(spark, sf_dir):
    return route.proximity(route.samples(_cum(spark, sf_dir))).select("known", "unknown", "known_k", "unknown_k")


_ALIGNED = _PAIRED + """, dl AS (SELECT known, unknown, known_k, unknown_k, r.reversed, known_cum - CASE WHEN r.reversed THEN t.len - unknown_cum ELSE unknown_cum END AS delta FROM pr JOIN t ON t.source_idx = pr.unknown CROSS JOIN (VALUES (false), (true)) r(reversed)),
 md AS (SELECT known, unknown, reversed, quantile_cont(delta, 0.5) AS "offset", count(*) AS n, count(DISTINCT known_k) AS a, count(DISTINCT unknown_k) AS b FROM dl GROUP BY ALL),
 ma AS (SELECT dl.known, dl.unknown, dl.reversed, quantile_cont(abs(delta - md."offset"), 0.5) AS mad FROM dl JOIN md ON md.known = dl.known AND md.unknown = dl.unknown AND md.reversed = dl.reversed GROUP BY ALL)"""


@query(
    _ALIGNED + """ SELECT md.known, md.unknown, md.reversed, round(md."offset", 6) AS "offset", md.n, round(ma.mad, 6) AS mad FROM md JOIN ma ON md.known = ma.known AND md.unknown = ma.unknown AND md.reversed = ma.reversed WHERE a >= 2 AND b >= 2 AND mad <= 75"""
)
def track_alignment(spark, sf_dir):
    # Both are read several times below, so written once.
    cum = order.checkpointed(_cum(spark, sf_dir))
    points = order.checkpointed(route.samples(cum))
    return route.alignment(route.proximity(points), route.tracks(cum), points).select("known", "unknown", "reversed", F.round("offset", 6).alias("offset"), "n", F.round("mad", 6).alias("mad"))


def _offers(no: int, placed: str) -> str:
    """The best offer for the track that is laid down as number ``no``, from those in ``placed``."""
    return f"""(SELECT s, turned, start FROM (SELECT r.s, al.n, al.mad, al.known, al.reversed <> p.turned AS turned, p.start + CASE WHEN p.turned THEN k.len - u.len - al."offset" ELSE al."offset" END AS start
 FROM rest r JOIN al ON al.unknown = r.s JOIN {placed} p ON p.s = al.known JOIN t k ON k.source_idx = al.known JOIN t u ON u.source_idx = r.s WHERE r.i = {no}) ORDER BY n DESC, mad, known, turned, start LIMIT 1)"""


#: Three tracks: the longest is laid down, the others in turn by their best offer, and one that has none by the nearest ends.
_PLACED = (
    _ALIGNED + """, al AS (SELECT md.known, md.unknown, md.reversed, md."offset", md.n, ma.mad FROM md JOIN ma ON md.known = ma.known AND md.unknown = ma.unknown AND md.reversed = ma.reversed WHERE a >= 2 AND b >= 2 AND mad <= 75),
 p0 AS (SELECT source_idx AS s, false AS turned, CAST(0 AS DOUBLE) AS start FROM t ORDER BY len DESC, source_idx LIMIT 1), rest AS (SELECT source_idx AS s, row_number() OVER (ORDER BY source_idx) AS i FROM t WHERE source_idx NOT IN (SELECT s FROM p0)),
 p1 AS (SELECT * FROM p0 UNION ALL """ + _offers(1, "p0") + "), p2 AS (SELECT * FROM p1 UNION ALL " + _offers(2, "p1") + """),
 fe AS (SELECT source_idx, max(cum) AS len, arg_min(x, seq) AS fx, arg_min(y, seq) AS fy, arg_max(x, seq) AS lx, arg_max(y, seq) AS ly FROM c GROUP BY source_idx),
 two AS (SELECT fe.*, turned, CASE WHEN turned THEN lx ELSE fx END AS low_x, CASE WHEN turned THEN ly ELSE fy END AS low_y, CASE WHEN turned THEN fx ELSE lx END AS high_x, CASE WHEN turned THEN fy ELSE ly END AS high_y FROM fe CROSS JOIN (VALUES (false), (true)) v(turned)),
 fit AS (SELECT u.source_idx AS s, u.turned, k.source_idx AS known, side, k.turned AS known_turned, p2.start, k.len, u.len AS own_len,
  CASE side WHEN 0 THEN sqrt((k.low_x - u.high_x) * (k.low_x - u.high_x) + (k.low_y - u.high_y) * (k.low_y - u.high_y)) ELSE sqrt((k.high_x - u.low_x) * (k.high_x - u.low_x) + (k.high_y - u.low_y) * (k.high_y - u.low_y)) END AS gap
  FROM two u JOIN p2 ON true JOIN two k ON k.source_idx = p2.s AND k.turned = p2.turned CROSS JOIN (VALUES (0), (1)) w(side) WHERE u.source_idx NOT IN (SELECT s FROM p2)),
 p3 AS (SELECT * FROM p2 UNION ALL (SELECT s, turned, CASE side WHEN 0 THEN start - own_len - gap ELSE start + len + gap END FROM fit ORDER BY gap, known, turned, side LIMIT 1)),
 on_route AS (SELECT c.source_idx, c.seq, CASE WHEN p3.turned THEN t.len - c.cum ELSE c.cum END + p3.start - (SELECT min(start) FROM p3) AS distance FROM c JOIN t ON t.source_idx = c.source_idx JOIN p3 ON p3.s = c.source_idx)"""
)


@query(_PLACED + " SELECT source_idx, seq, round(distance, 6) AS distance, CAST(floor((distance + 1e-9) / 100) AS BIGINT) AS segment_id FROM on_route")
def track_placement(spark, sf_dir):
    return route.common_route(adapter.route_points(spark, sf_dir), SIZE).select("source_idx", "seq", F.round("distance", 6).alias("distance"), "segment_id")


# Names that the route queries had while they took fewer samples than a run does.
for _name in ("track_samples", "track_proximity", "track_alignment"):
    QUERIES[f"{_name}_full"], ORACLES[f"{_name}_full"] = QUERIES[_name], ORACLES[_name]


def _reproject_sql() -> str:
    """The projection's steps as nested SQL."""
    g, b, c, (tx, ty, tz) = geo.GLOBE, geo.LOCAL, geo.CONE, geo.SHIFT_M
    turn = [" + ".join(f"({float(v)!r}) * {a}" for v, a in zip(row, ("gx", "gy", "gz"), strict=True)) for row in geo.TURN_BACK]
    second, e, q = (b.a**2 - b.b**2) / b.b**2, b.e, geo.QUARTER
    refine = [{"n": f"{b.a!r} / sqrt(1 - {b.e2!r} * pow(sin(f), 2))"}, {"h": "p / cos(f) - n"}, {"f": f"atan2(z, p * (1 - {b.e2!r} * (n / (n + h))))"}]
    steps = [
        {"l": "radians(lon)", "f": "radians(lat)"},
        {"n": f"{g.a!r} / sqrt(1 - {g.e2!r} * pow(sin(f), 2))"},
        {"gx": f"n * cos(f) * cos(l) - {tx}", "gy": f"n * cos(f) * sin(l) - {ty}", "gz": f"n * (1 - {g.e2!r}) * sin(f) - {tz}"},
        dict(zip("xyz", turn, strict=True)),
        {"p": "sqrt(x * x + y * y)", "l": "atan2(y, x)"},
        {"t": f"atan2(z * {b.a!r}, p * {b.b!r})"},
        {"f": f"atan2(z + {second * b.b!r} * pow(sin(t), 3), p - {b.e2 * b.a!r} * pow(cos(t), 3))"},
        *refine * 3,
        {"gf": f"pow((1 + {e!r} * sin(f)) / (1 - {e!r} * sin(f)), {c['alpha'] * e / 2!r})"},
        {"u": f"2 * (atan({c['k']!r} * pow(tan(f / 2 + {q!r}), {c['alpha']!r}) / gf) - {q!r})", "v": f"(radians({geo.CENTRE_LON!r}) - l) * {c['alpha']!r}"},
        {"s": f"asin(least(1.0, greatest(-1.0, cos({c['tilt']!r}) * sin(u) + sin({c['tilt']!r}) * cos(u) * cos(v))))"},
        {"d": f"{c['n']!r} * asin(least(1.0, greatest(-1.0, cos(u) * sin(v) / cos(s))))"},
        {"r": f"{c['rho0']!r} * pow(tan({c['s0'] / 2!r} + {q!r}), {c['n']!r}) / pow(tan(s / 2 + {q!r}), {c['n']!r})"},
    ]
    sql, known = "SELECT seq, lon, lat FROM m", {"seq": "", "lon": "", "lat": ""}
    for step in steps:
        kept = [k for k in known if k not in step]
        known |= step
        sql = f"SELECT {', '.join(kept)}, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM ({sql})"
    return f"{WITH_M} SELECT seq, round(-r * sin(d), 3) AS x, round(-r * cos(d), 3) AS y FROM ({sql})"


@query(_reproject_sql())
def reproject(spark, sf_dir):
    rows = geo.reproject(adapter.measurements(spark, sf_dir).select("seq", "lon", "lat"))
    return rows.select("seq", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query()
def zone_centres(spark, sf_dir):
    """Centres of the distinct zones of projected measurements, in degrees."""
    projected = geo.reproject(adapter.measurements(spark, sf_dir).select("seq", "lon", "lat"))
    found = zones.grid(projected, SIZE).select("zone_x", "zone_y").distinct()
    x, y = zones.zone_centre(SIZE)
    return found.withColumn("c", geo.unproject(x, y)).select("zone_x", "zone_y", F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"))


@query(WITH_M + ", z AS (SELECT seq, CAST(-600000 + (seq % 4000) * 100 AS DOUBLE) AS zone_x, CAST(-1350000 + (seq * 7 % 2500) * 100 AS DOUBLE) AS zone_y FROM m) SELECT zone_x, zone_y, zone_x + 50 AS x, zone_y + 50 AS y FROM z GROUP BY ALL")
def zone_centres_forward(spark, sf_dir):
    """Centres of zones projected back to degrees, and those projected again: the centres, to the millimetre."""
    grid = adapter.measurements(spark, sf_dir).selectExpr("CAST(-600000 + (seq % 4000) * 100 AS DOUBLE) AS zone_x", "CAST(-1350000 + (seq * 7 % 2500) * 100 AS DOUBLE) AS zone_y").distinct()
    placed = zones.with_positions(grid, SIZE)
    again = geo.reproject(placed)
    return again.select("zone_x", "zone_y", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))
