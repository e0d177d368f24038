"""Zones, their statistics, the best frequency of each, and operators' counts.

``campaign`` columns: every function takes ``by``, columns that separate measurement
campaigns. They join the grouping and partitioning keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import unproject
from ..functions.scalars import nr_of_score, nr_score, number_text, numeric_then_text, parse_number

OPERATOR = ("mcc", "mnc")
#: Rows, by their numbers, whose ids make one piece of a list.
PIECE = 65_536


def grid(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """``df`` with zone_x and zone_y, the lower left corner of its square."""
    return df.withColumns({"zone_x": F.floor(F.col(x) / size) * F.lit(float(size)), "zone_y": F.floor(F.col(y) / size) * F.lit(float(size))})


def zone_columns(df: DataFrame) -> list[str]:
    return ["segment_id"] if "segment_id" in df.columns else ["zone_x", "zone_y"]


def frequency_stats(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means and counts for each zone, operator, frequency and PCI.

    Signal is rsrp_v and sinr_v as measured, or rsrp_c and sinr_c in whole hundredths
    where a view has those; it isn't rounded before the mean. sinr is null where no row
    has one. first_seq is the first row of the group, whose rows ``members`` lists.
    """
    keys = [*by, *zone_columns(df), *OPERATOR, "frequency", "pci"]
    if "rsrp_v" in df.columns:
        means = [F.avg("rsrp_v").alias("rsrp"), F.avg("sinr_v").alias("sinr")]
    else:
        means = [(F.sum("rsrp_c").cast("double") / F.count("*") / 100).alias("rsrp"), (F.sum("sinr_c").cast("double") / F.nullif(F.count("sinr_c"), F.lit(0)) / 100).alias("sinr")]
    out = [
        *means,
        F.count("*").alias("n"),
        nr_of_score(F.max(nr_score(F.col("nr")))).alias("nr"),
        F.min("seq").alias("first_seq"),
    ]
    return df.groupBy(*keys).agg(*out)


def members(df: DataFrame, chosen: DataFrame, row_id: str = "row_id", by: tuple[str, ...] = ()) -> DataFrame:
    """The original rows of each chosen group, one line each: group keys, seq and row id.

    A table instead of a list in one cell, since a group may hold a large part of all rows.
    """
    keys = [*by, *zone_columns(df), *OPERATOR, "frequency", "pci"]
    return df.select(*keys, "seq", row_id).join(chosen.select(*keys), keys, "left_semi")


def row_lists(df: DataFrame, row_id: str = "row_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Ids of each group's rows in order, as comma-separated ``ids`` in pieces.

    A piece holds the rows of PIECE successive row numbers, so none is longer than that,
    whatever the group's size, and the rows of a large group are dealt by piece too.
    Rows without an id are left out; ``piece`` grows with the rows' place.
    """
    keys = [*by, *zone_columns(df), *OPERATOR, "frequency", "pci"]
    ids = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(row_id).cast("string").alias("id")))), lambda r: r["id"])
    return df.groupBy(*keys, F.floor(F.col("seq") / PIECE).alias("piece")).agg(F.array_join(ids, ",").alias("ids"))


def qualified(rsrp_threshold: float, sinr_threshold: float) -> Column:
    """Both thresholds met; a group without SINR never qualifies."""
    return (F.col("rsrp") >= rsrp_threshold) & F.coalesce(F.col("sinr") >= sinr_threshold, F.lit(False))


def good(rsrp_threshold: float, sinr_threshold: float, mobile: bool = False) -> Column:
    """Coverage is good: signal, SINR where there is one, and 5G in mobile runs."""
    met = (F.col("rsrp") >= rsrp_threshold) & F.coalesce(F.col("sinr") >= sinr_threshold, F.lit(True))
    return met & (F.col("nr") == "yes") if mobile else met


def best_frequency(stats: DataFrame, rsrp_threshold: float, sinr_threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """One frequency and PCI for each zone and operator.

    Qualifying groups come first; then the strongest signal, more rows, the lower
    frequency and the lower PCI (numbers before texts).
    """
    order = [
        qualified(rsrp_threshold, sinr_threshold).desc(), F.desc("rsrp"), F.desc("n"),
        parse_number(F.col("frequency")).asc_nulls_last(), F.asc("frequency"),
        parse_number(F.col("pci")).asc_nulls_last(), F.asc("pci"),
    ]
    rank = F.row_number().over(Window.partitionBy(*by, *zone_columns(stats), *OPERATOR).orderBy(*order))
    return stats.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def operator_stats(best: DataFrame, is_good: Column, by: tuple[str, ...] = (), total_zones: DataFrame | None = None) -> DataFrame:
    """Good and bad zones of each operator.

    With ``total_zones`` (distinct zones, one row each, interpolated ones included)
    zones that an operator lacks count as bad.
    """
    rated = best.groupBy(*by, *OPERATOR).agg(F.count_if(is_good).alias("good"), F.count_if(~is_good).alias("bad"), F.count("*").alias("_own"))
    if total_zones is None:
        return rated.drop("_own")
    if by:
        totals = total_zones.groupBy(*by).agg(F.count("*").alias("_all"))
        joined = rated.join(totals, [*by])
    else:
        joined = rated.crossJoin(F.broadcast(total_zones.agg(F.count("*").alias("_all"))))  # one row
    return joined.withColumn("bad", F.col("bad") + F.col("_all") - F.col("_own")).drop("_own", "_all")


def coverage_summary(best: DataFrame, size: float) -> DataFrame:
    """One row: zones, operators, rows, bounding box, most zones possible and the share covered."""
    span = lambda c: (F.max(c) - F.min(c) + size) / size
    counts = best.agg(
        F.countDistinct("zone_x", "zone_y").alias("unique_zones"), F.countDistinct(*OPERATOR).alias("unique_operators"), F.count("*").alias("zone_rows"),
        F.min("zone_x").alias("min_x"), F.max("zone_x").alias("max_x"), F.min("zone_y").alias("min_y"), F.max("zone_y").alias("max_y"),
        (span("zone_x") * span("zone_y")).alias("theoretical"),
    )
    return counts.withColumn("coverage_pct", F.col("unique_zones") / F.col("theoretical") * 100)


def sample_rows(best: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``best`` with columns of the first row of each chosen group."""
    wanted = rows.select(F.col("seq").alias("first_seq"), *[F.col(c).alias(f"sample_{c}") for c in columns])
    return best.join(wanted, "first_seq")


def zone_first_order(df: DataFrame) -> list[Column]:
    """The zone's key as text, then the operator's, then MCC, MNC and PCI with numbers before texts."""
    keys = zone_columns(df)
    zone = F.concat(F.lit("segment_"), F.col("segment_id").cast("string")) if keys == ["segment_id"] else F.concat_ws("_", *[number_text(F.col(k)) for k in keys])
    return [zone.asc(), F.concat_ws("_", *map(F.col, OPERATOR)).asc(), *[F.asc(k) for k in keys], *[o for c in (*OPERATOR, "pci") for o in numeric_then_text(F.col(c))]]


def zone_centre(size: float) -> tuple[Column, Column]:
    """Middle of a grid zone in metres."""
    return F.col("zone_x") + size / 2, F.col("zone_y") + size / 2


def with_positions(zoned: DataFrame, size: float, starts: DataFrame | None = None) -> DataFrame:
    """``zoned`` with lon and lat: a grid zone's centre, or where its segment starts.

    Only distinct zones are projected back; ``starts`` are (segment_id, x, y).
    """
    keys = zone_columns(zoned)
    places = zoned.select(*keys).distinct()
    if starts is not None:
        places = places.join(starts.select("segment_id", "x", "y"), "segment_id")
    else:
        x, y = zone_centre(size)
        places = places.withColumns({"x": x, "y": y})
    found = places.withColumn("_c", unproject(F.col("x"), F.col("y"))).select(*keys, F.col("_c.lon").alias("lon"), F.col("_c.lat").alias("lat"))
    return zoned.join(found, keys, "left")
