"""Filters on measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import free_name
from ..functions.scalars import datetime_ms, parse_number
from ..functions.search import count_upto

#: Disjoint windows up to which a filter is one condition of the plan.
COMPILED = 32


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def usable(df: DataFrame, rsrp: str = "rsrp", lat: str = "lat", lon: str = "lon", strict: bool = True) -> DataFrame:
    """Rows with a numeric signal and filled coordinates.

    A coordinate that is filled but no number is an error: with ``strict`` the job
    fails when it meets one, otherwise such rows are kept out of the result.
    """
    kept = df.filter(parse_number(F.col(rsrp)).isNotNull() & ~blank(lat) & ~blank(lon))
    numeric = parse_number(F.col(lat)).isNotNull() & parse_number(F.col(lon)).isNotNull()
    if not strict:
        return kept.filter(numeric)
    return kept.filter(F.when(numeric, True).otherwise(F.raise_error(F.lit("a coordinate is no number")).cast("boolean")))


def window_bounds(df: DataFrame, windows: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """Epoch bounds of text windows; half-filled ones are skipped, bad or reversed ones are errors."""
    filled = [(a.strip(), b.strip()) for a, b in windows if a.strip() and b.strip()]
    if not filled:
        return []
    frame = df.sparkSession.createDataFrame(filled, "a string, b string")
    rows = frame.select("a", "b", datetime_ms(F.col("a")).alias("start"), datetime_ms(F.col("b")).alias("end")).collect()
    for r in rows:
        if r.start is None or r.end is None or r.end < r.start:
            raise ValueError(f"bad time window {r.a!r} to {r.b!r}")
    return [(r.start, r.end) for r in rows]


def merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint closed windows in order that hold the same times."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(windows):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def exclude_windows(df: DataFrame, windows: list[tuple[int, int]], time: str = "time_ms", check: bool = False) -> DataFrame:
    """Without rows inside any closed window; rows without a time stay.

    Windows are merged; a few make a condition, more are two sorted arrays in one row, in
    which a row's time is looked up by halving.
    """
    if not windows:
        return df
    if check and df.filter(F.col(time).isNotNull()).limit(1).count() == 0:
        raise ValueError("time windows need a time in some row")
    apart = merged(windows)
    if len(apart) <= COMPILED:
        inside = F.lit(False)
        for start, end in apart:
            inside = inside | F.col(time).between(start, end)
        return df.filter(F.col(time).isNull() | ~inside)
    starts, ends = free_name(df, "starts"), free_name(df, "ends")
    table = df.sparkSession.createDataFrame([tuple(map(list, zip(*apart)))], f"`{starts}` array<long>, `{ends}` array<long>")
    at = count_upto(F.col(starts), len(apart), F.col(time))
    # One row: 16 bytes a window of the settings.
    return df.join(F.broadcast(table), (at > 0) & (F.get(F.col(ends), at - 1) >= F.col(time)), "left_anti")


def exclude_rows(df: DataFrame, ids: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Without the rows whose id is in ``ids`` (one column of the same name)."""
    return df.join(ids.select(row_id).distinct(), row_id, "left_anti")


def grouped_keys(df: DataFrame, keys: tuple[str, ...] = ("mcc", "mnc", "pci", "frequency")) -> DataFrame:
    """Rows with all keys filled, as aggregation needs them."""
    kept = df
    for k in keys:
        kept = kept.filter(~blank(k))
    return kept


def nr_yes(df: DataFrame, nr: str = "nr") -> DataFrame:
    return df.filter(F.col(nr) == "yes")
