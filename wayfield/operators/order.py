"""Orders and row numbers without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import free_name
from ..functions.shared import checkpointed


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """``df`` with its place in ``order``, counted from ``start``.

    Rows are range-partitioned and sorted, then numbered in two levels: places within
    a partition, and the sizes of the partitions before it (one small row each). The
    sorted rows are checkpointed, so both levels see the same partitions.
    """
    part, mono, offset = (free_name(df, c) for c in ("part", "mono", "offset"))
    placed = checkpointed(df.orderBy(*order).withColumns({part: F.spark_partition_id(), mono: F.monotonically_increasing_id()}))
    sizes = sorted((r[0], r.n) for r in placed.groupBy(part).agg(F.count("*").alias("n")).collect())
    before, rows = start, []
    for number, n in sizes:
        rows.append((number, before))
        before += n
    offsets = df.sparkSession.createDataFrame(rows, f"`{part}` int, `{offset}` long")
    place = F.col(offset) + F.col(mono).bitwiseAND(F.lit((1 << 33) - 1))
    # One row for each partition.
    return placed.join(F.broadcast(offsets), part).withColumn(name, place).drop(*{part, mono, offset} - {name})


def time_sort(df: DataFrame, time: str = "time_ms", seq: str = "seq", name: str = "sorted_seq") -> DataFrame:
    """Rows numbered by time; equal times keep their order, rows without a time come last."""
    return numbered(df, [F.col(time).asc_nulls_last(), F.col(seq).asc()], name)


def with_ids(rows: DataFrame, number: Column, existing: str | None = None, name: str = "row_id") -> DataFrame:
    """``rows`` with ``number`` (from 1) as text, or the filled cells of ``existing`` instead."""
    text = number.cast("string")
    if existing:
        text = F.coalesce(F.when(F.trim(F.col(existing)) != "", F.trim(F.col(existing))), text)
    return rows.withColumn(name, text)


def row_ids(df: DataFrame, existing: str | None = None, seq: str = "seq", name: str = "row_id") -> DataFrame:
    """Row numbers from 1 in file order; filled cells of ``existing`` are kept instead."""
    number = free_name(df, "number")
    return with_ids(numbered(df, [F.col(seq).asc()], number, start=1), F.col(number), existing, name).drop(number)
