"""Rows for zones that operators have not measured, and for operators added by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import operator_code
from .zones import OPERATOR, zone_columns

#: Signal given to a zone without measurements, in dBm.
EMPTY_RSRP = -174.0


def operators_of(rows: DataFrame) -> DataFrame:
    """Operators by their comparison codes, with the first row of each as a template.

    A few rows whatever the input: networks of a country.
    """
    keyed = rows.withColumns({"op_mcc": operator_code(F.col("mcc")), "op_mnc": operator_code(F.col("mnc"))})
    return keyed.groupBy("op_mcc", "op_mnc").agg(F.min("seq").alias("template_seq"))


def empty_zones(best: DataFrame, templates: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Every zone and operator without a measured row, at EMPTY_RSRP and without 5G.

    ``zones`` are the distinct zones (by default the measured ones; for segments pass
    the interpolated ones too). The product is zones times operators, as large as the
    complete result.
    """
    keys = zone_columns(best)
    every = (best if zones is None else zones).select(*keys).distinct()
    wanted = every.crossJoin(templates)  # Spark sends the smaller side around if it is small
    have = best.select(*keys, operator_code(F.col("mcc")).alias("op_mcc"), operator_code(F.col("mnc")).alias("op_mnc")).distinct()
    missing = wanted.join(have, [*keys, "op_mcc", "op_mnc"], "left_anti")
    return missing.select(*keys, F.col("op_mcc").alias("mcc"), F.col("op_mnc").alias("mnc"), "template_seq", F.lit(EMPTY_RSRP).alias("rsrp"), F.lit("no").alias("nr"), F.lit(0).cast("long").alias("n"))


def with_templates(empty: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``empty`` with other columns of the first row of its operator.

    One template row for each operator, so the side joined in is as short as their list.
    """
    seqs = empty.select("template_seq").distinct()
    found = rows.select(F.col("seq").alias("template_seq"), *columns).join(seqs, "template_seq", "left_semi")
    return empty.join(found, "template_seq", "left")


def custom_list(text: str) -> list[tuple[str, str, str]]:
    """MCC:MNC[:PCI] tokens separated by blanks, commas or semicolons; the first of an operator counts."""
    out: dict[tuple[str, str], tuple[str, str, str]] = {}
    for token in text.replace(",", " ").replace(";", " ").split():
        parts = [p.strip() for p in token.split(":")]
        if len(parts) not in (2, 3) or not parts[0] or not parts[1]:
            raise ValueError(f"not MCC:MNC[:PCI]: {token!r}")
        out.setdefault((parts[0], parts[1]), (parts[0], parts[1], parts[2] if len(parts) == 3 else ""))
    return list(out.values())


def absent_operators(custom: DataFrame, best: DataFrame) -> DataFrame:
    """Added operators (mcc, mnc, pci) that have no measured zone, once each."""
    first = custom.withColumn("mnc", F.trim("mnc")).withColumn("mcc", F.trim("mcc")).groupBy(*OPERATOR).agg(F.first("pci").alias("pci"))
    have = best.select(*[operator_code(F.col(c)).alias(f"own_{c}") for c in OPERATOR]).distinct()
    known = (operator_code(F.col("mcc")) == F.col("own_mcc")) & (operator_code(F.col("mnc")) == F.col("own_mnc"))
    return first.join(have, known, "left_anti")


def custom_zones(custom: DataFrame, best: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """A row for each zone (by default the measured ones) and absent added operator.

    The product is as large as the result; added operators are a list written by hand.
    """
    every = (best if zones is None else zones).select(*zone_columns(best)).distinct()
    added = absent_operators(custom, best)
    return every.crossJoin(added).select("*", F.lit(EMPTY_RSRP).alias("rsrp"), F.lit("no").alias("nr"))


def with_placeholders(stats: DataFrame, custom: DataFrame, best: DataFrame, total_zones: DataFrame) -> DataFrame:
    """Operators' counts with a row for each absent added operator, for which all zones are bad."""
    total = total_zones.agg(F.count("*").alias("bad"))  # one row
    added = absent_operators(custom, best).crossJoin(F.broadcast(total)).filter("bad > 0")
    return stats.unionByName(added.select("mcc", "mnc", F.lit(0).cast("long").alias("good"), "bad"))
