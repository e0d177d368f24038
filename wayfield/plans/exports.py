"""Measurements written as the text exports that the readers take, for queries about files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_dir
from ..sources import adapter

#: Consecutive row numbers of a source that make a file: bounds a file's size.
ROWS = 5000

LAYOUTS = {
    0: ("", "Latitude;Longitude;Frequency;PCI;MCC;MNC;RSRP"),
    1: ("", "Lat;Lng;freq;PCI;MCC;MNC;rsrp;SINR"),
    2: ("Device: car 7\n\n", "latitude;longitude;NR-ARFCN;PCI;MCC;MNC;SSS-RSRP;note"),
}


def _folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def rule_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a rule file for each operator and frequency measured."""
    pairs = adapter.measurements(spark, sf_dir).select("mnc", "frequency").distinct()
    center = F.col("frequency").cast("bigint")
    body = F.concat(F.lit('<Query>\n"MNC" = '), "mnc", F.lit('; ("MCC" = 231 AND "Frequency" = '), (center + 100).cast("string"), F.lit("-"), (center - 100).cast("string"), F.lit(")\n</Query>"))
    path = _folder(spark, "rules")
    named = pairs.select(F.concat(F.lit("mnc"), "mnc", F.lit("_"), "frequency").alias("rule"), body.alias("value"))
    named.repartition("rule").write.partitionBy("rule").text(path)
    return path


#: Files of states: three headers by source, each with another name for the state.
STATES = {0: "MCC;MNC;5G NR;UTC", 1: "UTC;NR;MNC;MCC", 2: "Device: car 7\n\nMCC;MNC;5GNR;UTC;Note"}


def _save(lines: DataFrame, head: Column, path: str) -> list[str]:
    """Lines (source_idx, file, seq, line) as one text file for each ``file``, of at most ROWS lines, below ``head``."""
    whole = lines.groupBy("source_idx", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda r: r["line"]), "\n").alias("body"))
    content = whole.select("file", F.concat(head, F.lit("\n"), "body").alias("value"))
    content.repartition("file").write.partitionBy("file").text(path)
    return [path]


def _file() -> Column:
    return F.format_string("%02d-%012d", "source_idx", F.floor(F.col("seq") / ROWS))


def states(spark: SparkSession, sf_dir: str) -> list[str]:
    """Paths of files with the 5G states of the measurement view, times as epoch numbers."""
    rows = adapter.measurements(spark, sf_dir)
    state = F.when(F.col("nr") == "yes", "Yes").when(F.col("nr") == "no", "0").otherwise("")
    mcc, mnc, utc = F.col("mcc"), F.concat(F.lit("0"), "mnc"), F.col("time_ms").cast("string")
    line = F.when(F.col("source_idx") == 0, F.concat_ws(";", mcc, mnc, state, utc)).when(F.col("source_idx") == 1, F.concat_ws(";", utc, state, mnc, mcc)).otherwise(F.concat_ws(";", mcc, mnc, state, utc, F.lit("x")))
    head = F.when(F.col("source_idx") == 0, STATES[0]).when(F.col("source_idx") == 1, STATES[1]).otherwise(STATES[2])
    return _save(rows.select("source_idx", _file().alias("file"), "seq", line.alias("line")), head, _folder(spark, "states"))


def written(spark: SparkSession, sf_dir: str, twice: bool = False, without_pci: bool = False, rsrp: str = "SSS-RSRP") -> list[str]:
    """Paths of export files of the measurement view; three layouts by source.

    ``twice`` adds a second RSRP column to the second layout, ``without_pci`` leaves PCI out
    of the first, ``rsrp`` is the signal's name in the third.
    """
    rows = adapter.measurements(spark, sf_dir)
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    base = [c("lat"), c("lon"), c("frequency"), c("pci"), c("mcc"), c("mnc"), c("rsrp_c")]
    note = F.concat(F.lit('"r;""'), c("seq"), F.lit('"""'))
    line = F.when(F.col("source_idx") == 0, F.concat_ws(";", *(base[:3] + base[4:] if without_pci else base)))
    line = line.when(F.col("source_idx") == 1, F.concat_ws(";", *base, c("sinr_c"), *([c("rsrp_c")] if twice else []))).otherwise(F.concat_ws(";", *base, note))
    heads = {k: before + h for k, (before, h) in LAYOUTS.items()}
    if twice:
        heads[1] += ";RS-RP"
    if without_pci:
        heads[0] = heads[0].replace("PCI;", "")
    heads[2] = heads[2].replace("SSS-RSRP", rsrp)
    head = F.when(F.col("source_idx") == 0, heads[0]).when(F.col("source_idx") == 1, heads[1]).otherwise(heads[2])
    return _save(rows.select("source_idx", _file().alias("file"), "seq", line.alias("line")), head, _folder(spark, "exports"))


#: Headers that no field's name tells, by source: above wide rows, below a decoy that narrow lines follow, and alone in its file.
UNNAMED = {0: "namérené;b;c;d;e;f;g", 1: "r;s;t;u;v;w;x;y;z" + "\nx" * 30 + "\nh1;h2;h3;h4;h5;h6;h7", 2: "x\ny\nonly;one;wide;line;in;this;file"}


def unnamed(spark: SparkSession, sf_dir: str) -> list[str]:
    """Paths of files whose headers have to be told by their width; those of source 0 are in Latin-1."""
    rows = adapter.measurements(spark, sf_dir)
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    wide = F.concat_ws(";", c("lat"), c("lon"), c("frequency"), c("pci"), F.concat(c("mcc"), F.lit("é")), c("mnc"), c("rsrp_c"))
    line = F.when(F.col("source_idx") == 2, F.concat_ws(";", c("pci"), c("mnc"))).otherwise(wide)
    head = F.when(F.col("source_idx") == 0, UNNAMED[0]).when(F.col("source_idx") == 1, UNNAMED[1]).otherwise(UNNAMED[2])
    whole = rows.select("source_idx", _file().alias("file"), "seq", line.alias("line")).groupBy("source_idx", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda r: r["line"]), "\n").alias("body"))
    content = whole.select("source_idx", "file", F.concat(head, F.lit("\n"), "body").alias("value"))
    path = _folder(spark, "unnamed")
    for source, encoding in ((0, "ISO-8859-1"), (1, "UTF-8"), (2, "UTF-8")):
        content.filter(F.col("source_idx") == source).select("file", F.encode("value", encoding).cast("string").alias("value")).repartition("file").write.partitionBy("file").text(f"{path}/source={source}")
    return [path]
