"""Results as tables and as the text files that drive-test tools read."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.functions import arrow_udf

from ..functions.names import free_name
from ..functions.scalars import int_like, numeric_then_text


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded as the exact binary value; empty for null."""

    @arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array(["" if v is None else f"{v:.{digits}f}" for v in values.to_pylist()], pa.string())

    return run(value)


def zones_table(best: DataFrame) -> DataFrame:
    """The zones file's columns of measured rows; signal as computed, for ``fixed`` to round."""
    keys = [c for c in ("segment_id", "zone_x", "zone_y") if c in best.columns]
    return best.select(*keys, int_like(F.col("mcc")).alias("mcc"), int_like(F.col("mnc")).alias("mnc"), "pci", "frequency", "rsrp", "sinr", F.when(F.col("nr") == "yes", "yes").otherwise("no").alias("nr"), F.col("n").alias("rows_in_zone"), F.col("frequency").alias("frequencies"))


def zone_order(df: DataFrame) -> list[Column]:
    """MCC, MNC and PCI, numbers before texts, then the zone."""
    keys = [c for c in ("segment_id", "zone_x", "zone_y") if c in df.columns]
    return [k for c in ("mcc", "mnc", "pci") for k in numeric_then_text(F.col(c))] + [F.asc(k) for k in keys]


def quoted(cell: Column) -> Column:
    return F.when(cell.rlike('[;"\r\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def line_of(columns: list[str]) -> Column:
    """Cells of a row, separated by ``;`` and quoted where needed."""
    return F.concat_ws(";", *[quoted(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in columns])


def write_lines(df: DataFrame, header: str, path: str, order: list[Column], columns: list[str] | None = None, raw: str | None = None, single: bool = False) -> None:
    """A ``;``-separated text with a header, as parts that follow one another in ``order``.

    ``raw`` is a last column written without quotes. ``single`` gathers all in one part:
    an exit for small results that other tools read.
    """
    names = columns or df.columns
    line = F.concat_ws(";", line_of(names), *([F.coalesce(F.col(raw), F.lit(""))] if raw else []))
    text, place = free_name(df, "line"), free_name(df, "place")
    body = df.withColumns({text: line, place: F.lit(1)})
    first = df.sparkSession.createDataFrame([(header, 0)], f"`{text}` string, `{place}` int")
    rows = first.unionByName(body, allowMissingColumns=True).orderBy(F.col(place), *order).select(F.col(text).alias("value"))
    (rows.coalesce(1) if single else rows).write.mode("overwrite").text(path)


class PiecesWriter(DataSourceArrowWriter):
    """Writes texts as they come, with nothing between them, as one part a partition.

    A task writes to a name of its own attempt; the commit gives the parts their names,
    so tasks that fail and run again leave nothing behind.
    """

    def __init__(self, url: str, header: str):
        self.url, self.header = url, header

    def write(self, iterator):
        files, folder = fs.FileSystem.from_uri(self.url)
        task = TaskContext.get()
        made = f"{folder}/_temporary/{task.partitionId()}-{task.taskAttemptId()}"
        with files.open_output_stream(made) as out:
            for batch in iterator:
                for text in batch.column(0):
                    out.write(text.as_py().encode())
        return PartMessage(made, task.partitionId())

    def commit(self, messages):
        files, folder = fs.FileSystem.from_uri(self.url)
        for old in files.get_file_info(fs.FileSelector(folder)):
            if old.base_name != "_temporary":
                files.delete_dir(old.path) if old.type == fs.FileType.Directory else files.delete_file(old.path)
        with files.open_output_stream(f"{folder}/part-00000") as out:
            out.write(self.header.encode())
        for m in messages:
            if m is not None:
                files.move(m.path, f"{folder}/part-{m.part + 1:05d}")
        files.delete_dir(f"{folder}/_temporary")
        files.open_output_stream(f"{folder}/_SUCCESS").close()

    def abort(self, messages):
        files, folder = fs.FileSystem.from_uri(self.url)
        files.delete_dir_contents(f"{folder}/_temporary", missing_dir_ok=True)


@dataclass
class PartMessage(WriterCommitMessage):
    path: str
    part: int


class Pieces(DataSource):
    """Sink of ``write_pieces``; Spark's text sink ends each row with a separator that can't be empty."""

    @classmethod
    def name(cls) -> str:
        return "wayfield_pieces"

    def writer(self, schema, overwrite: bool) -> PiecesWriter:
        files, folder = fs.FileSystem.from_uri(self.options["url"])
        files.create_dir(f"{folder}/_temporary", recursive=True)
        return PiecesWriter(self.options["url"], self.options["header"])


def write_pieces(rows: DataFrame, header: str, path: str, single: bool = False) -> None:
    """One column of text, written without separators as parts that follow one another, ``header`` first.

    ``path`` is resolved as Spark resolves it and must be on a file system that pyarrow opens.
    """
    spark = rows.sparkSession
    spark.dataSource.register(Pieces)
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    url = found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()
    url = re.sub("^file:/+", "file:///", url).rstrip("/")
    (rows.coalesce(1) if single else rows).write.format(Pieces.name()).mode("overwrite").options(url=url, header=header).save()


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ("mcc", "mnc")) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_zones(best: DataFrame, path: str, single: bool = False) -> None:
    """Zones in the columns of ``zones_table``; ``plans.outputs`` writes them in the input's."""
    rows = zones_table(best).withColumns({"rsrp": fixed(F.col("rsrp"), 2), "sinr": fixed(F.col("sinr"), 2)})
    note = F.concat(F.col("frequencies"), F.lit(" # Meraní: "), F.col("rows_in_zone").cast("string"))
    names = [c for c in rows.columns if c not in ("rows_in_zone", "frequencies")]
    header = ";".join([*names, "Riadky_v_zone", "Frekvencie_v_zone"])
    write_lines(rows.withColumn("note", note), "\n" + header, path, zone_order(rows), [*names, "rows_in_zone"], "note", single)


def stats_labels(rsrp: float, sinr: float, with_sinr: bool, mobile: bool = False) -> tuple[str, str]:
    """Headers of the columns of good and bad zones (fixed values of the file format)."""
    good, bad = f"RSRP >= {rsrp:g}", f"RSRP < {rsrp:g}"
    if with_sinr:
        good, bad = f"{good} a SINR >= {sinr:g}", f"{bad} alebo SINR < {sinr:g}"
    return (f"{good} a 5G NR = yes", f"{bad} alebo 5G NR != yes") if mobile else (good, bad)


def write_stats(stats: DataFrame, path: str, rsrp: float, sinr: float, mobile: bool = False, with_sinr: bool = True) -> None:
    """Operators' counts; a few rows, so one part."""
    rows = stats.select(int_like(F.col("mnc")).alias("mnc"), int_like(F.col("mcc")).alias("mcc"), "good", "bad")
    header = ";".join(["MNC", "MCC", *stats_labels(rsrp, sinr, with_sinr, mobile)])
    write_lines(rows, header, path, [*numeric_then_text(F.col("mcc")), *numeric_then_text(F.col("mnc"))], single=True)
