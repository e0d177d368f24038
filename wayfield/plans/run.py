"""A whole run: files in, zones, operators' counts and a summary out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CoverageConfig
from ..functions.geo import reproject
from ..functions.names import free_name
from ..functions.scalars import operator_code, parse_number
from ..operators import densify, filters, order, route, rules, sync, zones
from ..sources import sinks, text
from . import outputs


@dataclass
class Result:
    best: DataFrame
    empty: DataFrame | None
    stats: DataFrame
    summary: DataFrame
    added: DataFrame | None = None  # zones of operators added by hand
    starts: DataFrame | None = None  # where segments begin
    templates: DataFrame | None = None  # the first row of each operator
    lists: DataFrame | None = None  # ids of each group's rows, in pieces
    zones: DataFrame | None = None  # rows of the zones file
    layout: outputs.Layout | None = None

    def write(self, zones_path: str, stats_path: str, cfg: CoverageConfig, single: bool = False) -> None:
        """The zones and operators files of a run over files."""
        outputs.write_zones_file(self.zones, self.layout, zones_path, single)
        with_sinr = self.best.filter(F.col("sinr").isNotNull()).limit(1).count() > 0
        sinks.write_stats(self.stats, stats_path, cfg.rsrp_threshold, cfg.sinr_threshold, cfg.mobile, with_sinr)


def coverage(rows: DataFrame, cfg: CoverageConfig) -> Result:
    """Zones and counts of typed measurements with x and y in metres."""
    # Read by statistics, templates and row lists, so written once; filters on zones would repeat the long projection too.
    placed = route.common_route(rows, cfg.size) if cfg.segments else order.checkpointed(zones.grid(rows, cfg.size))
    placed = filters.grouped_keys(placed)
    if cfg.canonical_keys:
        placed = placed.withColumns({k: operator_code(F.col(k)) for k in zones.OPERATOR})
    stats = zones.frequency_stats(placed)
    best = order.checkpointed(zones.best_frequency(stats, cfg.rsrp_threshold, cfg.sinr_threshold))
    every = empty = added = starts = templates = None
    if cfg.segments:
        measured = route.segment_starts(placed, cfg.size).select("segment_id", "x", "y")
        starts = order.checkpointed(measured.unionByName(route.gap_segments(placed, cfg.size).select("segment_id", "x", "y")) if cfg.densify else measured)
    is_good = zones.good(cfg.rsrp_threshold, cfg.sinr_threshold, cfg.mobile)
    if cfg.densify:
        every = best.select(*zones.zone_columns(best)).distinct()
        every = every.union(starts.select("segment_id")).distinct() if cfg.segments else every
        templates = order.checkpointed(densify.operators_of(placed))
        empty = densify.empty_zones(best, templates, every)
    counts = zones.operator_stats(best, is_good, total_zones=every)
    if cfg.densify and cfg.custom_operators:
        custom = outputs.added_operators(rows.sparkSession, cfg.custom_operators)
        added = outputs.added_rows(best, every, custom, rows)
        counts = densify.with_placeholders(counts, custom, best, every)
    summary = best.agg(F.countDistinct("segment_id").alias("unique_zones"), F.countDistinct(*zones.OPERATOR).alias("unique_operators"), F.count("*").alias("zone_rows")) if cfg.segments else zones.coverage_summary(best, cfg.size)
    lists = zones.row_lists(placed) if "row_id" in placed.columns else None
    return Result(best, empty, counts, summary, added, starts, templates, lists)


def export(result: Result, cells: DataFrame, cfg: CoverageConfig) -> Result:
    """``result`` with the rows of the zones file, in the columns of ``cells``."""
    layout = outputs.layout_of(cells, cfg.fields, cfg.mobile)
    placed = lambda rows: None if rows is None else outputs.positions(rows, cfg.size, result.starts)
    result.layout = layout
    result.zones = outputs.zones_file(placed(result.best), placed(result.empty), placed(result.added), cells, result.lists, layout, cfg.zone_mode == "original", result.templates)
    return result


def synchronised(spark: SparkSession, rows: DataFrame, cfg: CoverageConfig, state_paths: list[str], found: list[rules.Rule], names: DataFrame | None = None) -> DataFrame:
    """``rows`` with the 5G state of the second files, to which the same rules apply; errors name what is missing."""
    if not state_paths:
        raise ValueError("a mobile run needs files with states")
    table, state_names = text.read_named(spark, state_paths, states=True)
    if found:
        table = rules.expand(rules.match(table, found), found, cfg.keep_original_rows)
    states = order.checkpointed(text.typed(table, {"nr": text.NR}).select(text.SOURCE, "mcc", "mnc", "time_ms", "nr"))
    check = sync.state_check(states)
    sync.require_sources(check, "usable", "usable row", state_names)
    sync.require_yes(check)
    timed = rows.groupBy(text.SOURCE).agg(F.count("time_ms").alias("timed"))
    sync.require_sources(timed, "timed", "row with a time", names)
    out = order.checkpointed(sync.sync(rows, states, cfg.sync_tolerance_ms))
    sync.require_sources(sync.source_check(out), "matched", "match", names)
    return out


def run(spark: SparkSession, paths: list[str], cfg: CoverageConfig, state_paths: list[str] | None = None) -> Result:
    """Read, order, filter, rewrite, synchronise and project measurements, then rate their zones."""
    cfg.validate()
    table, names = text.read_named(spark, paths, cfg.fields or None)
    table = table.withColumn("time_ms", text.time_of(table))
    existing = "original_excel_row" if "original_excel_row" in table.columns and len(paths) == 1 else None
    # Rows are numbered once: by time if there are several files, else as they stand.
    keys = [F.col("time_ms").asc_nulls_last(), F.col("seq").asc()] if len(paths) > 1 else [F.col("seq").asc()]
    number = free_name(table, "number")
    table = order.numbered(table, keys, number).drop("seq").withColumnRenamed(number, "seq")
    table = order.with_ids(table, F.col("seq") + 1, existing)
    table = filters.exclude_windows(table, filters.window_bounds(table, list(cfg.exclude_windows)), "time_ms", check=True)
    if cfg.exclude_row_ids:
        table = filters.exclude_rows(table, spark.createDataFrame([(str(i),) for i in cfg.exclude_row_ids], "row_id string"))
    found = [r for p in cfg.rule_paths for r in text.rules_of(text.read_rules(spark, p))]
    if found:
        copies = 2 + max(len(r.combinations()) for r in found)
        table = rules.expand(rules.match(table, found, cfg.fields), found, cfg.keep_original_rows, cfg.fields)
        table = table.withColumn("seq", F.col("seq") * copies + F.col("pos")).drop("pos", "rule")
    rows = text.typed(table, cfg.fields)
    if cfg.mobile:
        rows = synchronised(spark, rows, cfg, state_paths or [], found, names)
    rows = filters.usable(rows).withColumns({"lat": parse_number(F.col("lat")), "lon": parse_number(F.col("lon"))})
    return export(coverage(reproject(rows), cfg), table, cfg)
