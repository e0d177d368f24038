"""5G availability of measurements from a second data set, within a time tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import free_name
from ..functions.scalars import operator_code

#: Rows of one operator in a slice of time, several times the tolerance long, make a window's partition.
SLICE = 64


def sync(rows: DataFrame, states: DataFrame, tolerance_ms: int) -> DataFrame:
    """``rows`` with nr (yes or no) and the numbers of yes and no states within the tolerance.

    ``rows`` has mcc, mnc, time_ms and its own columns; ``states`` has mcc, mnc,
    time_ms and nr. Any yes within [t - tol, t + tol] wins, then any no; unmatched rows
    are ``no``. Rows without MCC or MNC are compared with all states; states without
    either count for none.

    Both sides meet in one frame over time, so pairs are never formed. Time is cut in
    slices; states near a slice's ends are copied to the neighbour, so that one operator
    with most rows is many partitions.
    """
    width = SLICE * (tolerance_ms + 1)
    mcc, mnc, yes, no, row, cut = (free_name(rows, c) for c in ("op_mcc", "op_mnc", "yes", "no", "row", "slice"))
    codes = lambda df: df.withColumns({mcc: F.coalesce(operator_code(F.col("mcc")), F.lit("")), mnc: F.coalesce(operator_code(F.col("mnc")), F.lit(""))})
    keyed = codes(rows)
    partial = (F.col(mcc) == "") | (F.col(mnc) == "")
    keyed = keyed.withColumns({mcc: F.when(partial, "").otherwise(F.col(mcc)), mnc: F.when(partial, "").otherwise(F.col(mnc))})
    known = codes(states.select("mcc", "mnc", "time_ms", "nr").filter(F.col("nr").isin("yes", "no") & F.col("time_ms").isNotNull()))
    known = known.filter((F.col(mcc) != "") & (F.col(mnc) != ""))
    counted = known.groupBy(mcc, mnc, "time_ms").agg(F.count_if(F.col("nr") == "yes").alias(yes), F.count_if(F.col("nr") == "no").alias(no))
    # Rows without an operator see every state: an extra copy under the blank key, summed over operators.
    every = counted.union(counted.groupBy("time_ms").agg(F.sum(yes).alias(yes), F.sum(no).alias(no)).select(F.lit("").alias(mcc), F.lit("").alias(mnc), "time_ms", yes, no))
    near = F.array_distinct(F.array(*[F.floor((F.col("time_ms") + d) / width) for d in (-tolerance_ms, 0, tolerance_ms)]))
    states_at = every.withColumn(cut, F.explode(near))
    own = keyed.withColumn(cut, F.floor(F.col("time_ms") / width))
    tagged = own.withColumns({yes: F.lit(0).cast("long"), no: F.lit(0).cast("long"), row: F.lit(True)})
    both = tagged.unionByName(states_at.withColumn(row, F.lit(False)), allowMissingColumns=True)
    frame = Window.partitionBy(mcc, mnc, cut).orderBy("time_ms").rangeBetween(-tolerance_ms, tolerance_ms)
    timed = both.filter(F.col("time_ms").isNotNull()).withColumns({"yes_n": F.sum(yes).over(frame), "no_n": F.sum(no).over(frame)}).filter(F.col(row))
    untimed = tagged.filter(F.col("time_ms").isNull()).withColumns({"yes_n": F.lit(0).cast("long"), "no_n": F.lit(0).cast("long")})
    out = timed.unionByName(untimed)
    kept = [c for c in rows.columns if c not in ("nr", "yes_n", "no_n", "fallback")]
    return out.withColumn("nr", F.when(F.col("yes_n") > 0, "yes").otherwise("no")).select(*kept, "nr", "yes_n", "no_n", partial.alias("fallback"))


def sync_stats(synced: DataFrame) -> DataFrame:
    """Counters of a sync: rows, yes, no, matched, conflicts, and rows matched by time alone."""
    matched = (F.col("yes_n") > 0) | (F.col("no_n") > 0)
    return synced.agg(
        F.count("*").alias("total"), F.count_if(F.col("nr") == "yes").alias("yes"), F.count_if(F.col("nr") == "no").alias("no"),
        F.count_if(matched).alias("matched"), F.count_if((F.col("yes_n") > 0) & (F.col("no_n") > 0)).alias("conflicts"), F.count_if(F.col("fallback") & matched).alias("fallback_rows"),
    )


def source_check(synced: DataFrame, source: str = "source_idx") -> DataFrame:
    """For each source file of measurements: rows, rows with a time, and matched rows."""
    matched = (F.col("yes_n") > 0) | (F.col("no_n") > 0)
    return synced.groupBy(source).agg(F.count("*").alias("rows"), F.count("time_ms").alias("timed"), F.count_if(matched).alias("matched"))


def state_check(states: DataFrame, source: str = "source_idx") -> DataFrame:
    """For each source file of states: usable rows (operator, time and a known state) and those that say yes."""
    usable = F.col("nr").isin("yes", "no") & F.col("time_ms").isNotNull() & (F.trim("mcc") != "") & (F.trim("mnc") != "")
    return states.groupBy(source).agg(F.count("*").alias("rows"), F.count_if(usable).alias("usable"), F.count_if(usable & (F.col("nr") == "yes")).alias("yes"))


def require_sources(check: DataFrame, column: str, what: str, names: DataFrame | None = None) -> None:
    """Raise if some source has none of what it needs; names the sources, with their ``path`` where ``names`` (source, path) has them."""
    key = check.columns[0]
    bad = check.filter(F.col(column) == 0).select(key)
    shown = F.col(key).cast("string")
    if names is not None:
        bad, shown = bad.join(names.select(key, "path"), key, "left"), F.concat(shown, F.coalesce(F.concat(F.lit(" ("), "path", F.lit(")")), F.lit("")))
    found = [r.name for r in bad.orderBy(key).select(shown.alias("name")).collect()]
    if found:
        raise ValueError(f"no {what} in: {', '.join(found)}")


def require_yes(check: DataFrame) -> None:
    """Raise if no usable row of any source of states says yes."""
    if not check.filter("yes > 0").limit(1).count():
        raise ValueError("no state says yes in any file")
