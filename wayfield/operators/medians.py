"""Exact medians of many groups at once, none of them gathered.

Values of a group are counted in bins between its least and its largest value; the bin
that holds the middle is looked into next, until few values are left. Only counts of
bins are shuffled, and the few values of the last step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import checkpointed

#: Bins of a group in a round, and values of a group that are sorted in one place (parameters).
BINS, FEW = 1024, 4096
#: Groups (of about 100 bytes) up to which their bounds are broadcast.
BROADCAST_ROWS = 100_000


def medians(rows: DataFrame, keys: list[str], value: str, name: str, bounds: DataFrame | None = None, bins: int = BINS, few: int = FEW) -> DataFrame:
    """(keys, name): the median of ``value`` in each group, the mean of the two middle ones for an even number.

    ``rows`` is read once for the bounds, unless ``bounds`` has them (keys, lo, hi, n; not
    narrower than the values), and once or twice a round, of which there are
    about log(n / few) / log(bins). Null values don't count, a group of nulls gives no row.
    """
    # Helper columns can't clash with keys of other names.
    given, keys = keys, [f"key{i}" for i in range(len(keys))]
    named = [F.col(a).alias(b) for a, b in zip(given, keys, strict=True)]
    own = rows.select(*named, F.col(value).cast("double").alias("v")).filter("v is not null")
    if bounds is None:
        bounds = own.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    else:
        bounds = bounds.select(*named, "lo", "hi", "n")
    left = bounds.select(*keys, "lo", "hi", "n", F.expr("(n - 1) div 2").alias("rank"), (F.col("n") % 2 == 0).alias("even"))
    is_open, is_few = F.col("lo") < F.col("hi"), F.col("n") <= few
    found = []
    while True:
        # Groups by a number from here on: one small row each, written, so that all uses see the same numbers.
        left = checkpointed(left.withColumn("g", F.monotonically_increasing_id()))
        size, n_few, n_many = left.agg(F.count("*"), F.count_if(is_open & is_few), F.count_if(is_open & ~is_few)).first()
        found.append(left.filter(~is_open).select(*keys, F.col("lo").alias(name)))
        ends = left.filter(is_open)
        inside = own.join(F.broadcast(ends) if size <= BROADCAST_ROWS else ends, keys).filter("v between lo and hi")
        if n_few:
            # Sorted in one place: at most ``few`` of a group.
            rest = inside.filter(is_few).groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("vs")).join(left, "g")
            at = lambda k: F.get("vs", k.cast("int"))
            found.append(rest.select(*keys, F.when(F.col("even"), (at(F.col("rank")) + at(F.col("rank") + 1)) / 2).otherwise(at(F.col("rank"))).alias(name)))
        if not n_many:
            return reduce(DataFrame.unionAll, found).withColumnsRenamed(dict(zip(keys, given, strict=True)))
        # Rises with v, so the order of bins is that of their values.
        number = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
        counted = inside.filter(~is_few).groupBy("g", number.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).join(left.select(*keys, "g", "rank", "even"), "g")
        bin_of = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("c")), F.struct("bin", "before", "c", "least", "most")))
        middle = checkpointed(counted.groupBy(*keys, "rank", "even").agg(bin_of(F.col("rank")).alias("a"), bin_of(F.col("rank") + F.col("even").cast("int")).alias("b")))
        found.append(middle.filter("a.bin < b.bin").select(*keys, ((F.col("a.most") + F.col("b.least")) / 2).alias(name)))
        left = middle.filter("a.bin = b.bin").select(*keys, F.col("a.least").alias("lo"), F.col("a.most").alias("hi"), F.col("a.c").alias("n"), (F.col("rank") - F.col("a.before")).alias("rank"), "even")
