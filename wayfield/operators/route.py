"""Route distance, segments of a common route, and the alignment of several tracks.

A track is the rows of one source in order. Rows are handled in chunks of ``CHUNK``
consecutive row numbers, so that a long track is many partitions: sums run inside a
chunk, and a table with one row for each chunk carries them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import checkpointed, written
from .medians import BROADCAST_ROWS, medians
from .placement import KEY, placements

CHUNK = 100_000
SLACK = 1e-9
#: Fixed values of the alignment: samples of a track, metres between matching samples, metres that count as none.
SAMPLES = 2000
NEAR = 75.0
NO_LENGTH = 1e-6
#: Rows of a side of a cell above which the cell is dealt to several tasks (a parameter).
CELL_ROWS = 2000


def _campaign(df: DataFrame) -> DataFrame:
    return df if "campaign" in df.columns else df.withColumn("campaign", F.lit(0))


def cumulative(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``df`` (source_idx, seq, x, y) with cum, the metres travelled, and the previous point.

    prev_x, prev_y and prev_cum are null for a track's first point.
    """
    rows = _campaign(df).withColumn("_chunk", F.floor(F.col("seq") / chunk))
    here = Window.partitionBy(*KEY, "_chunk").orderBy("seq")
    rows = rows.withColumns({"_px": F.lag("x").over(here), "_py": F.lag("y").over(here)})
    rows = rows.withColumn("_step", F.coalesce(F.hypot(F.col("x") - F.col("_px"), F.col("y") - F.col("_py")), F.lit(0.0)))
    rows = rows.withColumn("_inside", F.sum("_step").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    point = F.struct("x", "y")
    # One row for each chunk: its ends and its own length.
    chunks = rows.groupBy(*KEY, "_chunk").agg(F.min_by(point, "seq").alias("a"), F.max_by(point, "seq").alias("b"), F.max("_inside").alias("own"))
    order = Window.partitionBy(*KEY).orderBy("_chunk")
    chunks = chunks.withColumns({"p": F.lag("b").over(order), "before": F.lag("own").over(order)})
    link = F.coalesce(F.hypot(F.col("a.x") - F.col("p.x"), F.col("a.y") - F.col("p.y")), F.lit(0.0))
    start = F.sum(F.coalesce("before", F.lit(0.0)) + link).over(order.rowsBetween(Window.unboundedPreceding, 0))
    chunks = chunks.select(*KEY, "_chunk", start.alias("_start"), F.col("p").alias("_p"), (start - link).alias("_p_cum"))
    joined = rows.join(chunks, [*KEY, "_chunk"])
    cum = F.col("_start") + F.col("_inside")
    first = F.col("_px").isNull()
    return joined.withColumns(
        {
            "cum": cum,
            "prev_x": F.coalesce("_px", F.col("_p.x")),
            "prev_y": F.coalesce("_py", F.col("_p.y")),
            "prev_cum": F.when(first, F.when(F.col("_p").isNotNull(), F.col("_p_cum"))).otherwise(cum - F.col("_step")),
        }
    ).drop("_chunk", "_px", "_py", "_step", "_inside", "_start", "_p", "_p_cum")


def tracks(cum: DataFrame) -> DataFrame:
    """One row for each track: points, length, first and last point."""
    point = F.struct("x", "y")
    return cum.groupBy(*KEY).agg(F.count("*").alias("points"), F.max("cum").alias("length"), F.min_by(point, "seq").alias("first"), F.max_by(point, "seq").alias("last"))


def segment_id(distance: Column, size: float) -> Column:
    return F.floor((distance + SLACK) / size).cast("bigint")


def samples(cum: DataFrame, most: int = SAMPLES) -> DataFrame:
    """At most ``most`` (and the last) points of each track, evenly spaced in distance.

    A target lies after the previous point and not after the next, so each pair of
    neighbours finds its own targets; of the two the nearer point is taken, the later one on a tie.
    """
    t = tracks(cum).select(*KEY, "points", "length", F.least("points", F.lit(most)).alias("m"))
    rows = cum.join(t, KEY)
    flat = (F.col("m") == 1) | (F.col("length") <= NO_LENGTH)
    steps = (F.col("m") - 1) / F.col("length")
    low = F.greatest(F.lit(0).cast("bigint"), F.floor(F.coalesce("prev_cum", F.lit(-1.0)) * steps) - 1)
    high = F.least(F.col("m") - 1, F.ceil(F.col("cum") * steps) + 1)
    at = lambda k: F.col("length") * k / (F.col("m") - 1)
    hits = F.filter(F.sequence(low, F.greatest(low, high)), lambda k: (k < F.col("m")) & (at(k) <= F.col("cum")) & (F.col("prev_cum").isNull() | (F.col("prev_cum") < at(k))))
    ks = F.when(flat, F.when(F.col("prev_cum").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))).otherwise(hits)
    last = ~flat & (F.col("cum") == F.col("length"))
    here = F.struct("seq", "x", "y", "cum")
    prev = F.struct((F.col("seq") - 1).alias("seq"), F.col("prev_x").alias("x"), F.col("prev_y").alias("y"), F.col("prev_cum").alias("cum"))
    nearer = lambda k: F.when(F.col("prev_cum").isNotNull() & (F.abs(F.col("prev_cum") - at(k)) < F.abs(F.col("cum") - at(k))), prev).otherwise(here)
    found = rows.select(*KEY, F.explode(F.transform(ks, lambda k: F.struct(k.alias("k"), nearer(k).alias("p")))).alias("s")).select(*KEY, "s.k", "s.p.*")
    ends = rows.filter(last).groupBy(*KEY).agg(F.max_by(here, "seq").alias("p"), F.max("m").alias("k")).select(*KEY, F.col("k").cast("bigint").alias("k"), "p.*")
    order = Window.partitionBy(*KEY).orderBy("k")
    every = found.unionByName(ends).withColumns({c: F.lag(n).over(order) for c, n in (("_x", "x"), ("_y", "y"), ("_c", "cum"))})
    same = (F.abs(F.col("cum") - F.col("_c")) <= NO_LENGTH) & (F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")) <= NO_LENGTH)
    return every.filter(~F.coalesce(same, F.lit(False))).select(*KEY, "k", "x", "y", "cum")


def proximity(points: DataFrame, near: float = NEAR, most: int = CELL_ROWS) -> DataFrame:
    """Pairs of samples of two tracks of a campaign, at most ``near`` metres apart.

    One side is copied to the nine cells around it, then cells are joined. Cells where a
    side has more than ``most`` rows are found first, and both sides of these dealt to
    parts: a row goes to its own part and meets every part of the other side, so no task
    has more than about ``most`` by ``most`` rows of a cell that many tracks share.
    """
    cell = lambda c: F.floor(F.col(c) / near)
    around = F.array(*[F.struct((cell("x") + dx).alias("cx"), (cell("y") + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    known = points.select("campaign", F.col("source_idx").alias("known"), F.col("k").alias("known_k"), F.col("cum").alias("known_cum"), F.col("x").alias("kx"), F.col("y").alias("ky"), cell("x").alias("cx"), cell("y").alias("cy"))
    other = points.select("campaign", F.col("source_idx").alias("unknown"), F.col("k").alias("unknown_k"), F.col("cum").alias("unknown_cum"), "x", "y", F.explode(around).alias("c")).select("*", "c.cx", "c.cy").drop("c")
    key = ["campaign", "cx", "cy"]
    size = known.groupBy(*key).agg(F.count("*").alias("n_known")).join(other.groupBy(*key).agg(F.count("*").alias("n_other")), key)
    parts = lambda n: F.ceil(F.col(n) / most).cast("int")
    heavy = checkpointed(size.filter((F.col("n_known") > most) | (F.col("n_other") > most)).select(*key, parts("n_known").alias("known_parts"), parts("n_other").alias("other_parts")))
    # At most a row for each ``most`` rows.
    heavy = F.broadcast(heavy) if heavy.count() <= BROADCAST_ROWS else heavy

    def dealt(side: DataFrame, own: str, across: str, names: list[str]) -> DataFrame:
        """Each row in its own part, once for each part of the other side."""
        every = F.sequence(F.lit(0), F.coalesce(across, F.lit(1)) - 1)
        mine = F.pmod(F.xxhash64(*names), F.coalesce(own, F.lit(1))).cast("int")
        met = side.join(heavy, key, "left").withColumns({own.replace("parts", "part"): mine, across.replace("parts", "part"): F.explode(every)})
        return met.drop("known_parts", "other_parts")

    left = dealt(known, "known_parts", "other_parts", ["known", "known_k"])
    right = dealt(other, "other_parts", "known_parts", ["unknown", "unknown_k"])
    # Pairs outnumber the samples by far, so partitions aren't to be made few by the samples' size.
    by = [*key, "known_part", "other_part"]
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.repartition(tasks, *by).join(right.repartition(tasks, *by), by).filter("known <> unknown").filter(F.hypot(F.col("kx") - F.col("x"), F.col("ky") - F.col("y")) <= near)
    return pairs.select("campaign", "known", "unknown", "known_k", "unknown_k", "known_cum", "unknown_cum")


def alignment(pairs: DataFrame, track_table: DataFrame, points: DataFrame, near: float = NEAR) -> DataFrame:
    """Offset of every ordered pair of tracks in both relative directions, where they match.

    offset is the median of known minus unknown distance over the sample pairs, mad
    its median absolute deviation. A pair needs two distinct samples on both sides
    (one, if a track has one) and a mad of at most ``near``. Sample pairs are written
    once; medians count them in ranges and gather none of them.
    """
    length = track_table.select("campaign", F.col("source_idx").alias("unknown"), F.col("length").alias("unknown_length"))
    length = F.broadcast(length) if track_table.count() <= BROADCAST_ROWS else length  # a row a track
    both = written(pairs, "sample-pairs").join(length, ["campaign", "unknown"]).select(
        "*", F.explode(F.array(F.lit(False), F.lit(True))).alias("reversed")
    ).withColumn("delta", F.col("known_cum") - F.when(F.col("reversed"), F.col("unknown_length") - F.col("unknown_cum")).otherwise(F.col("unknown_cum")))
    key = ["campaign", "known", "unknown", "reversed"]
    several = lambda c: F.min(c) < F.max(c)
    counts = both.groupBy(*key).agg(F.count("*").alias("n"), F.min("delta").alias("lo"), F.max("delta").alias("hi"), several("known_k").alias("known_more"), several("unknown_k").alias("unknown_more"))
    sizes = points.groupBy("campaign", "source_idx").agg(F.count("*").alias("size"))
    side = lambda name: sizes.select("campaign", F.col("source_idx").alias(name), F.col("size").alias(f"{name}_size"))
    counts = counts.join(side("known"), ["campaign", "known"]).join(side("unknown"), ["campaign", "unknown"])
    enough = (F.least("known_size", "unknown_size") < 2) | (F.col("known_more") & F.col("unknown_more"))
    counts = checkpointed(counts.filter(enough).select(*key, "n", "lo", "hi"))
    middle = checkpointed(medians(both, key, "delta", "offset", counts).join(counts, key))
    held = F.broadcast(middle) if middle.count() <= BROADCAST_ROWS else middle
    spread = both.join(held.select(*key, "offset"), key).withColumn("off", F.abs(F.col("delta") - F.col("offset")))
    bounds = middle.select(*key, F.lit(0.0).alias("lo"), F.greatest(F.abs(F.col("lo") - F.col("offset")), F.abs(F.col("hi") - F.col("offset"))).alias("hi"), "n")
    out = middle.join(medians(spread, key, "off", "mad", bounds), key)
    return out.filter(F.col("mad") <= near).select(*key, "offset", "n", "mad")


def on_route(cum: DataFrame, placed: DataFrame) -> DataFrame:
    """``cum`` with ``distance`` on the common route, and that of the previous point."""
    rows = cum.join(tracks(cum).select(*KEY, "length"), KEY).join(placed, KEY)
    at = lambda c: F.when(F.col("reversed"), F.col("length") - F.col(c)).otherwise(F.col(c)) + F.col("offset")
    return rows.withColumns({"distance": at("cum"), "prev_distance": at("prev_cum")}).drop("length", "reversed", "offset")


def single(cum: DataFrame) -> DataFrame:
    """A lone track is its own route."""
    return cum.withColumns({"distance": F.col("cum"), "prev_distance": F.col("prev_cum")})


def crossed(size: float) -> Column:
    """array<struct<id, x, y>> of the segment starts inside a step, empty if it crosses no boundary.

    A step has x, y, distance and the same of its previous point.
    """
    low, high = F.least("prev_distance", "distance"), F.greatest("prev_distance", "distance")
    first, last = segment_id(low, size) + 1, segment_id(high, size)

    def start(k: Column) -> Column:
        share = (k * size - F.col("prev_distance")) / (F.col("distance") - F.col("prev_distance"))
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))
        at = lambda c: F.col(f"prev_{c}") + (F.col(c) - F.col(f"prev_{c}")) * share
        return F.struct(k.alias("id"), at("x").alias("x"), at("y").alias("y"))

    none = F.array().cast("array<struct<id:bigint,x:double,y:double>>")
    return F.coalesce(F.when(first <= last, F.transform(F.sequence(first, last), start)), none)


def segment_starts(route: DataFrame, size: float) -> DataFrame:
    """(campaign, segment_id, x, y): where each measured segment begins.

    The first crossing in track order counts; a segment that no step enters begins at
    its first point. One pass: every point offers its step's crossings and itself.
    """
    entered = F.transform(crossed(size), lambda c: F.struct(c["id"].alias("id"), F.lit(0).alias("p"), c["x"].alias("x"), c["y"].alias("y")))
    own = F.struct(segment_id(F.col("distance"), size).alias("id"), F.lit(1).alias("p"), F.col("x").alias("x"), F.col("y").alias("y"))
    every = route.select("campaign", "source_idx", "seq", F.explode(F.concat(entered, F.array(own))).alias("o"))
    first = F.min_by(F.struct("o.x", "o.y"), F.struct("o.p", "source_idx", "seq"))
    return every.groupBy("campaign", F.col("o.id").alias("segment_id")).agg(first.alias("s")).select("campaign", "segment_id", "s.x", "s.y")


def gap_segments(route: DataFrame, size: float, strip: float = 10_000.0) -> DataFrame:
    """Starts of segments that lie between neighbouring points of the whole route but inside no track.

    All points are taken by distance. Neighbours are found inside strips of the route;
    the last point before a strip comes from a table of one row a strip. Segments that
    have a start already are left out.
    """
    # Equal points add nothing between neighbours, so each place of the route is kept once.
    points = route.select("campaign", "distance", "x", "y").distinct().withColumn("_strip", F.floor(F.col("distance") / strip))
    spot = F.struct("distance", "x", "y")
    order = Window.partitionBy("campaign", "_strip").orderBy("distance", "x", "y")
    lags = points.withColumn("_p", F.lag(spot).over(order))
    lasts = points.groupBy("campaign", "_strip").agg(F.max(spot).alias("_last"))
    lasts = lasts.withColumn("_before", F.lag("_last").over(Window.partitionBy("campaign").orderBy("_strip"))).select("campaign", "_strip", "_before")
    steps = lags.join(lasts, ["campaign", "_strip"]).withColumn("_p", F.coalesce("_p", "_before")).filter("_p is not null")
    steps = steps.withColumns({"prev_distance": F.col("_p.distance"), "prev_x": F.col("_p.x"), "prev_y": F.col("_p.y")})
    found = steps.select("campaign", "distance", "x", "y", F.explode(crossed(size)).alias("c"))
    found = found.groupBy("campaign", F.col("c.id").alias("segment_id")).agg(F.min_by(F.struct("c.x", "c.y"), F.struct("distance", "x", "y")).alias("s"))
    known = segment_starts(route, size).select("campaign", "segment_id")
    return found.select("campaign", "segment_id", "s.x", "s.y").join(known, ["campaign", "segment_id"], "left_anti")


def common_route(df: DataFrame, size: float, most: int = SAMPLES) -> DataFrame:
    """Points of all tracks with their distance on the campaign's common route and their segment."""
    # Read five times below, so written once.
    cum = checkpointed(cumulative(df))
    table = checkpointed(tracks(cum))
    points = checkpointed(samples(cum, most))
    placed = placements(alignment(proximity(points), table, points), table)
    return on_route(cum, placed).withColumn("segment_id", segment_id(F.col("distance"), size))
