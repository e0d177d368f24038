"""Where each track lies on its campaign's common route, by rounds over tables of tracks.

The longest track is laid down first. Tracks are then gone through again and again in
their order, each laid down by the best of its matches with tracks that lie already;
those that match none follow in order, joined to the nearest end of any that lies.

The turns of that reading are found without walking it. A track's pass is the least over
its matches of the match's pass, plus one if the match comes later in the order; so
passes spread from the longest track in rounds, each from the tracks that changed last.
Passes settle who lay before whom, hence each track's parent: its best match before it,
or its nearest end. How a track lies is a function of whether its parent is reversed,
and such functions are chained along the parents in a logarithmic number of rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import checkpointed

KEY = ["campaign", "source_idx"]
#: Metres of the first and finest cells in which ends look for the nearest other end, how much coarser each next round is, and where it stops.
FINEST, COARSER, COARSEST = 0.125, 32, 1e9


def _passes(tracks: DataFrame, matches: DataFrame) -> DataFrame:
    """(campaign, source_idx, pass) of the tracks that matches lead to; 0 for the longest track."""
    longest = tracks.groupBy("campaign").agg(F.max_by("source_idx", F.struct("length", -F.col("source_idx"))).alias("source_idx"))
    known = checkpointed(longest.select(*KEY, F.lit(0).alias("pass")))
    edges = checkpointed(matches.select("campaign", "known", F.col("unknown").alias("source_idx")).distinct())
    changed = known
    while True:
        near = changed.select("campaign", F.col("source_idx").alias("known"), "pass")
        # Tracks after a track in the order can follow it in the same pass, but for the first one's.
        step = F.when((F.col("pass") > 0) & (F.col("known") < F.col("source_idx")), 0).otherwise(1)
        offered = edges.join(near, ["campaign", "known"]).groupBy(*KEY).agg(F.min(F.col("pass") + step).alias("pass"))
        better = offered.join(known.withColumnRenamed("pass", "now"), KEY, "left").filter("now is null or pass < now")
        changed = checkpointed(better.select(*KEY, "pass"))
        if not changed.limit(1).count():
            return known
        known = checkpointed(known.unionByName(changed).groupBy(*KEY).agg(F.min("pass").alias("pass")))


def _moves(turned: Column, shift: Column, turned_if: Column, shift_if: Column) -> list[Column]:
    """How a track lies: whether reversed and by how far after its parent, if that is not reversed, and if it is."""
    return [turned.alias("turned_0"), shift.alias("shift_0"), turned_if.alias("turned_1"), shift_if.alias("shift_1")]


def _matched(tracks: DataFrame, matches: DataFrame, passes: DataFrame) -> DataFrame:
    """Parents and moves by matches: of the matches that lay before, the one of most sample pairs, then least spread, then first in order."""
    of = lambda c, r: F.max(F.when(F.col("reversed") == r, F.col(c)))
    both = matches.groupBy("campaign", "known", "unknown").agg(F.max("n").alias("n"), of("mad", False).alias("mad_0"), of("mad", True).alias("mad_1"), of("offset", False).alias("at_0"), of("offset", True).alias("at_1"))
    turn = lambda name, to: passes.select("campaign", F.col("source_idx").alias(name), F.col("pass").alias(to))
    met = both.join(turn("known", "known_pass"), ["campaign", "known"]).join(turn("unknown", "own_pass"), ["campaign", "unknown"])
    before = met.filter("own_pass > 0 and (known_pass < own_pass or (known_pass = own_pass and known < unknown))")
    mad = F.least("mad_0", "mad_1")  # of those there are
    # Equally good ways round are both kept: the one that is not reversed on the route is taken.
    offer = F.struct((-F.col("n")).alias("n"), mad.alias("mad"), "known", *[F.when(F.col(f"mad_{r}") == mad, F.col(f"at_{r}")).alias(f"at_{r}") for r in (0, 1)])
    best = before.groupBy("campaign", "unknown").agg(F.min(offer).alias("o")).select("campaign", F.col("unknown").alias("source_idx"), F.col("o.known").alias("parent"), "o.at_0", "o.at_1")
    size = lambda key, name: tracks.select("campaign", F.col("source_idx").alias(key), F.col("length").alias(name))
    best = best.join(size("source_idx", "own"), KEY).join(size("parent", "known"), ["campaign", "parent"])
    turned_0, turned_1 = F.col("at_0").isNull(), F.col("at_1").isNull()
    back = lambda at: F.col("known") - F.col("own") - at
    return best.select(*KEY, "parent", *_moves(turned_0, F.coalesce("at_0", "at_1"), turned_1, back(F.coalesce("at_1", "at_0"))))


def nearest_ends(tracks: DataFrame, lying: DataFrame) -> DataFrame:
    """(campaign, source_idx, parent): for each track not in ``lying``, whose end is nearest to one of its own: a track in ``lying`` or one before it in the order.

    Of equal ones the first in order counts. Ends at one place are one row with the first
    track that lies and the first that doesn't. Cells get coarser from round to round, and
    only tracks go on that found none as near as a cell is wide; these are far
    from one another, so few share a cell.
    """
    ends = tracks.select(*KEY, F.explode(F.array("first", "last")).alias("e")).select(*KEY, "e.x", "e.y")
    ends = ends.join(lying.select(*KEY, F.lit(True).alias("lies")), KEY, "left").withColumn("lies", F.coalesce("lies", F.lit(False)))
    ends = checkpointed(ends)
    first = lambda lies: F.min(F.when(F.col("lies") == lies, F.col("source_idx")))
    places = checkpointed(ends.groupBy("campaign", "x", "y").agg(first(True).alias("old"), first(False).alias("new")))
    own = checkpointed(ends.filter("not lies").select(*KEY, F.col("x").alias("ox"), F.col("y").alias("oy")).distinct().withColumn("parent", F.lit(None).cast("int")))
    cell, found = FINEST, []
    while own.filter("parent is null").limit(1).count() and cell < COARSEST:
        at = lambda c: F.floor(F.col(c) / cell)  # noqa: B023, E731
        around = F.array(*[F.struct((at("ox") + dx).alias("cx"), (at("oy") + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
        own = own.filter("parent is null").drop("parent")
        asked = own.withColumn("c", F.explode(around)).select(*KEY, "ox", "oy", "c.cx", "c.cy")
        met = asked.join(places.withColumns({"cx": at("x"), "cy": at("y")}), ["campaign", "cx", "cy"])
        met = met.withColumn("parent", F.least("old", F.when(F.col("new") < F.col("source_idx"), F.col("new")))).filter("parent is not null")
        gap = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
        best = met.groupBy(*KEY).agg(F.min(F.struct(gap.alias("gap"), "parent")).alias("b")).filter(F.col("b.gap") <= cell)
        own = checkpointed(own.join(best.select(*KEY, F.col("b.parent").alias("parent")), KEY, "left"))
        found.append(own.filter("parent is not null").select(*KEY, "parent").distinct())
        cell *= COARSER
    return reduce(DataFrame.unionAll, found) if found else ends.filter("false").select(*KEY, F.col("source_idx").alias("parent"))


def _joined(tracks: DataFrame, parents: DataFrame) -> DataFrame:
    """Parents and moves by ends: the track begins where its parent ends on the route, or ends where that begins, a gap apart."""
    as_known = tracks.select("campaign", F.col("source_idx").alias("parent"), F.col("length").alias("known"), F.col("first").alias("ka"), F.col("last").alias("kb"))
    met = parents.join(tracks.select(*KEY, F.col("length").alias("own"), F.col("first").alias("oa"), F.col("last").alias("ob")), KEY).join(as_known, ["campaign", "parent"])
    gap = lambda k, o: F.hypot(F.col(f"{k}.x") - F.col(f"{o}.x"), F.col(f"{k}.y") - F.col(f"{o}.y"))

    def best(low: str, high: str) -> Column:
        """Of the ways to join the parent's lower or higher end: by gap, then not reversed, then at the lower end."""
        ways = []
        for turned, first, last in ((False, "oa", "ob"), (True, "ob", "oa")):
            for side, g in ((0, gap(low, last)), (1, gap(high, first))):
                shift = F.col("known") + g if side else -F.col("own") - g
                ways.append(F.struct(g.alias("gap"), F.lit(turned).alias("turned"), F.lit(side).alias("side"), shift.alias("shift")))
        return F.least(*ways)

    met = met.withColumn("w0", best("ka", "kb"))
    met = met.withColumn("w1", F.when(F.col("known") == 0, F.col("w0")).otherwise(best("kb", "ka")))
    return met.select(*KEY, "parent", *_moves(F.col("w0.turned"), F.col("w0.shift"), F.col("w1.turned"), F.col("w1.shift")))


def _chained(moves: DataFrame, roots: DataFrame) -> DataFrame:
    """(campaign, source_idx, reversed, start) of every track, with the roots at 0.

    Each round goes on to the parent's parent, so their number is logarithmic in the longest chain.
    """
    still = _moves(F.lit(False), F.lit(0.0), F.lit(True), F.lit(0.0))
    state = checkpointed(moves.unionByName(roots.select(*KEY, F.col("source_idx").alias("parent"), *still)))
    top = roots.select("campaign", F.col("source_idx").alias("root"))
    while True:
        open_ = state.join(top, "campaign").filter("parent <> root").limit(1).count()
        if not open_:
            return state.select(*KEY, F.col("turned_0").alias("reversed"), F.col("shift_0").alias("start"))
        up = state.select("campaign", F.col("source_idx").alias("parent"), F.col("parent").alias("above"), *[F.col(f"{c}_{r}").alias(f"up_{c}_{r}") for c in ("turned", "shift") for r in (0, 1)])
        then = lambda c, r: F.when(F.col(f"up_turned_{r}"), F.col(f"{c}_1")).otherwise(F.col(f"{c}_0"))
        moved = [c for r in (0, 1) for c in (then("turned", r).alias(f"turned_{r}"), (F.col(f"up_shift_{r}") + then("shift", r)).alias(f"shift_{r}"))]
        state = checkpointed(state.join(up, ["campaign", "parent"]).select(*KEY, F.col("above").alias("parent"), *moved))


def placements(matches: DataFrame, tracks: DataFrame) -> DataFrame:
    """(campaign, source_idx, reversed, offset): direction and offset of every track on its campaign's route, which begins at 0.

    ``matches`` has the alignments of pairs of tracks, ``tracks`` a row a track with its length
    and ends. Tables of one row a track and a few a matching pair are all that is
    joined; no campaign is gathered. Equal lengths: the first track in order is the first laid down.
    """
    matches = checkpointed(matches)
    passes = _passes(tracks, matches)
    roots = passes.filter("pass = 0").select(*KEY)
    moves = _matched(tracks, matches, passes)
    parents = nearest_ends(tracks, passes)
    laid = _chained(moves.unionByName(_joined(tracks, parents)), roots)
    lowest = laid.groupBy("campaign").agg(F.min("start").alias("lowest"))
    return checkpointed(laid.join(lowest, "campaign").select(*KEY, "reversed", (F.col("start") - F.col("lowest")).alias("offset")))
