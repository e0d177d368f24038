"""Placement of many tracks, proximity where many meet, and medians, against plain reading."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from wayfield.operators import medians, placement, route


def greedy(tracks, matches):
    """{track: (reversed, offset)} of one campaign by walking its tracks; tracks have (length, first, last), matches (known, unknown, reversed, offset, n, mad)."""
    order, length = sorted(tracks), {t: v[0] for t, v in tracks.items()}
    laid = {max(order, key=lambda t: (length[t], -t)): (False, 0.0)}
    grown = True
    while grown:
        grown = False
        for t in order:
            offers = []
            for known, unknown, rev, off, n, mad in matches:
                if t not in laid and unknown == t and known in laid:
                    turned, start = laid[known]
                    offers.append((-n, mad, known, rev != turned, start + (length[known] - length[t] - off if turned else off)))
            if offers:
                laid[t] = min(offers)[3:]
                grown = True
    for t in order:
        if t in laid:
            continue
        ways = []
        for known in sorted(laid):
            turned, start = laid[known]
            _, a, b = tracks[known]
            low, high = (b, a) if turned and length[known] else (a, b)
            for own_turned in (False, True):
                first, last = (tracks[t][2], tracks[t][1]) if own_turned else tracks[t][1:]
                for side, (k, o) in enumerate(((low, last), (high, first))):
                    gap = math.hypot(k[0] - o[0], k[1] - o[1])
                    ways.append((gap, known, own_turned, side, start + length[known] + gap if side else start - length[t] - gap))
        best = min(ways)
        laid[t] = (best[2], best[4])
    lowest = min(start for _, start in laid.values())
    return {t: (turned, start - lowest) for t, (turned, start) in laid.items()}


def campaigns(seed, sizes):
    """Tracks with ends in clusters and a depot, and matches of some of them, some equally good both ways."""
    draw, every = random.Random(seed), {}
    for c, size in enumerate(sizes):
        ids = draw.sample(range(5 * size), size)
        spot = lambda: draw.choice(((0.0, 0.0), (draw.gauss(0, 3), draw.gauss(0, 3)), (draw.uniform(-9e4, 9e4), draw.uniform(-9e4, 9e4))))  # noqa: B023, E731
        tracks = {t: (float(draw.choice((0, 50, draw.randrange(1, 9000)))), spot(), spot()) for t in ids}
        matches = []
        for _ in range(size):
            known, unknown = draw.choice(ids), draw.choice(ids)
            if known != unknown and not any(m[:2] == (known, unknown) for m in matches[-50:]):
                n, mad = draw.randrange(2, 5), float(draw.randrange(3))
                for rev in draw.choice(((False,), (True,), (False, True))):
                    matches.append((known, unknown, rev, draw.uniform(-500, 500), n, draw.choice((mad, 2.5))))
        every[c] = (tracks, list({m[:3]: m for m in matches}.values()))
    return every


def test_a_thousand_tracks_as_by_walking(spark):
    every = campaigns(3, (1000, 1, 40, 7))
    point = "struct<x: double, y: double>"
    tracks = spark.createDataFrame([(c, t, *v) for c, (ts, _) in every.items() for t, v in ts.items()], f"campaign int, source_idx int, length double, first {point}, last {point}")
    matches = spark.createDataFrame([(c, *m) for c, (_, ms) in every.items() for m in ms], "campaign int, known int, unknown int, reversed boolean, offset double, n long, mad double")
    got = {c: {} for c in every}
    for r in placement.placements(matches, tracks).collect():
        got[r.campaign][r.source_idx] = (r.reversed, r.offset)
    for c, (ts, ms) in every.items():
        want = greedy(ts, ms)
        assert set(got[c]) == set(want)
        for t, (turned, offset) in want.items():
            assert got[c][t][0] == turned and got[c][t][1] == pytest.approx(offset, abs=1e-6)


def test_tracks_without_matches_or_rows(spark):
    point = "struct<x: double, y: double>"
    tracks = spark.createDataFrame([(0, 4, 10.0, (0.0, 0.0), (10.0, 0.0)), (0, 5, 10.0, (13.0, 4.0), (23.0, 4.0))], f"campaign int, source_idx int, length double, first {point}, last {point}")
    none = spark.createDataFrame([], "campaign int, known int, unknown int, reversed boolean, offset double, n long, mad double")
    assert sorted(tuple(r) for r in placement.placements(none, tracks).collect()) == [(0, 4, False, 0.0), (0, 5, False, 15.0)]
    assert not placement.placements(none, tracks.filter("false")).count()


@pytest.mark.parametrize("most", [2000, 25])
def test_proximity_at_a_shared_depot(spark, most):
    """A cell where all tracks meet gives each pair once, and no task all of them."""
    draw = random.Random(5)
    rows = [(0, s, k, float(k), draw.uniform(0, 70), draw.uniform(0, 70)) for s in range(12) for k in range(30)] + [(0, s, 100 + k, 0.0, draw.uniform(-900, 900), draw.uniform(-900, 900)) for s in range(12) for k in range(10)] + [(1, 3, 0, 0.0, 10.0, 10.0)]
    points = spark.createDataFrame(rows, "campaign int, source_idx int, k long, cum double, x double, y double")
    found = route.proximity(points, 75.0, most)
    got = [tuple(r) for r in found.select("campaign", "known", "unknown", "known_k", "unknown_k").collect()]
    want = {(a[0], a[1], b[1], a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and math.hypot(a[4] - b[4], a[5] - b[5]) <= 75}
    assert len(got) == len(set(got)) and set(got) == want
    if most == 25:
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 0.8 * len(got)


@pytest.mark.parametrize("bins,few", [(1024, 4096), (32, 12)])
def test_medians(spark, bins, few):
    draw = random.Random(9)
    groups = {g: [draw.choice((draw.gauss(0, 10 ** draw.randrange(-6, 7)), float(draw.randrange(4)), -0.125)) for _ in range(n)] for g, n in enumerate((1, 2, 3, 4, 10, 101, 500, 1000))}
    groups |= {20: [7.5] * 300, 21: [0.0] * 50 + [1e9], 22: [1.0, 2.0] * 60, 23: [5e-324, 0.0, 1e-300]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [(1, None), (99, None)], "g int, v double").repartition(5)
    got = {r.g: r.m for r in medians.medians(df, ["g"], "v", "m", bins=bins, few=few).collect()}
    assert got == {g: pytest.approx(statistics.median(vs), rel=1e-12) for g, vs in groups.items()}
    assert not medians.medians(df.filter("false"), ["g"], "v", "m").count()
