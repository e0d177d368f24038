"""Common routes of a few tracks on plain coordinates."""

import pytest
from pyspark.sql import functions as F

from wayfield.operators import route


def segments(spark, tracks, size=100.0):
    rows = [(s, k, float(x), float(y)) for s, points in enumerate(tracks) for k, (x, y) in enumerate(points)]
    df = spark.createDataFrame(rows, "source_idx int, seq long, x double, y double")
    out = route.common_route(df, size) if len(tracks) > 1 else route.single(route.cumulative(df)).withColumn("segment_id", route.segment_id(F.col("distance"), size))
    got = {(r.source_idx, r.seq): r.segment_id for r in out.collect()}
    return [[got[s, k] for k in range(len(points))] for s, points in enumerate(tracks)], out


def test_shared_part_has_equal_ids(spark):
    (a, b), _ = segments(spark, [[(0, 0), (100, 0), (200, 0)], [(100, 8), (200, 8), (300, 8), (400, 8)]])
    assert a[1:] == b[:2]
    assert b[2] - b[1] == 1 and b[3] - b[2] == 1


def test_opposite_direction(spark):
    (a, b), _ = segments(spark, [[(0, 0), (100, 0), (200, 0)], [(200, 6), (100, 6), (0, 6)]])
    assert a == b[::-1]


def test_gap_between_ends(spark):
    (a, b), out = segments(spark, [[(0, 0), (100, 0)], [(600, 0), (700, 0)]])
    assert b[0] - a[1] == 5
    filled = {r.segment_id for r in route.gap_segments(out, 100.0).collect()}
    assert filled == set(range(a[1] + 1, b[0]))


def test_reversed_continuation(spark):
    (a, b), _ = segments(spark, [[(0, 0), (100, 0)], [(300, 0), (200, 0)]])
    assert a + b == [0, 1, 3, 2]


def test_order_of_files_keeps_distances(spark):
    one, two = [(0, 0), (100, 0), (200, 0)], [(100, 8), (200, 8), (300, 8), (400, 8)]
    (a, b), _ = segments(spark, [one, two])
    (c, d), _ = segments(spark, [two, one])
    flat, other = a + b, d + c
    assert [abs(x - y) for x in flat for y in flat] == [abs(x - y) for x in other for y in other]


def test_standing_still_gives_few_samples(spark):
    rows = [(0, k, 0.0, 0.0) for k in range(100)] + [(0, 100, 100.0, 0.0), (0, 101, 200.0, 0.0)]
    df = spark.createDataFrame(rows, "source_idx int, seq long, x double, y double")
    assert route.samples(route.cumulative(df)).count() == 3


def test_meeting_in_one_point_is_no_overlap(spark):
    a = [(0, 0), (500, 0), (1000, 0)]
    b = [(1000, 0)] * 5 + [(1000, 500), (1000, 1000)]
    (x, y), _ = segments(spark, [a, b])
    assert not set(x[:-1]) & set(y[5:])


def test_three_placed_by_chunks_alike(spark):
    rows = [(0, k, 3.0 * k, 4.0 * k) for k in range(50)]
    df = spark.createDataFrame(rows, "source_idx int, seq long, x double, y double").repartition(5)
    for chunk in (7, 50, 1000):
        got = {r.seq: (r.cum, r.prev_cum) for r in route.cumulative(df, chunk).collect()}
        assert got == {k: (5.0 * k, 5.0 * (k - 1) if k else None) for k in range(50)}


@pytest.mark.parametrize("size", [50.0])
def test_boundaries_inside_a_long_step(spark, size):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 208.357, 0.0)], "source_idx int, seq long, x double, y double")
    starts = {r.segment_id: round(r.x, 6) for r in route.segment_starts(route.single(route.cumulative(df)), size).collect()}
    assert starts == {0: 0.0, 1: 50.0, 2: 100.0, 3: 150.0, 4: 200.0}
