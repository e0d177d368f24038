"""The densify and route queries over all rows and with all samples."""

import bisect
import math

import pytest
from pyspark.sql import functions as F

from wayfield.operators import route
from wayfield.plans import catalog
from wayfield.sources import adapter


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_densify_reads_all_rows_and_has_gaps(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = adapter.measurements(spark, path, adapter.WIDE)
    zone = [F.floor(F.col(c) / 100) * 100 for c in ("x", "y")]
    have = rows.select(*zone, "mnc").distinct().count()
    every = rows.select(*zone).distinct().count()
    stats = catalog.QUERIES["operator_stats_dense_wide"](spark, path).collect()
    assert rows.count() == spark.read.parquet(f"{path}/events.parquet").count()
    assert len(stats) == 4 and all(r.good + r.bad == every for r in stats)
    assert have < 4 * every
    assert catalog.QUERIES["empty_zones_wide"](spark, path).count() == 4 * every - have
    assert catalog.QUERIES["custom_operators_wide"](spark, path).count() == 2 * every


def brute_samples(points, most=2000):
    """Samples of one track (x, y by seq): for each target the nearer of the points around it, then the last point."""
    cum = [0.0]
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        cum.append(cum[-1] + math.sqrt((bx - ax) ** 2 + (by - ay) ** 2))
    m, out = min(len(points), most), []
    for k in range(m):
        target = cum[-1] * k / (m - 1)
        i = bisect.bisect_left(cum, target)
        out.append((k, i - 1 if i and abs(cum[i - 1] - target) < abs(cum[i] - target) else i))
    out.append((m, len(points) - 1))
    kept = [(k, i) for n, (k, i) in enumerate(out) if not n or abs(cum[i] - cum[out[n - 1][1]]) > 1e-6]
    return [(k, *points[i], cum[i]) for k, i in kept]


@pytest.fixture(scope="module")
def long_tracks(spark, tmp_path_factory):
    """Events of few users far apart in time, so that the view's tracks are 250 km long."""
    path = tmp_path_factory.mktemp("long")
    ids = F.col("id") * 100 + F.pmod(F.xxhash64("id"), F.lit(100))
    spark.range(10_000).select(ids.alias("event_id"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(15)).alias("user_id")).coalesce(1).write.parquet(f"{path}/events.parquet")
    rows = adapter.route_points(spark, str(path)).orderBy("seq").collect()
    return str(path), {s: [(r.x, r.y) for r in rows if r.source_idx == s] for s in range(3)}


def test_route_queries_take_2000_samples(spark, long_tracks):
    path, tracks = long_tracks
    want = {s: brute_samples(p) for s, p in tracks.items()}
    got = {(r.source_idx, r.k): (r.x, r.y) for r in catalog.QUERIES["track_samples_full"](spark, path).collect()}
    assert got == {(s, k): (x, y) for s, v in want.items() for k, x, y, _ in v}
    assert all(len(v) > 1000 for v in want.values())
    pairs = {
        (a, b, k, n) for a in range(3) for b in range(3) if a != b
        for k, ax, ay, _ in want[a] for n, bx, by, _ in want[b] if abs(ax - bx) <= 75 and math.hypot(ax - bx, ay - by) <= 75
    }
    found = {tuple(r) for r in catalog.QUERIES["track_proximity_full"](spark, path).collect()}
    assert found == pairs
    assert {(0, 1), (1, 0)} <= {(r.known, r.unknown) for r in catalog.QUERIES["track_alignment_full"](spark, path).collect()}


def test_placement_takes_2000_samples(spark, long_tracks):
    path, _ = long_tracks
    placed = catalog.QUERIES["track_placement"](spark, path)
    whole = route.common_route(adapter.route_points(spark, path), catalog.SIZE)
    assert placed.select("source_idx", "seq", "segment_id").exceptAll(whole.select("source_idx", "seq", "segment_id")).isEmpty()
    fewer = route.common_route(adapter.route_points(spark, path), catalog.SIZE, 200)
    assert not placed.select("source_idx", "seq", "segment_id").exceptAll(fewer.select("source_idx", "seq", "segment_id")).isEmpty()


def test_placement_keeps_every_track_that_matches_none_laid_down(spark, tmp_path):
    """Two tracks match each other but not the longest: both are joined by ends, in order."""
    ids = {0: range(400, 54_401, 3000), 1: range(0, 60_001, 3000), 2: range(8600, 59_601, 3000)}
    spark.createDataFrame([(i, s) for s, own in ids.items() for i in own], "event_id long, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.source_idx, r.seq): (r.distance, r.segment_id) for r in catalog.QUERIES["track_placement"](spark, str(tmp_path)).collect()}
    gap = math.hypot(900, 8)
    at = {0: lambda i: 13_500 - (i / 4 - 100), 1: lambda i: 13_500 + gap + i / 4, 2: lambda i: 13_416 + (60_000 - i) / 4}
    want = {(s, i): at[s](i) for s, own in ids.items() for i in own}
    assert {k: v[0] for k, v in got.items()} == pytest.approx(want, abs=1e-6)
    assert {k: v[1] for k, v in got.items()} == {k: math.floor((v + 1e-9) / 100) for k, v in want.items()}
