"""Many range rules and many windows against plain reading."""

import random

import pytest
from pyspark.sql import functions as F

from wayfield.operators import filters, rules


def by_reading(rule_list, row):
    """Name of the rule with the largest matching group, then the first name."""
    best = None
    for r in sorted(rule_list, key=lambda r: r.name):
        for g in r.groups:
            if all(row[f] is not None and (row[f] == lo if lo == hi else lo <= row[f] < hi) for f, lo, hi in g) and (best is None or len(g) > best[0]):
                best = (len(g), r.name)
    return best and best[1]


@pytest.mark.parametrize("n", [60, 10_000])
def test_many_range_rules(spark, n):
    draw = random.Random(n)

    def group():
        out = []
        for f in draw.sample(("A", "B", "C"), draw.choice((1, 1, 1, 2, 3))):
            low = draw.randrange(0, 100_000) if f == "A" else draw.randrange(0, 50)
            out.append((f, float(low), float(low + draw.choice((0, 1, 5, 40)) * (50 if f == "A" else 1)) if draw.random() < 0.98 else 1e9))
        return tuple(out)

    ranges = [rules.Rule(f"r{k:05d}", tuple(g for g in (group() for _ in range(draw.choice((1, 2)))) if n < 100 or any(lo < hi for _, lo, hi in g)), {"X": (1.0,)}) for k in range(n)]
    rows = [(k, *(draw.choice((None, "", "x")) if draw.random() < 0.05 else str(draw.randrange(-1, top)) for top in (101_000, 60, 60))) for k in range(300)]
    df = spark.createDataFrame(rows, "seq long, A string, B string, C string").withColumns({"ends_0": F.lit("e"), "numbers": F.lit("n")})
    got = {r.seq: (r.rule, r.ends_0, r.numbers) for r in rules.match(df, ranges).collect()}
    number = lambda s: float(s) if s and s != "x" else None
    assert got == {r[0]: (by_reading(ranges, dict(zip("ABC", map(number, r[1:])))), "e", "n") for r in rows}


@pytest.mark.parametrize("n", [3, 33, 100_000])
def test_many_windows(spark, n):
    draw = random.Random(n)
    windows = [(s, s + draw.choice((0, 3, 50))) for s in (draw.randrange(0, 200 * n) for _ in range(n))]
    times = [None, -5, 0, 200 * n + 60, *(draw.randrange(0, 200 * n) for _ in range(500)), *(w[i] + d for w in windows[:100] for i in (0, 1) for d in (-1, 0, 1))]
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(times)], "seq long, time_ms long, starts string")
    kept = {r.seq for r in filters.exclude_windows(df, windows).collect()}
    apart = filters.merged(windows)
    assert all(a[1] < b[0] for a, b in zip(apart, apart[1:]))
    import bisect

    starts = [a for a, _ in apart]
    inside = lambda t: t is not None and (i := bisect.bisect_right(starts, t)) > 0 and apart[i - 1][1] >= t
    assert kept == {k for k, t in enumerate(times) if not inside(t)}
    if n < 100:
        assert kept == {k for k, t in enumerate(times) if t is None or not any(a <= t <= b for a, b in windows)}
