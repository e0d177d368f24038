"""Every registered query of the coverage operators against its SQL on the small tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from wayfield.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
        if isinstance(v, bool) or v is None:
            return repr(v)
        return repr(float(v)) if isinstance(v, int) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows), sorted(columns)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in catalog.ORACLES:
        want = duck.execute(catalog.ORACLES[name])
        names = [c[0] for c in want.description]
        expected, columns = canon(want.fetchall(), names)
        found, own = canon(got, df.columns)
        assert own == columns
        assert found == expected
