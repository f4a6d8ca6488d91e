"""Every query of the reference's kind against its SQL, on the small tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from lodestrum.plans import catalog, conditioning, extended, files, further, parameters, ranking, selection, statistics  # noqa: F401 (they register their queries in catalog)

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [tuple(canon(x) for x in r) for r in df.select(*sorted(df.columns)).collect()]
    if name not in catalog.ORACLES:
        assert got
        return
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = [tuple(canon(x) for x in r) for r in rel.project(",".join(f'"{c}"' for c in sorted(rel.columns))).fetchall()]
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", ["time_coincidence", "slide_coincidence", "multi_coincidence", "found_injections", "times_in_segments", "state_at_time"])
def test_no_nested_loop(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
