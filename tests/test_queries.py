"""Every registered query against DuckDB on the smallest tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry_points  # noqa: E402
from runlake.plans.catalogue import QUERIES  # noqa: E402
from runlake.plans.oracles import ORACLES  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="shared tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def cells(row):
    return tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in row)


def ordered(rows):
    return sorted(map(cells, rows), key=lambda r: [(v is None, str(v)) for v in r])


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    found = QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    expected = duck.execute(ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = ordered(tuple(r[i] for i in places) for r in expected.fetchall())
    got = ordered(tuple(r) for r in found.select(*[f"`{c}`" for c in columns]).collect())
    assert len(got) == len(want) > 0
    for mine, theirs in zip(got, want):
        for a, b in zip(mine, theirs):
            assert a == b or (isinstance(a, float) and a == pytest.approx(b, abs=1e-7))


def test_flagship(spark):
    wide = entry_points.entry(spark)
    assert wide.columns[:3] == ["run_id", "timestamp", "elapsed_h"] and wide.count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"divergence_of_all"}))
def test_plans_have_no_python_and_no_pairing(spark, name):
    plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert word not in plan
