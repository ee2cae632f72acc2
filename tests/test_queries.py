"""Every query against its SQL in DuckDB on the smallest tables, and every query without SQL for a stable schema."""

import math
import os

import duckdb
import pandas as pd
import pytest

from gleanery.plans import catalog
from gleanery.sources.adapters import INPUTS, TABLES, Inputs, with_inputs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
JOBS, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(float(v), 9) if isinstance(v, int | float) and not isinstance(v, bool) else v

    return sorted((tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(JOBS))
def test_query(spark, duck, name):
    got = JOBS[name](spark, SF).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)
    else:
        assert len(got.columns) > 1


@pytest.mark.parametrize("name", sorted(INPUTS))
def test_inputs_are_the_same_in_both_engines(spark, duck, name):
    assert getattr(Inputs(spark, SF), name).count() == duck.execute(with_inputs(f"SELECT count(*) FROM {name}")).fetchone()[0]
