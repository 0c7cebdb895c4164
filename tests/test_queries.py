"""Every core query with SQL gives the SQL's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from sangam.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def show(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
            return "None" if math.isnan(v) else f"{float(v):.8g}"
        return str(v)

    return sorted(tuple(show(r[i]) for i in order) for r in records)


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    got = df.collect()
    if name in catalogue.oracle_sql():
        cur = duck.execute(catalogue.oracle_sql()[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(got, df.columns) == rows(cur.fetchall(), columns)
