import math
from pathlib import Path

import duckdb
import pytest

from factlane.plans.tables import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    return ("%.6g" % x) if isinstance(x, float) and not math.isnan(x) else str(x)


@pytest.mark.parametrize("name", QUERIES)
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in got.fetchall())
    have = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert have == want and have
