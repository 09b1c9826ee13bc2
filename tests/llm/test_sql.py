import math

import duckdb
import pytest

from factlane.llm import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.execute(registry.SQL[name])
    columns = [c[0] for c in got.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    plain = lambda row: tuple(round(x, 9) if isinstance(x, float) and math.isfinite(x) else x for x in row)
    assert sorted(map(plain, got.fetchall())) == sorted(plain([r[c] for c in columns]) for r in df.collect())
