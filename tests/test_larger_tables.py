"""Queries on tables whose keys are larger than those of the test data, against DuckDB."""

import duckdb
import pytest
from test_registry import SF, TABLES, rows, same

from plumbline.plans import registry


@pytest.fixture(scope="module")
def larger(tmp_path_factory):
    """The smallest tables with lines of parts beyond 100,000, as six times sf0.1 has them."""
    folder = tmp_path_factory.mktemp("larger")
    con = duckdb.connect()
    for t in TABLES:
        shifted = "* REPLACE (l_partkey + 120000 AS l_partkey)" if t == "lineitem" else "*"
        con.sql(f"COPY (SELECT {shifted} FROM '{SF}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["t21_trust_rounds"])
def test_same_as_sql(spark, larger, name):
    folder, duck = larger
    got, want = registry.queries()[name](spark, folder), duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    assert all(same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))
