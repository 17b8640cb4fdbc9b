"""Jobs of this subpackage that have DuckDB SQL, against it."""

from collections import Counter

import duckdb
import pytest

from tools.check_oracle import rows_of
from tracefold.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_job_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    want = con.sql(ORACLES[name])
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(want.columns)
    assert Counter(rows_of(df.columns, df.collect())) == Counter(rows_of(want.columns, want.fetchall()))
