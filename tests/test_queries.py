"""Every relational query against its SQL on the smallest synthetic tables."""

import glob
import math
import os

import pytest

from fringelake.plans import catalog, closures, derived, extended, files, imaged  # noqa: F401  (all add to the catalog)

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no synthetic tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLE_SQL:
        assert df.count() > 0
        return
    columns = sorted(df.columns)
    same = lambda row: tuple("nan" if isinstance(x, float) and math.isnan(x) else repr(x + 0.0) if isinstance(x, float) else repr(x) for x in row)
    own = sorted(same(r) for r in df.select(*columns).collect())
    assert own == sorted(same(r) for r in con.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({catalog.ORACLE_SQL[name]})").fetchall())
