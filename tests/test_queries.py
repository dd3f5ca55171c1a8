"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lettermill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "~"
    if isinstance(v, float):
        # A whole number in a column with nulls is a float in pandas.
        return str(int(v)) if v.is_integer() else repr(round(v, 9) + 0.0)
    return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else str(v)


def rows(df, columns):
    return sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    sql = catalog.ORACLE_SQL.get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_left_out_categories_are_filtered_after_grouping(spark):
    """On the rows, the filter would classify every text again; and no text is shuffled to its sender's frequency."""
    plan = catalog.QUERIES["domain_distribution"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    join = next(i for i, x in enumerate(lines) if "Join LeftOuter" in x)
    assert not any("Filter" in x and "artificial intelligence" in x for x in lines)
    assert any("artificial intelligence" in x for x in lines[join:]) and not any("artificial intelligence" in x for x in lines[:join])
