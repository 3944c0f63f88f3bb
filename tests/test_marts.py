import duckdb
import pytest

from tidemark import registry
from tidemark.plans import forecasts, seasons, series
from tidemark.sources import retail

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["K25", "K13", "K14", "K18", "K21", "K22", "K23", "K28", "Q09", "K29", "M05", "K20", "Q04", "T01", "T02", "T04", "T06", "T09", "T11", "T12", "T13", "T14", "K09", "F20", *series.CHECKS, *seasons.CHECKS])
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in retail.TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = con.execute(registry.oracle_sql()[name])
    names, want = [c[0] for c in got.description], got.fetchall()
    have = [tuple(r) for r in registry.queries()[name](spark, DIR).select(*names).collect()]
    show = lambda rows: sorted(tuple(f"{x:.4f}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert show(have) == show(want)


def test_queries_without_sql_are_fitted_ones():
    assert set(registry.queries()) - set(registry.oracle_sql()) == set(forecasts.BUILD) - {"M19"} | {"D9"}
    assert not set(registry.oracle_sql()) - set(registry.queries())
