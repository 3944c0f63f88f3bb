"""Ingest contracts, pages and families: against SQL, and their edges."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.plans import pages
from tidemark.reports import families
from tidemark.reports.page import Page
from tidemark.sources import ingest, retail

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for t in retail.TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [*pages.FROM_SERIES, *pages.FROM_TABLES])
def test_against_sql(spark, views, name):
    show = lambda rows: sorted(tuple(f"{x:.4f}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    got = views.execute(registry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert show(registry.queries()[name](spark, DIR).select(*names).collect()) == show(got.fetchall())


def test_contract(spark, tmp_path):
    root = tmp_path.as_uri()
    spark.createDataFrame([(1, "x", 2)], "ID int, `Customer Name` string, extra int").write.option("header", True).csv(f"{root}/a_new.csv")
    spark.createDataFrame([(7,)], "other int").write.parquet(f"{root}/b.parquet")
    a = ingest.Table("a", ("a_old.csv", "a_new.csv", "b.parquet"), (("id", "key"), ("name", "customer name")))
    got = ingest.load(spark, root, [a])
    assert got.frames["a"].columns == ["id", "name", "extra"] and got.files == {"a": "a_new.csv"}
    assert [tuple(r) for r in got.report().collect()] == [("a", 1, "a_new.csv")]
    gone = ingest.Table("gone", ("no.csv", "no.parquet"))
    with pytest.warns(UserWarning, match="gone"):
        assert ingest.load(spark, root, [a, gone]).skipped == ("gone",)
    with pytest.raises(ingest.ContractError, match="no file for gone"):
        ingest.load(spark, root, [a, gone], strict=True)
    lacking = [ingest.Table("a", ("a_new.csv",), (("day", "date"), ("id",))), ingest.Table("b", ("b.parquet",), (("id", "key"),))]
    with pytest.raises(ingest.ContractError) as e:  # all that is missing, at once
        ingest.load(spark, root, lacking)
    assert "a (a_new.csv): day or date" in str(e.value) and "b (b.parquet): id or key" in str(e.value)


def test_two_names_of_one_group(spark):
    df = spark.createDataFrame([(1, 2)], "KEY int, Id int")
    got, missing = ingest.agreed(df, ingest.Table("t", (), (("id", "key"),)))
    assert not missing and [tuple(r) for r in got.collect()] == [(1, 2)] and got.columns == ["KEY", "Id"] or got.columns == ["KEY", "id"]


def test_modelling_frame_and_slice(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1 + i), i, None) for i in reversed(range(9))], "sales_date date, n int, m long")
    got = ingest.modelling_frame(df, ["sales_date"])
    assert [r.n for r in got.collect()] == [float(i) for i in range(9)] and dict(got.dtypes)["m"] == "double"
    with pytest.raises(ingest.ContractError):
        ingest.modelling_frame(df.limit(0), ["sales_date"])
    assert ingest.training_slice(df, dt.date(2020, 1, 5), least=5).count() == 5 and ingest.training_slice(df, None).count() == 9
    for start, least in ((dt.date(2020, 1, 5), 6), (dt.date(2019, 1, 1), 1), (dt.date(2021, 1, 1), 1)):
        with pytest.raises(ingest.ContractError):
            ingest.training_slice(df, start, least=least)


def test_forecast_file(spark, tmp_path):
    good = spark.createDataFrame([(dt.date(2020, 1, 1), 1.5, 2.0), (dt.date(2020, 1, 2), 1e-9, 0.0)], "sales_date date, revenue double, cogs double")
    path = (tmp_path / "good").as_uri()
    ingest.write_forecast(good, path)
    r = ingest.check_forecast(spark, path).head()
    assert (r.n_rows, r.columns_match, r.valid, r.null_date) == (2, True, True, 0)
    good.withColumn("revenue", F.lit(None).cast("double")).selectExpr("sales_date as Date", "cogs as COGS", "revenue as Revenue").write.option("header", True).csv((tmp_path / "bad").as_uri())
    r = ingest.check_forecast(spark, (tmp_path / "bad").as_uri()).head()
    assert (r.columns_match, r.valid, r.null_revenue) == (False, False, 2)


def test_page(spark):
    calls = []

    def twice(base):
        calls.append(1)
        return base.withColumn("y", F.col("x") * 2)

    tables = {"t": spark.createDataFrame([(i, f"n{i % 3}", dt.date(2020, 1, 1 + i)) for i in range(10)], "x int, name string, day date")}
    queries = {
        "base": "select * from {t} where day between :range_start and :range_end and array_contains(:names, name)",
        "doubled": twice, "sums": "select name, sum(y) as s from {doubled} group by name", "top": "select max(s) as best from {sums}", "all": "select * from {sums} cross join {top}",
    }
    page = Page(spark, tables, queries, {"range": (dt.date(2020, 1, 2), dt.date(2020, 1, 9)), "names": ["n0", "n1"]})
    got = page.run("all")["all"].collect()
    assert {(r.name, r.s, r.best) for r in got} == {("n0", 18, 24), ("n1", 24, 24)} and calls == [1]
    assert page.order(("all",)) == ["base", "doubled", "sums", "top", "all"]
    assert set(page.run()) == set(queries)
    with pytest.raises(ValueError, match="a uses b uses a"):
        Page(spark, {}, {"a": "select * from {b}", "b": "select * from {a}"}).run("a")
    with pytest.raises(KeyError, match="nothing"):
        Page(spark, {}, {"a": "select * from {nothing}"}).run("a")


def test_families_at_edges(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, None), (4, 5.0), (5, 1.0)], "id int, v double")
    assert [r.id for r in families.top(df, "v", ["id"], 2).collect()] == [1, 2] and [r.id for r in families.top(df, "v", ["id"], 1, bottom=True).collect()] == [5]
    assert {r.id: r.tier for r in families.tiers(df, "v", "id", ["a", "b", "c"]).collect()} == {1: "a", 2: "a", 4: "b", 5: "b", 3: "c"}
    assert {r.id: r.tier for r in families.tiers(df.limit(2), "v", "id", ["a", "b", "c"]).collect()} == {1: "a", 2: "b"}
    assert [(r.share, r.n_rows, round(r.part, 4)) for r in families.pareto(df, "v", "id", [0.2, 0.5]).orderBy("share").collect()] == [(0.2, 1, 0.3846), (0.5, 3, 0.9615)]
    assert {r.bucket: r.n for r in families.bucketed(df, "v", [1, 5], {"n": F.count("*")}).collect()} == {"<= 1": 1, "<= 5": 1, "> 5": 2}
    assert families.sliced(df, ["id"], id=[]).count() == 0 and families.sliced(df, ["id"], id=[1, 9]).count() == 1
    flat = spark.createDataFrame([(dt.date(2020, 1, 1), 3.0), (dt.date(2020, 2, 1), 3.0)], "d date, v double")
    r = families.extremes(flat, "d", "v").head()
    assert r.peak_period == r.trough_period == dt.date(2020, 1, 1)
    assert families.line(flat, "d", "v").head().r2 is None and {r.state for r in families.unusual(flat, "v").collect()} == {"normal"}
