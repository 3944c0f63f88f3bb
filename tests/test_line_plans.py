"""Spark's own forms of the line inputs: the rows of the plain text, also with repeated, missing and null keys, and fewer exchanges."""

import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.plans import quality, regional
from tidemark.sources import retail

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """sf0.001 with some orders, customers and parts twice, some missing, and keys that are null."""
    out = str(tmp_path_factory.mktemp("odd"))
    for t in retail.TABLES:
        df, key = spark.read.parquet(f"{DIR}/{t}.parquet"), {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "lineitem": "l_orderkey"}.get(t)
        if key:
            df = df.unionByName(df.filter(F.col(key) % 13 == 0)).filter(F.col(key) % 17 != 3).withColumn(key, F.when(F.col(key) % 29 != 5, F.col(key)))
        df.coalesce(1).write.parquet(f"{out}/{t}.parquet")
    return out


def plain(spark, sf_dir, name):
    frames = {f"t_{t}": spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in retail.TABLES}
    for n in retail.needs(name):
        frames[n] = retail.run(spark, frames, retail.ADAPTER[n])
    return frames[name]


def shown(df):
    """Rows as text; amounts are moved off the halves before rounding."""
    return sorted(tuple(f"{x * 1.0000123:.6g}" if isinstance(x, float) else str(x) for x in r) for r in df.collect())


@pytest.mark.parametrize(("name", "partitions"), [("lines", "1"), ("lines", "64"), ("payments", "64"), ("sales", "1"), ("inventory", "1"), ("product_health", "1"), ("lifetime", "1")])
def test_rows_of_the_plain_text(spark, odd, name, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        want, got = plain(spark, odd, name), retail.load(spark, odd, [name])[name]
        assert got.dtypes == want.dtypes
        got, want = shown(got), shown(want)
        assert got == want and want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_series_has_the_lines_of_all_regions(spark, odd):
    i, o, g, p = (plain(spark, odd, n).alias(n) for n in ("order_items", "sorders", "geography", "products"))
    lines = i.join(o, F.expr("order_items.order_id = sorders.order_id")).join(g, F.expr("sorders.zip = geography.zip")).join(p, F.expr("order_items.product_id = products.product_id"))
    want = lines.groupBy("geography.region").agg(F.sum(F.expr("quantity * unit_price")), F.sum(F.expr("quantity * products.cogs")))
    assert shown(regional.series(spark, odd).groupBy("region").agg(F.sum("revenue"), F.sum("cogs"))) == shown(want)


def test_lines_are_dealt_once_by_part(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3k")  # nations and regions alone
    try:
        plan = registry.queries()["I01"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(l_partkey") + plan.count("Exchange hashpartitioning(product_id") <= 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tasks_grow_with_the_lines(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        lines = retail.load(spark, DIR, ["lines"])["lines"]
        assert lines._jdf.queryExecution().executedPlan().toString().count(f", {retail.TASKS_A_SPLIT}), REPARTITION_BY_NUM") >= 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("partitions", ["1", "64"])
def test_kept_inputs_give_the_rows_of_lazy_ones(spark, odd, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        names = ["product_health", "lifetime", "commercial", "inventory"]
        lazy, kept = retail.load(spark, odd, names), retail.load(spark, odd, names, quality.KEPT, ["select * from lifetime", "select * from inventory"])
        for n in names:
            assert kept[n].dtypes == lazy[n].dtypes
            assert shown(kept[n]) == shown(lazy[n])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_kept_inputs_hold_what_is_read(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert retail.read_of(df, "x", ["select a, count(*) from x group by a", "select c from y"]).columns == ["a"]
    assert retail.read_of(df, "x", ["select count(*) from x"]).columns == ["a"]
    assert retail.read_of(df, "x", ["select z.* from x z"]).columns == ["a", "b", "c"]


@pytest.mark.parametrize("rule", ["Q01", "Q02"])
def test_rules_read_the_order_lines_from_what_was_kept(spark, rule):
    plan = registry.queries()[rule](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_quantity" not in plan


def test_product_totals_deal_lines_by_product_alone(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        plan = retail.load(spark, DIR, ["lifetime"])["lifetime"]._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan and "Window" in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_kept_lines_are_one_table(spark, odd):
    names = ["lines", "order_items", "sales", "inventory", "returns"]
    kept = retail.load(spark, odd, names, quality.KEPT, [f"select * from {n}" for n in names])
    assert kept["order_items"].inputFiles() and set(kept["order_items"].inputFiles()) == set(kept["lines"].inputFiles())
    for n in names:
        want = plain(spark, odd, n)
        assert kept[n].dtypes == want.dtypes
        assert shown(kept[n]) == shown(want)


def test_series_derives_the_lines_once(spark):
    plan = regional.series(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_quantity" not in plan and "l_orderkey" not in plan


@pytest.fixture(scope="module")
def differing(spark, tmp_path_factory):
    """sf0.001 with other rows of the same order, part and customer, nations twice, and dates and quantities that are null."""
    out = str(tmp_path_factory.mktemp("differing"))
    some = lambda df, key, n: df.filter(F.col(key) % n == 0)
    tables = {t: spark.read.parquet(f"{DIR}/{t}.parquet") for t in retail.TABLES}
    o, p, c, n, i = (tables[t] for t in ("orders", "part", "customer", "nation", "lineitem"))
    later = some(o, "o_orderkey", 7).withColumns({"o_orderdate": F.date_add("o_orderdate", 40).cast(o.schema["o_orderdate"].dataType), "o_orderstatus": F.when(F.col("o_orderstatus") == "P", "F").otherwise("P"), "o_custkey": F.col("o_custkey") + 1})
    tables["orders"] = o.unionByName(later).withColumn("o_orderdate", F.when(F.col("o_orderkey") % 31 != 2, F.col("o_orderdate")))
    tables["part"] = p.unionByName(some(p, "p_partkey", 5).withColumn("p_retailprice", F.col("p_retailprice") * 2)).unionByName(some(p, "p_partkey", 10))
    tables["customer"] = c.unionByName(some(c, "c_custkey", 3)).unionByName(some(c, "c_custkey", 9).withColumn("c_nationkey", ((F.col("c_nationkey") + 1) % 25).cast(c.schema["c_nationkey"].dataType)))
    tables["nation"] = n.unionByName(some(n, "n_nationkey", 6))
    tables["lineitem"] = i.withColumns({"l_quantity": F.when(F.col("l_orderkey") % 41 != 1, F.col("l_quantity")), "l_returnflag": F.when(F.col("l_orderkey") % 3 != 1, "R")})
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{out}/{t}.parquet")
    return out


@pytest.mark.parametrize("partitions", ["1", "64"])
def test_product_months_with_differing_rows_of_a_key(spark, differing, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        want, got = plain(spark, differing, "product_health"), retail.load(spark, differing, ["product_health"])["product_health"]
        assert got.dtypes == want.dtypes
        # amounts near zero are what sums in another order leave
        got, want = (shown(df.select([(F.round(c, 4) + 0.0).alias(c) if k == "double" else c for c, k in df.dtypes])) for df in (got, want))
        assert got == want and any(r[1] == "None" for r in want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_product_months_are_dealt_once_by_product(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3k")
    try:
        plan = registry.queries()["K27"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("l_quantity") and plan.count("Exchange hashpartitioning(l_partkey") == 1
        assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and "month_start_date" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
