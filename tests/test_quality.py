"""The quality rules cover the survey's declarations and report what breaks them."""

import duckdb
import pyarrow.parquet as pq
import pytest
import pyarrow as pa
import pyarrow.compute as pc

from tidemark import registry
from tidemark.plans import quality
from tidemark.sources import retail

DIR = "/root/testdata/sf0.001"


def test_lists_hold_the_declarations_that_the_tables_carry(spark):
    # of 97, 31, 10 and 12 only the submission sample's not-null and unique rules have no table; gender and three links are added
    assert sum(len(c.split()) for c in quality.NOT_NULL.values()) == 97 - 1 and len(quality.UNIQUE) == 31 - 1
    assert len(quality.ACCEPTED) == 10 + 1 and len(quality.LINKS) == 12 + 3


def test_accepted_values_and_links_agree_with_sql(spark):
    con = duckdb.connect()
    for t in retail.TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    for name in ("Q03", "Q04"):
        df = registry.queries()[name](spark, DIR)
        want = con.execute(f"select {', '.join(df.columns)} from ({registry.oracle_sql()[name]})").fetchall()
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_a_null_category_is_reported(spark, tmp_path):
    for t in retail.TABLES:
        d = pq.read_table(f"{DIR}/{t}.parquet")
        if t == "part":
            at = d.schema.get_field_index("p_type")
            hole = pc.if_else(pc.equal(d["p_partkey"], 1), pa.scalar(None, d.schema.field(at).type), d["p_type"])
            d = d.set_column(at, "p_type", hole)
        pq.write_table(d, tmp_path / f"{t}.parquet")
    got = {r.col: r.nulls for r in registry.queries()["Q01"](spark, str(tmp_path)).collect()}
    assert got["products.category"] == 1 and got["products.segment"] == 0 and got["ranked_products.category"] == 1


@pytest.mark.parametrize("rule, rows", [
    (quality.unaccepted("returns", "return_reason", ["a", "b"]), [("returns.return_reason", "z", 1)]),
    (quality.repeated("returns", "order_id"), [("returns", "1", 2)]),
    (quality.orphans("returns", "order_id", "sorders"), [("returns.order_id", 1)]),
    (quality.nulls("returns", "order_id return_reason"), [("returns.order_id", 1), ("returns.return_reason", 1)]),
])
def test_breaches_are_reported(spark, rule, rows):
    returns = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z"), (None, None)], "order_id long, return_reason string")
    frames = {"returns": returns, "sorders": spark.createDataFrame([(1,)], "order_id long")}
    assert sorted(map(tuple, retail.run(spark, frames, rule).collect())) == rows
