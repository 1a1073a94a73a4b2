import pytest
from pyspark.sql import functions as F

from granary.operators import relational as R
from granary.plans import registry
from oracle import duck, same_rows

SIZES = ("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def cons():
    return {sf: duck(f"/root/testdata/{sf}") for sf in (*SIZES, "sf0.1")}


@pytest.mark.parametrize("sf", SIZES)
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_same_as_sql(spark, cons, name, sf):
    same_rows(registry.QUERIES[name](spark, f"/root/testdata/{sf}"), cons[sf], registry.SQL[name])


@pytest.mark.parametrize("name", ["row_number_all", "row_number_runs", "stats_quantiles", "stats_range_estimate", "offset_only"])
def test_running_sums_on_more_rows(spark, cons, name):
    same_rows(registry.QUERIES[name](spark, "/root/testdata/sf0.1"), cons["sf0.1"], registry.SQL[name])


def test_wide_rows_and_a_text_key(spark):
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").withColumn("id", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    got = R.global_row_numbers(lines, ["id"], parts=9)
    assert got.agg(F.count_distinct("rn"), F.min("rn"), F.max("rn")).first() == (lines.count(), 1, lines.count())
    assert got.join(got.select((F.col("rn") + 1).alias("rn"), F.col("id").alias("last")), "rn").filter("last > id").count() == 0
    runs = R.run_numbers(lines, "id", "l_returnflag", parts=9).select("id", "l_returnflag", "rn")
    rows = [tuple(r) for r in runs.orderBy("id").collect()]
    want, last = 0, None
    assert len(rows) == lines.count()
    for _, flag, rn in rows:
        want = want + 1 if flag == last else 1
        last = flag
        assert rn == want
