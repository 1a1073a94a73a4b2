import math

import pytest

from granary.llm import mixing, queries
from oracle import duck, same_rows

SF = "/root/testdata/sf0.001"


def test_query(spark):
    same_rows(queries.op2_mixing(spark, SF), duck(SF), queries.SQL["op2_mixing"])


def test_poisson_matches_its_distribution(spark):
    for mean in (0.3, 2.5, 40.0):
        df = spark.range(20000).selectExpr("id as doc_id", "'a' as source", "'x' as text")
        n = [r["count"] for r in mixing.mix(df, {"a": 1.0}, total=mean).groupBy("doc_id").count().collect()]
        n += [0] * (20000 - len(n))
        m = sum(n) / len(n)
        assert abs(m - mean) < 5 * math.sqrt(mean / 20000)
        assert abs(sum((x - m) ** 2 for x in n) / len(n) - mean) < 0.1 * mean


def test_edges(spark):
    rows = [(1, "a", "xx"), (2, "b", None), (3, None, "yyyy"), (None, "a", "zz"), (1, "a", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as rate", "2 as _rate")
    got = {r.source: r.rate for r in mixing.rates(df, {"a": 1.0, None: 3.0}).collect()}
    assert got == {"a": pytest.approx(10 / 4 / 6), "b": 0.0, None: pytest.approx(7.5 / 4)}
    out = mixing.mix(df, {"a": 1.0, None: 3.0}, total=20.0)
    assert out.columns == [*df.columns, "copy_no", "mix_key"]
    twice = [r.copy_no for r in out.filter("doc_id = 1").collect()]
    assert all(twice.count(x) == 2 for x in twice)
    assert {r.source for r in out.collect()} == {"a", None}
    assert mixing.mix(df.filter("false"), {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(out, {"a": 1.0})


def test_many_sources_join(spark):
    df = spark.range(1500).selectExpr("id as doc_id", "concat('s', id) as source", "'x' as text")
    out = mixing.mix(df, {}, rest=1.0)
    assert 1300 < out.count() < 1700
