"""What the registry can't show: errors, edge cases, stored versions, catalog answers, streams."""

import pytest
from pyspark.sql import functions as F

from granary.functions import predicates as P
from granary.functions import scalars as S
from granary.operators import mutations as M
from granary.operators import relational as R
from granary.operators import statistics as X
from granary.sources import catalog
from granary.sources.tables import capacities, created, declared, loaded, read_evolved, rename, write_version
from granary.streaming.aggregates import counts_per_window


@pytest.fixture(scope="module")
def users(spark):
    rows = [(3, "alice", "work@example.com"), (7, "bob", "work@example.com"), (10, "carol", ""), (15, "dave", "NULL"), (20, "Éve", None)]
    return spark.createDataFrame(rows, "id long, username string, email string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_insert(users):
    assert ids(M.insert_row(users, "id", {"id": 4, "username": "x", "email": "y"})) == [3, 4, 7, 10, 15, 20]
    assert ids(M.insert_row(users, "id", {"username": "x", "email": None})) == [3, 7, 10, 15, 20, 21]
    assert ids(M.insert_row(users.filter("false"), "id", {"id": 0, "username": "x", "email": "y"})) == [1]
    with pytest.raises(M.KeyError_):
        M.insert_row(users, "id", {"id": 7, "username": "x", "email": "y"})


def test_update_and_delete(users):
    both = M.update_where(users, F.col("email") == "work@example.com", {"username": F.col("email"), "email": F.col("username")}, "id")
    assert {(r.username, r.email) for r in both.filter("id < 8").collect()} == {("work@example.com", "alice"), ("work@example.com", "bob")}
    assert ids(M.delete_where(users, F.col("email") == "work@example.com")) == [10, 15, 20]  # a null predicate deletes nothing
    with pytest.raises(M.KeyError_):
        M.update_where(users, F.lit(True), {"id": F.lit(1)}, "id")
    with pytest.raises(M.KeyError_):
        M.require_key(users, "id", 99)
    M.require_key(users, "id", 3)


def test_predicates_and_functions(users):
    assert ids(users.filter(P.is_null_text(F.col("email")))) == [10, 15, 20]
    assert ids(users.filter(P.matches_token(F.col("email"), "EXAMP"))) == [3, 7]
    assert ids(users.filter(P.like(F.col("username"), "%\\%"))) == []
    assert ids(users.filter(P.like(F.col("username"), "A_IC%", fold=True))) == [3]
    assert ids(users.filter(~P.fits_bytes(F.col("username"), 3))) == [3, 10, 15, 20]
    row = users.filter("id = 20").select(S.byte_length(F.col("username")).alias("n"), S.ascii_lower(F.col("username")).alias("low"), S.ascii_upper(F.col("username")).alias("up")).first()
    assert tuple(row) == (4, "Éve", "ÉVE")
    assert users.agg(S.int_avg(F.col("id")).alias("a")).first().a == 11
    assert users.filter("false").agg(S.int_avg(F.col("id")).alias("a")).first().a is None


def test_order_and_windows(users):
    assert [r.id for r in R.ordered(users, [("email", True)], "id", 2, 1).collect()] == [7, 15]
    assert R.global_row_numbers(users, ["id"], parts=3).orderBy("id").select("rn").collect() == [(i,) for i in range(1, 6)]
    assert R.run_numbers(users.filter("false"), "id", "email").count() == 0
    one = users.filter("id = 3")
    assert X.depth_samples(one, "id").collect() == [(0, 0, 3)]


def test_subqueries(users):
    assert ids(R.if_exists(users, users.filter("id = 3"))) == [3, 7, 10, 15, 20]
    assert ids(R.if_exists(users, users.filter("id = 4"))) == []
    assert ids(R.members(users, "id", users.filter("id > 9"), "id", keep=False)) == [3, 7]


def test_not_in_with_nulls(users):
    twice = users.selectExpr("id", "nullif(id, 3) AS k")
    assert ids(R.members(users, "id", twice, "k", keep=False)) == []
    assert ids(R.members(twice, "k", users.filter("id = 7"), "id", keep=False)) == [10, 15, 20]
    assert ids(R.members(twice, "k", users.filter("false"), "id", keep=False)) == [3, 7, 10, 15, 20]


def test_orders_with_nulls(spark):
    rows = [(i, None if i % 4 == 0 else f"k{i % 7}", i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a string, b int")
    for order in ([("a", True), ("b", False), ("id", True)], [("a", False), ("id", False)]):
        got = R.global_row_numbers(df, order, parts=6).orderBy("rn").collect()
        want = df.orderBy(*[F.desc(k) if down else F.asc(k) for k, down in order]).collect()
        assert [r.id for r in got] == [r.id for r in want] and [r.rn for r in got] == list(range(1, 201))
    assert [r.id for r in R.ordered(df, [("a", True)], "id", None, 150).collect()] == [r.id for r in df.orderBy(F.desc("a"), "id").collect()][150:]
    got = {r.id: r.rn for r in R.run_numbers(df, "id", "a", parts=6).collect()}
    assert got == dict.fromkeys(range(200), 1)
    same = R.run_numbers(df.withColumn("a", F.lit(None).cast("string")), "id", "a", parts=6)
    assert {r.id: r.rn for r in same.collect()} == {i: i + 1 for i in range(200)}


def test_declared_tables(spark, tmp_path):
    with pytest.raises(ValueError, match="column"):
        declared(id="VARCHAR(3)")
    with pytest.raises(ValueError, match="column"):
        declared(id="INT", x="FLOAT")
    t = created(spark, declared(id="INT", country="VARCHAR(2)", note="VARCHAR"))
    t = M.insert_row(t, "id", {"id": 1, "country": "TW", "note": "é" * 127})
    for bad in ({"id": -5}, {"id": 4294967296}, {"country": "TWN"}, {"note": "é" * 128}):
        with pytest.raises(M.ValueTooLarge):
            M.insert_row(t, "id", {"id": 2, "country": "US", "note": ""} | bad)
    with pytest.raises(M.ValueTooLarge):
        M.update_where(t, F.lit(True), {"country": F.concat("country", F.lit("x"))}, "id")
    assert M.update_where(t, F.lit(False), {"country": F.lit("long")}, "id").first().country == "TW"
    assert M.update_by_key(t, "id", 1, {"country": F.lit("JP")}).first().country == "JP"
    with pytest.raises(M.KeyError_):
        M.update_by_key(t, "id", 9, {"country": F.lit("JP")})
    with pytest.raises(M.KeyError_):
        M.delete_by_key(t, "id", 9)
    assert M.delete_by_key(t, "id", 1).count() == 0
    # The declaration is kept in the files, and by updates; a table goes on under its new name.
    write_version(M.update_where(t, F.lit(True), {"country": F.lit("JP")}, "id"), str(tmp_path), "old", 1)
    rename(spark, str(tmp_path), "old", "new")
    again = spark.read.parquet(f"{tmp_path}/new/v1")
    assert capacities(again) == {"country": 2, "note": 255}
    with pytest.raises(M.ValueTooLarge):
        M.insert_row(again, "id", {"id": 2, "country": "TWN", "note": ""})
    with pytest.raises(ValueError, match="no table"):
        rename(spark, str(tmp_path), "old", "other")
    write_version(t, str(tmp_path), "old", 1)
    with pytest.raises(ValueError, match="exists"):
        rename(spark, str(tmp_path), "old", "new")
    with pytest.raises(Exception, match="doesn't fit"):
        loaded(spark.createDataFrame([(1, "TWN", "")], "id long, country string, note string"), declared(id="INT", country="VARCHAR(2)")).collect()


def test_folding_and_averages(spark):
    one = spark.createDataFrame([("É!~^|#$&", 18014398509481985)], "t string, n long")
    assert one.filter(P.like(F.col("t"), "é%", fold=True)).count() == 0
    assert one.filter(P.like(F.col("t"), "É!~^|#$&")).count() == 1
    assert one.filter(P.matches_token(F.col("t"), "é")).count() == 0 and one.filter(P.matches_token(F.col("t"), "a b")).count() == 0
    assert one.agg(S.int_avg(F.col("n")).alias("a")).first().a == 18014398509481985
    assert one.select(S.mod_or_zero(F.col("n"), F.lit(0)).alias("m")).first().m == 0
    assert one.filter(P.any_column_matches(one, "#")).count() == 1 and one.filter(P.any_column_matches(one.select("n"), "1")).count() == 0


def test_versions(spark, users, tmp_path):
    a = write_version(users, str(tmp_path), "users", 1)
    b = write_version(M.add_column(users.withColumn("id", F.col("id") + 100), "hits", "bigint"), str(tmp_path), "users", 2)
    both = read_evolved(spark, [a, b], {"hits": 0, "note": ""})
    assert both.count() == 10 and both.filter("hits = 0 AND note = ''").count() == 10
    with pytest.raises(Exception, match="(?i)exist"):
        write_version(users, str(tmp_path), "users", 1)


def test_catalog(spark, users):
    catalog.create_view(spark, "v_one", "SELECT 1 AS x")
    assert ("view", "v_one", "v_one") in [tuple(r) for r in catalog.master(spark).collect()]
    assert [r.pk for r in catalog.table_info(users, "users", "id").collect()] == [True, False, False]
    assert {r.check_name: r.n_bad for r in catalog.check(users.union(users.filter("id = 3")), "id").collect()} == {"null id": 0, "range id": 0, "duplicate id": 1}
    assert "PushedFilters" in catalog.explain(spark.read.parquet("/root/testdata/sf0.001/orders.parquet").filter("o_orderkey = 3"))
    ran = catalog.explain_analyze(users.groupBy("email").count())
    assert ran["rows"] == 4 and ran["seconds"] > 0 and "Aggregate" in ran["plan"]
    assert catalog.Prepared(spark, "SELECT ? + ? AS s").execute(2, 3).first().s == 5


def test_stream(spark, tmp_path):
    src = spark.range(20).select((F.col("id") * 30).cast("timestamp").alias("ts"), (F.col("id") % 2).alias("k"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    out = counts_per_window(stream, "ts", "k", "5 minutes", "1 minute")
    q = out.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.window_start.minute, r.k, r.n) for r in spark.table("counted").collect()) == [(0, 0, 5), (0, 1, 5), (5, 0, 5), (5, 1, 5)]
