"""Every query of the table operators: a Spark function and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import predicates as P
from granary.functions import scalars as S
from granary.operators import mutations, relational as R, statistics as X
from granary.sources import catalog, tables
from granary.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def n(name: str = "n") -> F.Column:  # type: ignore[name-defined]
    return F.count(F.lit(1)).alias(name)


# Flagship: range, group, having, order.
@query("SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last_order FROM orders WHERE o_orderkey BETWEEN 1 AND 100000000 GROUP BY o_custkey HAVING count(*) > 1")
def flagship(spark, d):
    o = table(spark, d, "orders").filter(F.col("o_orderkey").between(1, 100000000))
    return R.grouped(o, ["o_custkey"], {"n": F.count(F.lit(1)), "last_order": F.max("o_orderkey")}, F.col("n") > 1)


# Scans and filters.
@query("SELECT * FROM orders")
def full_scan(spark, d):
    return table(spark, d, "orders")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey DESC")
def reverse_scan(spark, d):
    return R.ordered(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), [("o_orderkey", True)], "o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 42")
def pk_lookup(spark, d):
    return table(spark, d, "orders").filter("o_orderkey = 42").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 500")
def pk_range(spark, d):
    return table(spark, d, "orders").filter("o_orderkey >= 100 AND o_orderkey < 500").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey BETWEEN 10 AND 90")
def pk_between(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderkey").between(10, 90)).select("o_orderkey", "o_orderpriority")


@query("SELECT p_name FROM part WHERE p_size = 7")
def project_one(spark, d):
    return table(spark, d, "part").filter("p_size = 7").select("p_name")


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 3, 5, 77)")
def in_list(spark, d):
    return table(spark, d, "part").filter(F.col("p_size").isin(1, 3, 5, 77)).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size FROM part WHERE p_size NOT IN (1, 3, 5, 77)")
def not_in_list(spark, d):
    return table(spark, d, "part").filter(~F.col("p_size").isin(1, 3, 5, 77)).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#12'")
def eq_filter(spark, d):
    return table(spark, d, "part").filter(F.col("p_brand") == "Brand#12").select("p_partkey", "p_brand")


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size <= 30 AND p_name >= 'b'")
def and_filter(spark, d):
    return table(spark, d, "part").filter(P.all_of(F.col("p_size") > 10, F.col("p_size") <= 30, F.col("p_name") >= "b")).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size FROM part WHERE (p_size = 5 AND p_name LIKE 'a%') OR (p_size > 45) OR p_partkey = 7")
def or_of_ands(spark, d):
    terms = P.any_of((F.col("p_size") == 5) & P.like(F.col("p_name"), "a%"), F.col("p_size") > 45, F.col("p_partkey") == 7)
    return table(spark, d, "part").filter(terms).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size, p_type FROM part WHERE (p_size < 5 OR p_size > 45) AND (p_type LIKE '%E%' OR p_partkey < 50)")
def paren_bool(spark, d):
    both = ((F.col("p_size") < 5) | (F.col("p_size") > 45)) & (P.like(F.col("p_type"), "%E%") | (F.col("p_partkey") < 50))
    return table(spark, d, "part").filter(both).select("p_partkey", "p_size", "p_type")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#0000%'")
def like_prefix(spark, d):
    return table(spark, d, "customer").filter(P.like(F.col("c_name"), "Customer#0000%")).select("c_custkey", "c_name")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#_2'")
def like_underscore(spark, d):
    return table(spark, d, "part").filter(P.like(F.col("p_brand"), "Brand#_2")).select("p_partkey", "p_brand")


@query("SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%a%'")
def not_like(spark, d):
    return table(spark, d, "part").filter(~P.like(F.col("p_name"), "%a%")).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE 'cUSTOMER%1'")
def ilike(spark, d):
    return table(spark, d, "customer").filter(P.like(F.col("c_name"), "cUSTOMER%1", fold=True)).select("c_custkey", "c_name")


@query("SELECT p_partkey, concat(p_brand, chr(92), p_size) AS tag FROM part WHERE concat(p_brand, chr(92), p_size) LIKE '%' || chr(92) || '1_' ESCAPE '!'")
def like_literal_backslash(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("\\"), "p_size").alias("tag")).filter(P.like(F.col("tag"), "%\\1_"))


NULLED = "CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'NULL' WHEN 2 THEN 'null' WHEN 3 THEN NULL ELSE o_orderstatus END"


@query(f"SELECT o_orderkey, (v IS NULL OR v IN ('', 'NULL', 'null')) AS is_null FROM (SELECT o_orderkey, {NULLED} AS v FROM orders)")
def null_sentinel(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.expr(NULLED).alias("v")).select("o_orderkey", P.is_null_text(F.col("v")).alias("is_null"))


@query("SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\r@.,;:_-]+'), lambda t: contains(t, 'tion'))) > 0")
def fts_match(spark, d):
    return table(spark, d, "documents").filter(P.matches_token(F.col("text"), "Tion")).select("doc_id")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ee') OR contains(lower(p_brand), 'ee') OR contains(lower(p_type), 'ee')")
def fts_match_any_column(spark, d):
    part = table(spark, d, "part")
    return part.filter(P.any_column_matches(part, "EE")).select("p_partkey")


# Distinct, aggregates, groups.
@query("SELECT DISTINCT p_brand FROM part")
def distinct_col(spark, d):
    return table(spark, d, "part").select("p_brand").distinct()


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
def agg_count_min_max(spark, d):
    return table(spark, d, "orders").agg(n(), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("SELECT CAST(sum(o_orderkey) AS BIGINT) AS total, CAST(sum(o_orderkey) // count(*) AS BIGINT) AS int_mean, avg(o_orderkey) AS mean FROM orders")
def agg_sum_avg_int(spark, d):
    return table(spark, d, "orders").agg(F.sum("o_orderkey").alias("total"), S.int_avg(F.col("o_orderkey")).alias("int_mean"), F.avg("o_orderkey").alias("mean"))


@query("SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders WHERE o_orderkey < 0")
def agg_empty(spark, d):
    return table(spark, d, "orders").filter("o_orderkey < 0").agg(n(), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.sum("o_orderkey").alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_orderkey) AS lo, max(l_orderkey) AS hi, CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_by(spark, d):
    return R.grouped(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"n": F.count(F.lit(1)), "lo": F.min("l_orderkey"), "hi": F.max("l_orderkey"), "total": F.sum("l_partkey")})


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def group_having(spark, d):
    return R.grouped(table(spark, d, "orders"), ["o_custkey"], {"n": F.count(F.lit(1))}, F.col("n") >= 12)


# Windows and order.
@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS rn FROM customer")
def row_number_all(spark, d):
    return R.global_row_numbers(table(spark, d, "customer").select("c_custkey"), ["c_custkey"])


@query("SELECT c_custkey, c_mktsegment, CAST(row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_name DESC, c_custkey) AS BIGINT) AS rn FROM customer")
def row_number_partition(spark, d):
    return R.row_numbers(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], [F.desc("c_name"), F.asc("c_custkey")]).select("c_custkey", "c_mktsegment", "rn")


@query(
    "WITH a AS (SELECT event_id, event_type, CASE WHEN lag(event_type) OVER (ORDER BY event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS s FROM events), "
    "b AS (SELECT *, sum(s) OVER (ORDER BY event_id) AS run FROM a) "
    "SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY run ORDER BY event_id) AS BIGINT) AS rn FROM b"
)
def row_number_runs(spark, d):
    return R.run_numbers(table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type").select("event_id", "event_type", "rn")


@query("SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand, p_size DESC, p_partkey")
def order_multi(spark, d):
    return R.ordered(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), [("p_brand", False), ("p_size", True)], "p_partkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey DESC LIMIT 25")
def topk_desc(spark, d):
    return R.ordered(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), [("o_orderpriority", True), ("o_orderkey", True)], "o_orderkey", 25)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 20 OFFSET 30")
def limit_offset(spark, d):
    return R.ordered(table(spark, d, "orders").select("o_orderkey", "o_custkey"), [("o_custkey", False)], "o_orderkey", 20, 30)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100")
def offset_only(spark, d):
    return R.ordered(table(spark, d, "orders").select("o_orderkey"), [], "o_orderkey", None, 100)


# Set operations, joins, subqueries.
@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def union_all(spark, d):
    o = table(spark, d, "orders")
    return o.filter("o_orderstatus = 'F'").select("o_orderkey").union(o.filter("o_orderpriority IN ('1-URGENT', '2-HIGH')").select("o_orderkey"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def union_distinct(spark, d):
    o = table(spark, d, "orders")
    return R.union_distinct(o.filter("o_orderstatus = 'F'").select("o_custkey"), o.filter("o_orderpriority IN ('1-URGENT', '2-HIGH')").select("o_custkey"))


@query("SELECT d.doc_id AS doc_id, d.lang AS lang, l.quality AS quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def pk_join(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return R.key_join(docs, labels, "doc_id", "doc_id").select(docs["doc_id"], "lang", "quality")


@query("SELECT a.o_orderkey AS id, a.o_orderstatus AS left_status, b.o_orderpriority AS right_priority FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey")
def self_join(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("left_status"))
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("other"), F.col("o_orderpriority").alias("right_priority"))
    return R.key_join(a, b, "id", "other").drop("other")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def in_subquery(spark, d):
    sub = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return R.members(table(spark, d, "customer"), "c_custkey", sub, "o_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def not_in_subquery(spark, d):
    sub = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return R.members(table(spark, d, "customer"), "c_custkey", sub, "o_custkey", keep=False).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_custkey END FROM orders WHERE o_orderstatus = 'F')")
def not_in_with_null(spark, d):
    sub = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey")).alias("k"))
    return R.members(table(spark, d, "customer"), "c_custkey", sub, "k", keep=False).select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P')")
def exists_subquery(spark, d):
    return R.if_exists(table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderstatus = 'P'")).select("c_custkey", "c_name")


@query("SELECT c_custkey, (SELECT count(*) FROM orders) AS n_orders FROM customer")
def scalar_subquery(spark, d):
    return R.with_scalar(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").agg(n()), "n_orders")


@query("WITH big AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey > 1000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey")
def cte(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("_orders_in")
    return spark.sql("WITH big AS (SELECT o_custkey, o_orderkey FROM _orders_in WHERE o_orderkey > 1000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey")


@query("SELECT o_orderpriority, count(*) AS n FROM (SELECT * FROM orders WHERE o_orderstatus = 'O') GROUP BY o_orderpriority")
def view(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("_orders_in")
    catalog.create_view(spark, "_open_orders", "SELECT * FROM _orders_in WHERE o_orderstatus = 'O'")
    return spark.sql("SELECT o_orderpriority, count(*) AS n FROM _open_orders GROUP BY o_orderpriority")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 17")
def prepared(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("_orders_in")
    return catalog.Prepared(spark, "SELECT o_orderkey, o_custkey FROM _orders_in WHERE o_custkey = ?").execute(17)


# Scalar functions.
@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def str_length_bytes(spark, d):
    return table(spark, d, "documents").select("doc_id", S.byte_length(F.col("text")).alias("n_bytes"))


UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(f"SELECT doc_id, translate(text, '{LOW}', '{UP}') AS up, translate(text, '{UP}', '{LOW}') AS low FROM documents")
def str_upper_lower(spark, d):
    return table(spark, d, "documents").select("doc_id", S.ascii_upper(F.col("text")).alias("up"), S.ascii_lower(F.col("text")).alias("low"))


@query("SELECT c_custkey, concat(c_name, c_mktsegment) AS tag FROM customer")
def str_concat(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.concat2(F.col("c_name"), F.col("c_mktsegment")).alias("tag"))


@query("SELECT o_orderkey, abs(o_orderkey) AS a, o_orderkey % 7 AS m FROM orders")
def math_abs_mod(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.abs("o_orderkey").alias("a"), S.mod_or_zero(F.col("o_orderkey"), 7).alias("m"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % (o_orderkey % 3) END AS m FROM orders")
def math_mod_zero(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.mod_or_zero(F.col("o_custkey"), F.col("o_orderkey") % 3).alias("m"))


@query("SELECT '1.0' AS version, 'granary' AS database")
def system_values(spark, d):
    return catalog.system_values(spark)


# Conjunctions, disjunctions and ordered ranges that another engine would serve from indexes: filters in one scan.
TERMS = ("p_size > 20", "p_brand = 'Brand#12'")


@query(f"SELECT p_partkey, p_size, p_brand FROM part WHERE {TERMS[0]} AND {TERMS[1]}")
def index_intersection(spark, d):
    return table(spark, d, "part").filter(P.all_of(*[F.expr(t) for t in TERMS])).select("p_partkey", "p_size", "p_brand")


@query(f"SELECT p_partkey, p_size, p_brand FROM part WHERE {TERMS[0]} OR {TERMS[1]}")
def index_union(spark, d):
    return table(spark, d, "part").filter(P.any_of(*[F.expr(t) for t in TERMS])).select("p_partkey", "p_size", "p_brand")


@query("SELECT p_size, p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 ORDER BY p_size, p_partkey")
def index_range_order(spark, d):
    return R.ordered(table(spark, d, "part").filter("p_size BETWEEN 10 AND 20").select("p_size", "p_partkey"), [("p_size", False)], "p_partkey")


# Statistics.
FREQ = "f AS (SELECT p_size AS value, count(*) AS freq FROM part GROUP BY p_size), t AS (SELECT * FROM f ORDER BY freq DESC, value LIMIT 16)"


@query(f"WITH {FREQ} SELECT t.value AS value, t.freq AS freq, CAST(coalesce((SELECT sum(f.freq) FROM f WHERE f.value < t.value), 0) AS BIGINT) AS rows_before FROM t")
def stats_mcv(spark, d):
    return X.common_values(table(spark, d, "part"), "p_size")


@query(
    "WITH r AS (SELECT l_partkey AS value, row_number() OVER (ORDER BY l_partkey) - 1 AS rank FROM lineitem), "
    "n AS (SELECT count(*) AS n, least(33, count(*)) AS s FROM lineitem), "
    "i AS (SELECT range AS i, CAST(range * (n - 1) // (s - 1) AS BIGINT) AS rank FROM range(33), n) "
    "SELECT CAST(i.i AS BIGINT) AS i, i.rank AS rank, r.value AS value FROM i JOIN r ON r.rank = i.rank"
)
def stats_quantiles(spark, d):
    return X.depth_samples(table(spark, d, "lineitem"), "l_partkey")


@query("SELECT p_brand AS a, p_type AS b, count(*) AS freq FROM part GROUP BY ALL ORDER BY freq DESC, a, b LIMIT 32")
def stats_pair_mcv(spark, d):
    return X.common_pairs(table(spark, d, "part"), "p_brand", "p_type")


@query(
    f"WITH {FREQ}, w AS (SELECT sum(freq) AS total, count(*) AS ndv, min(value) AS lo, max(value) AS hi FROM f), h AS (SELECT sum(freq) AS tr, count(*) AS tn FROM t), "
    "q AS (SELECT CAST(range AS INT) AS value FROM range(-5, 70)), "
    "e AS (SELECT q.value, CASE WHEN q.value < lo OR q.value > hi THEN 0 ELSE coalesce(t.freq, CASE WHEN ndv > tn THEN ceil((total - tr) / (ndv - tn)) ELSE 0 END) END AS est, total FROM q CROSS JOIN w CROSS JOIN h LEFT JOIN t ON t.value = q.value) "
    "SELECT value, CAST(est AS BIGINT) AS est_rows, CAST(est * 5 AS BIGINT) AS index_cost, CAST(total * 3 AS BIGINT) AS scan_cost, CASE WHEN total >= 32 AND est * 5 > total * 3 THEN 'scan' ELSE 'index' END AS choice FROM e"
)
def cost_choice(spark, d):
    return X.equality_estimates(table(spark, d, "part"), "p_size", spark.range(-5, 70).select(F.col("id").cast("int").alias("value")))


@query(
    f"WITH {FREQ}, r AS (SELECT p_size AS value, row_number() OVER (ORDER BY p_size) - 1 AS rank FROM part), n AS (SELECT count(*) AS n, least(33, count(*)) AS s FROM part), "
    "s AS (SELECT r.rank AS rank, r.value AS at FROM range(33) i, n JOIN r ON r.rank = i.range * (n.n - 1) // (n.s - 1)), "
    "q AS (SELECT CAST(range AS INT) AS value FROM range(-5, 70)), "
    "b AS (SELECT q.value, max(s.rank) FILTER (s.at <= q.value) AS lr, max(s.at) FILTER (s.at <= q.value) AS la, min(s.rank) FILTER (s.at > q.value) AS hr, min(s.at) FILTER (s.at > q.value) AS ha FROM q, s GROUP BY q.value) "
    "SELECT b.value AS value, CAST(CASE WHEN t.value IS NOT NULL THEN t.freq + coalesce((SELECT sum(f.freq) FROM f WHERE f.value < t.value), 0) WHEN lr IS NULL THEN 0 WHEN hr IS NULL THEN (SELECT n FROM n) "
    "ELSE lr + (hr - lr) * (b.value - la) // (ha - la) + 1 END AS BIGINT) AS est_rows FROM b LEFT JOIN t ON t.value = b.value"
)
def stats_range_estimate(spark, d):
    return X.at_most_estimates(table(spark, d, "part"), "p_size", spark.range(-5, 70).select(F.col("id").cast("int").alias("value")))


@query(
    "WITH p AS (SELECT p_brand AS a, p_type AS b, count(*) AS freq FROM part GROUP BY ALL), t AS (SELECT * FROM p ORDER BY freq DESC, a, b LIMIT 32), "
    "w AS (SELECT sum(freq) AS total, count(*) AS ndv FROM p), h AS (SELECT sum(freq) AS tr, count(*) AS tn FROM t), q AS (SELECT DISTINCT p_brand AS a, p_type AS b FROM part WHERE p_size < 10) "
    "SELECT q.a AS a, q.b AS b, CAST(coalesce(t.freq, CASE WHEN ndv > tn THEN ceil((total - tr) / (ndv - tn)) ELSE 0 END) AS BIGINT) AS est_rows FROM q CROSS JOIN w CROSS JOIN h LEFT JOIN t ON t.a = q.a AND t.b = q.b"
)
def stats_pair_estimate(spark, d):
    part = table(spark, d, "part")
    return X.pair_estimates(part, "p_brand", "p_type", part.filter("p_size < 10").select(F.col("p_brand").alias("a"), F.col("p_type").alias("b")).distinct())


# Mutations: the table after the statement.
@query("SELECT * REPLACE (CASE WHEN o_orderpriority = '1-URGENT' AND (o_custkey < 50 OR o_orderstatus LIKE 'F%') THEN 'moved' ELSE o_orderstatus END AS o_orderstatus) FROM orders")
def dml_update(spark, d):
    hit = (F.col("o_orderpriority") == "1-URGENT") & ((F.col("o_custkey") < 50) | P.like(F.col("o_orderstatus"), "F%"))
    return mutations.update_where(table(spark, d, "orders"), hit, {"o_orderstatus": F.lit("moved")}, "o_orderkey")


@query("SELECT * REPLACE (CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'X' ELSE o_orderstatus END AS o_orderstatus) FROM orders")
def dml_update_key(spark, d):
    o = table(spark, d, "orders")
    return mutations.update_by_key(o, "o_orderkey", o.agg(F.max("o_orderkey")).first()[0], {"o_orderstatus": F.lit("X")})


@query("SELECT * FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_quantity > 25)")
def dml_delete(spark, d):
    return mutations.delete_where(table(spark, d, "lineitem"), (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25))


@query("SELECT * FROM orders WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders)")
def dml_delete_key(spark, d):
    o = table(spark, d, "orders")
    return mutations.delete_by_key(o, "o_orderkey", o.agg(F.min("o_orderkey")).first()[0])


@query("SELECT * FROM orders WHERE false")
def dml_delete_all(spark, d):
    return mutations.delete_where(table(spark, d, "orders"), F.lit(True))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders UNION ALL SELECT max(o_orderkey) + 1, 17, 'N' FROM orders")
def dml_insert_autoid(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return mutations.insert_row(o, "o_orderkey", {"o_orderkey": None, "o_custkey": 17, "o_orderstatus": "N"})


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders UNION ALL SELECT 4000000000, 17, 'N'")
def dml_insert_typed(spark, d):
    o = tables.loaded(table(spark, d, "orders"), tables.declared(o_orderkey="INT", o_custkey="INT", o_orderstatus="VARCHAR(1)"))
    return mutations.insert_row(o, "o_orderkey", {"o_orderkey": 4000000000, "o_custkey": 17, "o_orderstatus": "N"})


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def create_table(spark, d):
    return tables.loaded(table(spark, d, "customer"), tables.declared(c_custkey="INT", c_name="VARCHAR(32)", c_mktsegment="VARCHAR"))


@query("SELECT l.* FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'fr')")
def fk_cascade(spark, d):
    return mutations.cascade_delete(table(spark, d, "labels"), "doc_id", table(spark, d, "documents").filter("lang = 'fr'"), "doc_id")


@query("SELECT *, '' AS note, CAST(0 AS BIGINT) AS hits FROM customer")
def alter_add_column(spark, d):
    return mutations.add_column(mutations.add_column(table(spark, d, "customer"), "note", "string"), "hits", "bigint")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def rename_table(spark, d):
    for name in ("_orders_before", "_orders_after"):
        spark.catalog.dropTempView(name)
    table(spark, d, "orders").createOrReplaceTempView("_orders_before")
    catalog.rename_view(spark, "_orders_before", "_orders_after")
    return spark.table("_orders_after").groupBy("o_orderstatus").agg(n())


@query("SELECT 'null o_orderkey' AS check_name, count(*) FILTER (o_orderkey IS NULL) AS n_bad FROM orders UNION ALL SELECT 'capacity o_orderstatus', count(*) FILTER (strlen(o_orderstatus) > 1) FROM orders UNION ALL SELECT 'range o_custkey', count(*) FILTER (o_custkey < 0 OR o_custkey > 4294967295) FROM orders UNION ALL SELECT 'duplicate o_orderkey', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def integrity_check(spark, d):
    return mutations.integrity_report(table(spark, d, "orders"), "o_orderkey", {"o_orderstatus": 1}, ("o_custkey",))


@query(
    "SELECT table_name AS tbl_name, CAST(ordinal_position - 1 AS INT) AS cid, column_name AS name, CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' END AS type, "
    "column_name = 'c_custkey' AS pk FROM information_schema.columns WHERE table_name = 'customer'"
)
def table_info(spark, d):
    return catalog.table_info(table(spark, d, "customer"), "customer", "c_custkey")


@query("SELECT DISTINCT 'table' AS type, table_name AS name, table_name AS tbl_name FROM information_schema.tables WHERE table_schema = 'main'")
def catalog_tables(spark, d):
    return catalog.folder_tables(spark, d)


@query("SELECT count(*) AS n_rows, true AS pushed FROM orders WHERE o_orderstatus = 'F'")
def explain_analyze(spark, d):
    ran = catalog.explain_analyze(table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey"))
    return spark.range(1).select(F.lit(ran["rows"]).cast("long").alias("n_rows"), F.lit("EqualTo(o_orderstatus,F)" in ran["plan"]).alias("pushed"))
