"""One query per operator, over the Parquet tables of a folder, with the SQL that gives the same rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import semantics as S
from .operators import relational as R
from .plans.dialect import rewritten, tokens
from .plans.engine import select
from .sources import csv
from .sources.scratch import scratch

TABLES = "region nation customer supplier part orders lineitem events".split()
TS = "timestamp_ntz"


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


QUERIES, ORACLES = {}, {}


def query(oracle: str):
    """Registers a function of the tables under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        QUERIES[f.__name__].__name__ = f.__name__
        ORACLES[f.__name__] = oracle
        return f

    return add


def sql(name: str, text: str, oracle: str | None = None):
    """Registers SQL text, run through the engine's dialect over views of the tables that it names."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        words = tokens(text)
        frames = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in TABLES if t in words}
        for t, df in frames.items():
            df.createOrReplaceTempView(t)
        return select(spark, rewritten(words, {t: {f.name: f.dataType.simpleString() for f in df.schema} for t, df in frames.items()}))

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, oracle or text


@query("select r_regionkey, r_name from region")
def scan_table(t):
    return t.region


@query("select c_custkey, c_name as name from customer")
def project_columns(t):
    return t.customer.select("c_custkey", F.col("c_name").alias("name"))


TAGGED = ["o_orderkey (N) (P)", "o_custkey (N)", "o_orderstatus (T)", "o_totalprice (N)", "o_orderdate (D)", "o_orderpriority (T)"]


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders")
def scan_csv(t):
    """Orders, written as CSV files with tagged headers, through the typed scan."""
    folder = scratch(t.spark)
    csv.write_parts(t.orders.toDF(*TAGGED), folder)
    return csv.scan(t.spark, folder)


@query("select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer")
def scan_csv_untagged(t):
    """Customers as CSV without tags: types are found in the cells."""
    folder = scratch(t.spark)
    csv.write_parts(t.customer, folder)
    return csv.scan(t.spark, folder)


@query("select o_orderkey || ',' || printf('%.6f', o_totalprice) || ',' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ',\"a \"\"' || o_orderpriority || '\"\", b\",' as line from orders")
def sink_csv(t):
    """Lines of the CSV sink: six decimals, padded date-times, quotes where they must be, nothing for null."""
    folder = scratch(t.spark)
    odd = F.concat(F.lit('a "'), "o_orderpriority", F.lit('", b'))
    csv.write_parts(t.orders.select("o_orderkey", "o_totalprice", "o_orderdate", odd.alias("odd"), F.lit(None).cast("long").alias("none")), folder)
    return t.spark.read.text(folder).where("value not like 'o_orderkey%'").withColumnRenamed("value", "line")


sql("project_star", "SELECT * FROM region")
sql("alias_table", "SELECT n.n_name, n.n_regionkey FROM nation n")
sql("derived_table", "SELECT d.k, d.v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal > 5000) d WHERE d.v < 8000")
sql("project_expr", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")


@query("select c_custkey from customer where c_mktsegment = 'BUILDING'")
def filter_eq(t):
    return t.customer.where(S.eq(F.col("c_mktsegment"), "BUILDING", "string")).select("c_custkey")


@query("select c_custkey from customer where not coalesce(c_mktsegment = 'BUILDING', false)")
def filter_ne(t):
    return t.customer.where(S.ne(F.col("c_mktsegment"), "BUILDING", "string")).select("c_custkey")


@query("select o_orderkey from orders where cast(o_orderdate as date) = date '1998-01-15'")
def filter_eq_date(t):
    return t.orders.where(S.eq(F.col("o_orderdate"), "1998-01-15", TS)).select("o_orderkey")


@query("select o_orderkey from orders where strftime(o_orderdate, '%H:%M:%S') = '00:00:00'")
def filter_eq_time(t):
    return t.orders.where(S.eq(F.col("o_orderdate"), "0:0:0", TS)).select("o_orderkey")


@query("select o_orderkey from orders where cast(o_orderdate as date) <= date '1995-06-30'")
def filter_le_date(t):
    return t.orders.where(S.le(F.col("o_orderdate"), "1995-06-30", TS)).select("o_orderkey")


sql("filter_ts", "SELECT o_orderkey FROM orders WHERE o_orderdate > '1996-01-01'", "select o_orderkey from orders where o_orderdate > timestamp '1996-01-01 00:00:00'")
sql("filter_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45")
sql("filter_ge_le", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20")
sql("filter_and", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40 AND l_discount < 0.03")
sql("filter_or", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 49 OR l_discount < 0.01")
sql("filter_not", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 0)", "select c_custkey from customer where not coalesce(c_acctbal > 0, false)")
sql("filter_is_null", "SELECT k FROM (SELECT c_custkey AS k, nullif(c_mktsegment, 'BUILDING') AS s FROM customer) d WHERE s ISNULL", "select c_custkey as k from customer where c_mktsegment = 'BUILDING'")
sql("filter_is_not_null", "SELECT k FROM (SELECT c_custkey AS k, nullif(c_mktsegment, 'BUILDING') AS s FROM customer) d WHERE s IS NOT NULL", "select c_custkey as k from customer where c_mktsegment <> 'BUILDING'")
sql("filter_const", "SELECT r_name FROM region WHERE 2 = 2")
sql("filter_const_truthy", "SELECT r_name FROM region WHERE 1", "select r_name from region where true")
sql("filter_const_falsy", "SELECT r_name FROM region WHERE 2 - 2", "select r_name from region where false")
sql("filter_arith", "SELECT p_partkey FROM part WHERE p_size * 2 > p_retailprice / 20")
sql("filter_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 15")
sql("filter_in", "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 3, 5)")
sql("filter_in_subquery", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql("filter_like", "SELECT p_partkey FROM part WHERE p_type LIKE '%A%'")
sql("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
sql("anti_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")

sql("join_cross", "SELECT r_name, n_name FROM region, nation")
sql("join_equi", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
sql("join_on", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
sql("join_chain", "SELECT s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
sql("join_multiway", "SELECT o_orderkey, c_name, n_name, r_name FROM orders, customer, nation, region WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey")
sql("join_theta", "SELECT a.n_nationkey, b.r_regionkey FROM nation a, region b WHERE a.n_nationkey > b.r_regionkey")
sql("join_self", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
sql("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey")
sql("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
sql("join_using", "SELECT k, n, r FROM (SELECT n_regionkey AS k, n_name AS n FROM nation) a JOIN (SELECT r_regionkey AS k, r_name AS r FROM region) b USING (k)")


@query("select n_name, r_name from (select n_name, nullif(n_regionkey, 0) as k from nation) a join (select r_name, nullif(r_regionkey, 0) as k from region) b on a.k is not distinct from b.k")
def join_equi_nullsafe(t):
    a = t.nation.select("n_name", F.nullif("n_regionkey", F.lit(0)).alias("a_key"))
    b = t.region.select("r_name", F.nullif("r_regionkey", F.lit(0)).alias("b_key"))
    return R.equi_join(a, b, "a_key", "b_key", null_equal=True).select("n_name", "r_name")


sql("agg_count_star", "SELECT COUNT(*) AS n FROM lineitem")
sql("agg_count", "SELECT COUNT(s) AS n FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS s FROM customer) d")
sql("agg_count_distinct", "SELECT COUNT(DISTINCT l_suppkey) AS n FROM lineitem")


@query("select round(coalesce(sum(l_quantity), 0), 2) as total from lineitem")
def agg_sum(t):
    return t.lineitem.agg(F.round(S.total(F.col("l_quantity"), "double"), 2).alias("total"))


@query("select round(coalesce(avg(l_extendedprice), 0), 4) as mean from lineitem")
def agg_avg(t):
    return t.lineitem.agg(F.round(S.mean(F.col("l_extendedprice")), 4).alias("mean"))


sql("agg_min", "SELECT MIN(l_quantity) AS least FROM lineitem")
sql("agg_max", "SELECT MAX(l_extendedprice) AS most FROM lineitem")
sql("agg_min_str", "SELECT MIN(c_name) AS least FROM customer")
sql("agg_min_ts", "SELECT MIN(o_orderdate) AS least FROM orders")
sql("agg_multi", "SELECT COUNT(*) AS n, MIN(o_totalprice) AS least, MAX(o_totalprice) AS most FROM orders")


@query("select 0 as n, cast(0 as double) as total, cast(0 as double) as mean, '' as least, timestamp '1970-01-01 00:00:00' as last")
def agg_empty(t):
    none = t.orders.where("o_orderkey < 0")
    return none.agg(F.count(F.lit(1)).cast("int").alias("n"), S.total(F.col("o_totalprice"), "double").alias("total"), S.mean(F.col("o_totalprice")).alias("mean"), S.least(F.col("o_orderstatus"), "string").alias("least"), S.most(F.col("o_orderdate"), TS).alias("last"))


sql("group_by", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, round(sum(l_quantity) + 0, 2) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("group_by_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")

sql("subquery_scalar_where", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)")
sql("subquery_arith", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders) * 1.5 - 5")
sql("subquery_first_row", "SELECT n_name FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region ORDER BY r_regionkey DESC)", "select n_name from nation where n_regionkey = (select r_regionkey from region order by r_regionkey desc limit 1)")


@query("select c_custkey, round(coalesce((select sum(o_totalprice) from orders where o_custkey = c_custkey), 0), 2) as total from customer")
def subquery_corr_select(t):
    out = R.correlated_total(t.customer.select("c_custkey"), t.orders, "c_custkey", "o_custkey", "o_totalprice", "total")
    return out.withColumn("total", F.round("total", 2))


@query("select c_custkey, a.n, a.most from customer, lateral (select count(*) as n, max(o_totalprice) as most from orders where o_custkey = c_custkey) a")
def subquery_multicol(t):
    some = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"))
    return t.customer.join(some, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "most")


sql("sort_int", "SELECT n_nationkey FROM nation ORDER BY n_nationkey DESC")
sql("sort_double", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal ASC")
sql("sort_ts", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate")
sql("sort_string", "SELECT p_partkey, p_name FROM part ORDER BY p_name DESC")
sql("sort_multi", "SELECT c_nationkey, c_custkey FROM customer ORDER BY c_nationkey, c_custkey DESC")
sql("sort_by_alias", "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC")
sql("topk", "SELECT TOP 10 o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
sql("limit", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7")
sql("offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 20")


@query("select c_custkey from customer order by coalesce(nullif(c_nationkey, 3), 0), c_custkey")
def sort_nulls(t):
    df = t.customer.select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    return R.sort(df, "k", null_as_zero=True).select("c_custkey")


sql("distinct", "SELECT DISTINCT c_mktsegment FROM customer")
sql("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
sql("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier")
sql("set_intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey AS k FROM supplier")
sql("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey AS k FROM supplier")
sql("cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000) SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey")

sql("const_add", "SELECT n_name FROM nation WHERE n_nationkey > 2 + 3")
sql("const_sub", "SELECT n_name FROM nation WHERE n_nationkey > 12 - 3")
sql("const_mul", "SELECT n_name FROM nation WHERE n_nationkey > 2 * 3")
sql("const_div", "SELECT n_name FROM nation WHERE n_nationkey = 7 / 2", "select n_name from nation where n_nationkey = 7 // 2")
sql("const_neg", "SELECT c_custkey FROM customer WHERE c_acctbal < -500")
sql("const_concat", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUIL' + 'DING'", "select c_custkey from customer where c_mktsegment = 'BUILDING'")

# Forms of the dialect: each goes through the rewriter as text.
sql("project_qualified_star", "SELECT n.*, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey", "select nation.*, r_name from nation join region on n_regionkey = r_regionkey")
sql("project_not", "SELECT c_custkey, NOT c_nationkey = 1 AS other FROM customer", "select c_custkey, not coalesce(c_nationkey = 1, false) as other from customer")
sql("derived_table_columns", "SELECT d.a, d.b FROM (SELECT n_nationkey, n_name FROM nation) AS d(a, b) WHERE d.a != 3", "select n_nationkey as a, n_name as b from nation where n_nationkey <> 3")
NULLS = "(SELECT c_custkey AS k, nullif(c_nationkey, 3) AS x, nullif(c_custkey % 25, 4) AS y, c_acctbal AS v FROM customer) d"
sql("filter_ne_columns", f"SELECT k FROM {NULLS} WHERE x != y", f"select k from {NULLS} where not coalesce(x = y, false)")
sql("filter_ne_negative", f"SELECT k FROM {NULLS} WHERE x <> -5", "select c_custkey as k from customer")
sql("filter_ne_reversed", f"SELECT k FROM {NULLS} WHERE 5 != x", f"select k from {NULLS} where not coalesce(x = 5, false)")
sql("filter_ne_subquery", f"SELECT k FROM {NULLS} WHERE x != (SELECT MIN(n_nationkey) FROM nation)", f"select k from {NULLS} where not coalesce(x = 0, false)")
sql("filter_not_between", f"SELECT k FROM {NULLS} WHERE NOT x BETWEEN 1 AND 5", f"select k from {NULLS} where not coalesce(x between 1 and 5, false)")
sql("filter_not_nested", f"SELECT k FROM {NULLS} WHERE NOT (x = 2 OR NOT y > 7) AND NOT x IN (1, 9)", f"select k from {NULLS} where not coalesce(x = 2 or not coalesce(y > 7, false), false) and not coalesce(x in (1, 9), false)")
sql("filter_between_sum", "SELECT p_partkey FROM part WHERE p_size BETWEEN 1 + 2 + 3 + 4 AND 5 * 4", "select p_partkey from part where p_size between 10 and 20")
sql("filter_const_bracket", "SELECT r_name FROM region WHERE (1) AND NOT (2 - 2)", "select r_name from region")
sql("filter_const_text", "SELECT r_name FROM region WHERE '' OR 'x'", "select r_name from region")
sql("filter_literal_cast", "SELECT n_name FROM nation WHERE n_nationkey = 2.9 OR 7.5 = n_nationkey", "select n_name from nation where n_nationkey in (2, 7)")
sql("filter_le_reversed_date", "SELECT o_orderkey FROM orders WHERE '1995-06-30' >= o_orderdate", "select o_orderkey from orders where o_orderdate < timestamp '1995-07-01 00:00:00'")
sql("filter_time_sql", "SELECT o_orderkey FROM orders WHERE o_orderdate = '0:00:00' AND o_orderdate != '1998-01-15'", "select o_orderkey from orders where strftime(o_orderdate, '%H:%M:%S') = '00:00:00' and cast(o_orderdate as date) <> date '1998-01-15'")
sql("filter_corr_where", "SELECT c_custkey FROM customer WHERE c_acctbal < (SELECT SUM(o_totalprice) FROM orders WHERE o_custkey = c_custkey)", "select c_custkey from customer where c_acctbal < coalesce((select sum(o_totalprice) from orders where o_custkey = c_custkey), 0)")
sql("join_natural", "SELECT k, n, r FROM (SELECT n_regionkey AS k, n_name AS n FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name AS r FROM region) b")
sql("join_cross_kind", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_left_on_two", "SELECT c_custkey, o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000")
sql("agg_avg_ts", "SELECT AVG(o_orderdate) AS middle FROM orders", "select make_timestamp(cast((2 * sum(epoch_us(o_orderdate)::hugeint) + count(*)) // (2 * count(*)) as bigint)) as middle from orders")
sql("agg_zero_sql", "SELECT COUNT(o_orderkey) AS n, SUM(o_custkey) AS total, AVG(o_totalprice) AS mean, MIN(o_orderstatus) AS least, MAX(o_orderdate) AS last FROM orders WHERE o_orderkey < 0", "select 0::bigint as n, 0::bigint as total, 0::double as mean, '' as least, timestamp '1970-01-01 00:00:00' as last")
sql("agg_of_expression", "SELECT l_returnflag, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS net FROM lineitem GROUP BY l_returnflag")
sql("agg_filter", "SELECT COUNT(*) FILTER (WHERE l_quantity > 25) AS n, COUNT(DISTINCT l_suppkey) AS s FROM lineitem")
sql("group_rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("group_sets", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
sql("subquery_corr_sql", "SELECT c_custkey, (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n, (SELECT MAX(o.o_orderkey) FROM orders o WHERE o.o_custkey = c.c_custkey) AS last FROM customer c", "select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n, coalesce((select max(o_orderkey) from orders where o_custkey = c_custkey), 0) as last from customer")
sql("subquery_multicol_sql", "SELECT n_name, (SELECT COUNT(*) AS n, MIN(c_custkey) AS first FROM customer WHERE c_nationkey = n_nationkey) FROM nation", "select n_name, a.n, coalesce(a.first, 0) as first from nation, lateral (select count(*) as n, min(c_custkey) as first from customer where c_nationkey = n_nationkey) a")
sql("subquery_in_not", "SELECT n_name FROM nation WHERE NOT n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey > 1)", "select n_name from nation where n_regionkey <= 1")
sql("subquery_alias_reuse", "SELECT n.n_name, (SELECT COUNT(*) FROM customer n WHERE n.c_nationkey = 3) AS k FROM nation n", "select n_name, (select count(*) from customer where c_nationkey = 3) as k from nation")
sql("window_frame", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM orders")
sql("filter_schemaless", "SELECT c_custkey FROM customer, nation WHERE c_nationkey = n_nationkey AND n_name = (SELECT n_name FROM nation ORDER BY n_name LIMIT 1)", "select c_custkey from customer join nation on c_nationkey = n_nationkey where n_name = (select min(n_name) from nation)")
sql("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier")
sql("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier")
sql("set_top", "SELECT TOP 1 r_regionkey AS k FROM region WHERE r_regionkey = 2 UNION ALL SELECT n_nationkey AS k FROM nation ORDER BY k", "select 2 as k union all select n_nationkey from nation")
sql("cte_chain", "WITH a AS (SELECT c_nationkey AS k, c_acctbal AS v FROM customer), b(k, total) AS (SELECT k, COUNT(*) FROM a WHERE v != 0 GROUP BY k) SELECT n_name, total FROM nation JOIN b ON n_nationkey = k", "with a as (select c_nationkey as k, c_acctbal as v from customer), b(k, total) as (select k, count(*) from a where v <> 0 group by k) select n_name, total from nation join b on n_nationkey = k")
sql("lock_and_schema", "SELECT r_name FROM public.region WHERE r_regionkey = 1 FOR UPDATE", "select r_name from region where r_regionkey = 1")
sql("case_when", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'even' END AS class FROM customer")
sql("quoted_names", 'SELECT "c_name" AS "full name" FROM customer WHERE "c_mktsegment" = \'BUILDING\'')
sql("window_sql", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS BIGINT) AS r, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS most FROM orders")

sql("const_div_column", "SELECT n_nationkey, n_nationkey * 7 / 2 AS half FROM nation")
sql("const_div_bracket", "SELECT n_name FROM nation WHERE n_nationkey = (1 + 6) / 2", "select n_name from nation where n_nationkey = 3")
sql("const_promote", "SELECT n_name FROM nation WHERE n_nationkey > 7 / 2.0", "select n_name from nation where n_nationkey > 3")
sql("const_escape", "SELECT r_regionkey, 'it''s' AS t FROM region WHERE 'a\\' + 'b' = 'a\\b'", "select r_regionkey, 'it''s' as t from region")


@query("select o_custkey, o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders")
def window_rank(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("r"))


@query("select l_orderkey, l_linenumber, round(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey), 2) as running from lineitem")
def window_sum(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(w), 2).alias("running"))


FLAGSHIP = """
select c_custkey, c_name, n_name, round(coalesce((select sum(o_totalprice) from orders where o_custkey = c_custkey and o_orderdate > timestamp '1995-01-01 00:00:00'), 0), 2) as total
from customer, nation where c_nationkey = n_nationkey and c_acctbal > 0
"""


@query(FLAGSHIP)
def flagship(t):
    """Customers in credit with their nation and the value of their later orders."""
    late = t.orders.where(S.gt(F.col("o_orderdate"), "1995-01-01", TS))
    who = t.customer.where(F.col("c_acctbal") > 0).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")
    return R.correlated_total(who, late, "c_custkey", "o_custkey", "o_totalprice", "total").withColumn("total", F.round("total", 2))
