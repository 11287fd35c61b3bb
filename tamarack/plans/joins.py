"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import ora as o
from tamarack.operators.bounded import small
from tamarack.operators.relational import densify
from tamarack.plans.base import Plans
from tamarack.session import table as t

P = Plans()
S = SparkSession


@P.query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000")
def join_inner(s: S, d: str) -> DataFrame:
    """INNER JOIN; the small side is broadcast after a check of its size, the others are left to adaptive execution."""
    x = t(s, d, "orders").where("o_totalprice > 300000").select("o_orderkey", "o_custkey").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return x.join(small(t(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@P.query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(max(o_totalprice), 0) AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def join_left(s: S, d: str) -> DataFrame:
    """LEFT OUTER with a condition on the right side; orders are aggregated before they are shuffled."""
    per = t(s, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    return t(s, d, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("top", F.lit(0.0)).alias("top"))


@P.query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def join_right(s: S, d: str) -> DataFrame:
    """RIGHT OUTER."""
    return t(s, d, "supplier").where("s_acctbal > 5000").join(t(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


@P.query("WITH a AS (SELECT s_nationkey AS k, count(*) AS ns FROM supplier WHERE s_acctbal > 8000 GROUP BY 1), b AS (SELECT c_nationkey AS k, count(*) AS nc FROM customer WHERE c_acctbal > 9000 GROUP BY 1) SELECT coalesce(a.k, b.k) AS nation, ns, nc FROM a FULL JOIN b ON a.k = b.k")
def join_full(s: S, d: str) -> DataFrame:
    """FULL OUTER."""
    a = t(s, d, "supplier").where("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("ns"))
    b = t(s, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("nc"))
    return a.join(b, "nation", "full")


@P.query("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def join_cross(s: S, d: str) -> DataFrame:
    """CROSS JOIN of two tables of five rows, which is what the operator means."""
    r = small(t(s, d, "region"))
    return r.select(F.col("r_name").alias("a")).crossJoin(r.select(F.col("r_name").alias("b")))


@P.query("SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) NATURAL JOIN (SELECT s_nationkey AS k, s_name FROM supplier)")
def join_natural(s: S, d: str) -> DataFrame:
    """NATURAL JOIN: on all columns of the same name."""
    a, b = t(s, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), t(s, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_name")
    return a.join(b, [c for c in a.columns if c in b.columns])


@P.query("SELECT k, n_name, c_name FROM (SELECT n_nationkey AS k, n_name FROM nation) JOIN (SELECT c_nationkey AS k, c_name FROM customer) USING (k)")
def join_using(s: S, d: str) -> DataFrame:
    """JOIN ... USING."""
    return t(s, d, "customer").select(F.col("c_nationkey").alias("k"), "c_name").join(small(t(s, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")), "k")


@P.query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def join_semi(s: S, d: str) -> DataFrame:
    """EXISTS and IN as a semi join."""
    return t(s, d, "customer").select("c_custkey").join(t(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@P.query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 200000)")
def join_anti(s: S, d: str) -> DataFrame:
    """NOT EXISTS as an anti join."""
    return t(s, d, "customer").select("c_custkey").join(t(s, d, "orders").where("o_orderstatus = 'P' and o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@P.query("SELECT 'with null' AS kind, count(*) AS n FROM nation WHERE n_regionkey NOT IN (SELECT CASE WHEN r_regionkey = 2 THEN NULL ELSE r_regionkey END FROM region) UNION ALL SELECT 'without', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 3)")
def join_not_in(s: S, d: str) -> DataFrame:
    """NOT IN as a null-aware anti join: a null in the list excludes every row."""
    q = "SELECT '{}' AS kind, count(*) AS n FROM {{nation}} WHERE n_regionkey NOT IN (SELECT {} FROM {{region}} WHERE r_regionkey < {})"
    frames = {"nation": t(s, d, "nation"), "region": t(s, d, "region")}
    return s.sql(q.format("with null", "CASE WHEN r_regionkey = 2 THEN NULL ELSE r_regionkey END", 99), **frames).unionByName(s.sql(q.format("without", "r_regionkey", 3), **frames))


@P.query("SELECT r_name, n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name DESC LIMIT 2) x")
def cross_apply(s: S, d: str) -> DataFrame:
    """CROSS APPLY and LATERAL: the first rows of a correlated subquery for each outer row."""
    n = t(s, d, "nation").where(F.col("n_regionkey") == F.col("r_regionkey").outer()).orderBy(F.col("n_name").desc()).select("n_name").limit(2)
    return t(s, d, "region").lateralJoin(n, how="cross").select("r_name", "n_name")


@P.query("SELECT n_name, s_name FROM nation LEFT JOIN LATERAL (SELECT s_name FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) x ON true")
def outer_apply(s: S, d: str) -> DataFrame:
    """OUTER APPLY: outer rows without inner rows stay."""
    x = t(s, d, "supplier").where((F.col("s_nationkey") == F.col("n_nationkey").outer()) & (F.col("s_acctbal") > 9000)).select("s_name")
    return t(s, d, "nation").lateralJoin(x, how="left").select("n_name", "s_name")


@P.query("""
    SELECT n.n_name, m.month, coalesce(x.n_orders, 0) AS n_orders, sum(coalesce(x.n_orders, 0)) OVER (PARTITION BY n.n_name ORDER BY m.month ROWS UNBOUNDED PRECEDING)::BIGINT AS running
    FROM nation n CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '1997-01-01', DATE '1997-12-01', INTERVAL 1 MONTH)) AS DATE) AS month) m
    LEFT JOIN (SELECT n_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P' GROUP BY 1, 2) x ON x.n_name = n.n_name AND x.month = m.month
    WHERE n.n_name IN (SELECT n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P')""")
def partitioned_outer_join(s: S, d: str) -> DataFrame:
    """PARTITION BY ... OUTER JOIN: every nation with every month of a year, with a running sum over the holes."""
    from pyspark.sql import Window

    x = t(s, d, "orders").where("o_orderstatus = 'P'").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(small(t(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    facts = x.groupBy("n_name", F.trunc("o_orderdate", "MM").alias("month")).agg(F.count("*").alias("n_orders"))
    months = s.range(12).select(F.add_months(F.lit("1997-01-01").cast("date"), F.col("id").cast("int")).alias("month"))
    dense = densify(facts, ["n_name"], months, ["month"]).select("n_name", "month", F.coalesce("n_orders", F.lit(0).cast("long")).alias("n_orders"))
    return dense.withColumn("running", F.sum("n_orders").over(Window.partitionBy("n_name").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))


_RULES = [(1, None, 0.0, 20.0, 0.0), (2, "ECONOMY", 0.0, 50.0, 0.1), (3, None, 20.0, 40.0, 0.05), (4, "STANDARD", 10.0, 60.0, 0.15), (5, None, 40.0, 1000.0, 0.2)]


@P.query("""
    WITH rule(rule_id, kind, lo, hi, disc) AS (VALUES (1, NULL, 0.0, 20.0, 0.0), (2, 'ECONOMY', 0.0, 50.0, 0.1), (3, NULL, 20.0, 40.0, 0.05), (4, 'STANDARD', 10.0, 60.0, 0.15), (5, NULL, 40.0, 1000.0, 0.2))
    SELECT p_type, rule_id, count(*) AS lines, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey JOIN rule ON (kind IS NULL OR kind = p_type) AND l_quantity >= lo AND l_quantity < hi GROUP BY 1, 2""")
def join_range_rules(s: S, d: str) -> DataFrame:
    """Theta join with bands and wildcards: a constant rule table of five rows is broadcast."""
    rules = F.broadcast(s.createDataFrame(_RULES, "rule_id int, kind string, lo double, hi double, disc double"))
    lines = t(s, d, "lineitem").select("l_partkey", "l_quantity").join(t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    on = o.wildcard(F.col("kind"), F.col("p_type")) & (F.col("l_quantity") >= F.col("lo")) & (F.col("l_quantity") < F.col("hi"))
    return lines.join(rules, on).groupBy("p_type", "rule_id").agg(F.count("*").alias("lines"), F.sum(o.exact(F.col("l_quantity"))).cast("double").alias("qty"))


@P.query("SELECT a.from_uom AS unit, b.from_uom AS base, CAST(a.factor AS DOUBLE) / CAST(b.factor AS DOUBLE) AS ratio FROM t_uom_conversion a JOIN t_uom_conversion b ON a.to_uom = b.to_uom AND a.from_uom < b.from_uom")
def join_self(s: S, d: str) -> DataFrame:
    """Self join: units related through a common one."""
    x = small(t(s, d, "t_uom_conversion"))
    a, b = x.alias("a"), x.alias("b")
    return a.join(b, (F.col("a.to_uom") == F.col("b.to_uom")) & (F.col("a.from_uom") < F.col("b.from_uom"))).select(
        F.col("a.from_uom").alias("unit"), F.col("b.from_uom").alias("base"), (F.col("a.factor").cast("double") / F.col("b.factor").cast("double")).alias("ratio")
    )


@P.query("""SELECT c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) x ON c_custkey = o_custkey AND rn = 1""")
def join_latest_per_key(s: S, d: str) -> DataFrame:
    """The latest row of each key: max of a struct, combined before the shuffle, instead of a window."""
    last = t(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("x"))
    return t(s, d, "customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", "x.o_orderkey", F.col("x.o_orderdate").cast("date").alias("o_orderdate"))


@P.query("""WITH a AS (SELECT nullif(n_regionkey, 2) AS k, count(*) AS n FROM nation GROUP BY 1), b AS (SELECT nullif(r_regionkey, 2) AS k, r_name FROM region) SELECT r_name, n FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def join_null_safe(s: S, d: str) -> DataFrame:
    """Keys that are null match each other (NVL(a, -1) = NVL(b, -1))."""
    a = t(s, d, "nation").groupBy(F.nullif("n_regionkey", F.lit(2)).alias("k")).agg(F.count("*").alias("n"))
    b = t(s, d, "region").select(F.nullif("r_regionkey", F.lit(2)).alias("k2"), "r_name")
    return a.join(b, F.col("k").eqNullSafe(F.col("k2"))).select("r_name", "n")


@P.query("""SELECT bom_id, item_id, effective_from FROM (SELECT DISTINCT bom_id, item_id, effective_from, status, effective_to FROM t_bom_header) h WHERE status = 'ACTIVE' AND effective_from <= DATE '2024-06-30' AND (effective_to IS NULL OR effective_to >= DATE '2024-06-30')""")
def effective_dated(s: S, d: str) -> DataFrame:
    """Rows in force on a day: from <= day and (to is null or to >= day)."""
    h = t(s, d, "t_bom_header").where("status = 'ACTIVE'").where(o.effective_at(F.col("effective_from"), F.col("effective_to"), F.lit("2024-06-30").cast("date")))
    return h.select("bom_id", "item_id", "effective_from").distinct()
