"""Aggregation, subtotals, pivots and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions import ora as o
from tamarack.operators.bounded import small
from tamarack.operators.relational import dynamic_pivot, hypothetical, keep
from tamarack.plans.base import Plans
from tamarack.session import table as t

P = Plans()
S = SparkSession

_SALES = "SELECT n_regionkey AS region, c_mktsegment AS segment, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,4)) AS amount, o_custkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def _sales(s: S, d: str) -> DataFrame:
    x = t(s, d, "orders").select("o_custkey", "o_orderstatus", "o_totalprice").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(small(t(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.select(F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status"), o.exact(F.col("o_totalprice")).alias("amount"), "o_custkey", "n_name")


@P.query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS sum_price, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY 1, 2 HAVING count(*) > 10")
def group_having(s: S, d: str) -> DataFrame:
    """GROUP BY and HAVING with SUM, AVG, COUNT; the date filter reaches the scan."""
    x = t(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-06-01").cast("timestamp_ntz"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(o.exact(F.col("l_quantity"))).cast("double").alias("sum_qty"), F.sum(o.exact(F.col("l_extendedprice"))).cast("double").alias("sum_price"),
        F.sum(o.exact(F.col("l_extendedprice") * (1 - F.col("l_discount")))).cast("double").alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"),
    ).where("n > 10")


@P.query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS states, min(o_totalprice) AS low, max(o_totalprice) AS high, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS finished, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS top_pending FROM orders GROUP BY 1")
def distinct_and_conditional(s: S, d: str) -> DataFrame:
    """COUNT(DISTINCT), MIN, MAX and conditional aggregates."""
    return t(s, d, "orders").groupBy("o_orderpriority").agg(
        F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderstatus").alias("states"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"),
        F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("finished"), F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("top_pending"),
    )


@P.query("SELECT 'all' AS scope, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM orders HAVING count(*) > 1")
def having_without_group(s: S, d: str) -> DataFrame:
    """HAVING without GROUP BY."""
    return t(s, d, "orders").agg(F.lit("all").alias("scope"), F.count("*").alias("n"), F.sum(o.exact(F.col("o_totalprice"))).cast("double").alias("total")).where("n > 1")


@P.query(f"SELECT region, segment, grouping(region) AS g_region, grouping(region) * 2 + grouping(segment) AS gid, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n FROM ({_SALES}) GROUP BY ROLLUP (region, segment)")
def rollup(s: S, d: str) -> DataFrame:
    """ROLLUP with GROUPING and GROUPING_ID."""
    return _sales(s, d).rollup("region", "segment").agg(F.grouping("region").cast("long").alias("g_region"), (F.grouping("region") * 2 + F.grouping("segment")).cast("long").alias("gid"), F.sum("amount").cast("double").alias("total"), F.count("*").alias("n"))


@P.query(f"SELECT region, segment, grouping(region) * 2 + grouping(segment) AS gid, CAST(sum(amount) AS DOUBLE) AS total FROM ({_SALES}) GROUP BY CUBE (region, segment)")
def cube(s: S, d: str) -> DataFrame:
    """CUBE."""
    return _sales(s, d).cube("region", "segment").agg(F.grouping_id("region", "segment").cast("long").alias("gid"), F.sum("amount").cast("double").alias("total"))


@P.query(f"SELECT region, segment, status, CAST(sum(amount) AS DOUBLE) AS total FROM ({_SALES}) GROUP BY GROUPING SETS ((region, segment), (status), ())")
def grouping_sets(s: S, d: str) -> DataFrame:
    """GROUPING SETS."""
    return s.sql("SELECT region, segment, status, CAST(sum(amount) AS DOUBLE) AS total FROM {x} GROUP BY GROUPING SETS ((region, segment), (status), ())", x=_sales(s, d))


@P.query(f"SELECT region, segment, status, CAST(sum(amount) AS DOUBLE) AS total FROM ({_SALES}) GROUP BY ROLLUP (region, segment), status")
def rollup_plus_key(s: S, d: str) -> DataFrame:
    """ROLLUP combined with a plain key: subtotals stay split by it."""
    return s.sql("SELECT region, segment, status, CAST(sum(amount) AS DOUBLE) AS total FROM {x} GROUP BY ROLLUP (region, segment), status", x=_sales(s, d))


@P.query("SELECT r_name, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names, string_agg(DISTINCT CAST(n_regionkey AS VARCHAR), ',') AS keys FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def listagg(s: S, d: str) -> DataFrame:
    """LISTAGG WITHIN GROUP and DISTINCT."""
    return s.sql("SELECT r_name, listagg(n_name, '; ') WITHIN GROUP (ORDER BY n_name DESC) AS names, listagg(DISTINCT CAST(n_regionkey AS STRING), ',') AS keys FROM {region} JOIN {nation} ON r_regionkey = n_regionkey GROUP BY r_name", region=t(s, d, "region"), nation=t(s, d, "nation"))


@P.query("SELECT n_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_nationkey) || ']' AS names, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS object, string_agg('<n>' || n_name || '</n>', '' ORDER BY n_nationkey) AS xml FROM nation GROUP BY 1")
def json_and_xml_aggregates(s: S, d: str) -> DataFrame:
    """JSON_ARRAYAGG, JSON_OBJECTAGG, XMLAGG and COLLECT in a stated order."""
    x = t(s, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("by_key"), F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("by_name"))
    return x.select(
        "n_regionkey", F.to_json(F.transform("by_key", lambda r: r["n_name"])).alias("names"), F.to_json(F.map_from_entries("by_name")).alias("object"),
        F.array_join(F.transform("by_key", lambda r: F.concat(F.lit("<n>"), r["n_name"], F.lit("</n>"))), "").alias("xml"),
    )


@P.query("""
    WITH r AS (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS f, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS l FROM orders WHERE o_custkey IS NOT NULL)
    SELECT o_custkey, min(CASE WHEN f = 1 THEN o_totalprice END) AS first_low, max(CASE WHEN f = 1 THEN o_totalprice END) AS first_high, count(CASE WHEN l = 1 THEN 1 END) AS last_n, CAST(sum(CASE WHEN l = 1 THEN CAST(o_totalprice AS DECIMAL(18,4)) END) AS DOUBLE) AS last_sum FROM r GROUP BY 1""")
def keep_first_last(s: S, d: str) -> DataFrame:
    """KEEP (DENSE_RANK FIRST|LAST ORDER BY): aggregates over all rows that tie for the extreme."""
    x = t(s, d, "orders").where("o_custkey is not null").select("o_custkey", "o_orderdate", "o_totalprice")
    first = keep(x, ["o_custkey"], F.col("o_orderdate"), {"first_low": F.min("o_totalprice"), "first_high": F.max("o_totalprice")})
    last = keep(x, ["o_custkey"], F.col("o_orderdate"), {"last_n": F.count("*"), "last_sum": F.sum(o.exact(F.col("o_totalprice"))).cast("double")}, last=True)
    return first.join(last, "o_custkey")


@P.query("SELECT l_returnflag, round(median(l_quantity), 6) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90_cont, quantile_disc(l_quantity, 0.25) AS p25_disc, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS cor, round(covar_samp(l_discount, l_tax), 8) AS cov, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS icept FROM lineitem GROUP BY 1")
def statistics(s: S, d: str) -> DataFrame:
    """MEDIAN, PERCENTILE_CONT and DISC, STDDEV, VAR_POP, CORR, COVAR, REGR_SLOPE and REGR_INTERCEPT."""
    return t(s, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.median("l_quantity"), 6).alias("med"), F.expr("round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice), 4)").alias("p90_cont"), F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity)").alias("p25_disc"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.var_pop("l_quantity"), 6).alias("vp"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("cor"), F.round(F.covar_samp("l_discount", "l_tax"), 8).alias("cov"),
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("icept"),
    )


@P.query("SELECT c_mktsegment, count(CASE WHEN c_acctbal < 1000 THEN 1 END) + 1 AS rank, count(DISTINCT CASE WHEN c_acctbal < 1000 THEN c_acctbal END) + 1 AS dense_rank, count(CASE WHEN c_acctbal < 1000 THEN 1 END) / count(*) AS percent_rank, (count(CASE WHEN c_acctbal <= 1000 THEN 1 END) + 1) / (count(*) + 1) AS cume_dist FROM customer GROUP BY 1")
def hypothetical_rank(s: S, d: str) -> DataFrame:
    """RANK(1000), DENSE_RANK, PERCENT_RANK and CUME_DIST WITHIN GROUP."""
    return hypothetical(t(s, d, "customer"), ["c_mktsegment"], "c_acctbal", 1000.0)


@P.query()
def approximate_distinct(s: S, d: str) -> DataFrame:
    """Approximate distinct counts by sketch, to 2 percent; the error is tested, as no other engine gives the same estimate."""
    return t(s, d, "orders").groupBy("o_orderpriority").agg(F.approx_count_distinct("o_custkey", 0.02).alias("customers"))


@P.query("SELECT c_mktsegment, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,4)) END), 0) AS DOUBLE) AS f_total, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f_n, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,4)) END), 0) AS DOUBLE) AS o_total, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o_n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def pivot_static(s: S, d: str) -> DataFrame:
    """PIVOT of stated values with aliases and several aggregates."""
    x = _sales(s, d).where("status in ('F', 'O')").groupBy(F.col("segment").alias("c_mktsegment")).pivot("status", ["F", "O"]).agg(F.coalesce(F.sum("amount").cast("double"), F.lit(0.0)).alias("total"), F.count(F.lit(1)).alias("n"))
    return x.select("c_mktsegment", F.coalesce("F_total", F.lit(0.0)).alias("f_total"), F.coalesce("F_n", F.lit(0).cast("long")).alias("f_n"), F.coalesce("O_total", F.lit(0.0)).alias("o_total"), F.coalesce("O_n", F.lit(0).cast("long")).alias("o_n"))


@P.query("SELECT c_nationkey, " + ", ".join(f"count(CASE WHEN c_mktsegment = '{m}' THEN 1 END) AS \"M_{m}\"" for m in ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]) + " FROM customer GROUP BY 1")
def pivot_dynamic(s: S, d: str) -> DataFrame:
    """PIVOT whose columns are found at run time."""
    x = dynamic_pivot(t(s, d, "customer").select("c_nationkey", "c_mktsegment"), ["c_nationkey"], "c_mktsegment", F.count(F.lit(1)), prefix="M_")
    return x.select("c_nationkey", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in x.columns if c != "c_nationkey"])


@P.query("""WITH x AS (SELECT p_partkey, CAST(nullif(p_size, 10) AS DOUBLE) AS size, p_retailprice AS price FROM part)
    SELECT p_partkey, 'size' AS measure, size AS v, 'exclude' AS nulls FROM x WHERE size IS NOT NULL UNION ALL SELECT p_partkey, 'price', price, 'exclude' FROM x WHERE price IS NOT NULL
    UNION ALL SELECT p_partkey, 'size', size, 'include' FROM x UNION ALL SELECT p_partkey, 'price', price, 'include' FROM x""")
def unpivot_nulls(s: S, d: str) -> DataFrame:
    """UNPIVOT with nulls excluded and included."""
    x = t(s, d, "part").select("p_partkey", F.nullif("p_size", F.lit(10)).cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    long = x.unpivot("p_partkey", ["size", "price"], "measure", "v")
    return long.where("v is not null").withColumn("nulls", F.lit("exclude")).unionByName(long.withColumn("nulls", F.lit("include")))


# Windows


@P.query("""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS dr, ntile(4) OVER w AS nt,
    lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 1, 0.0) OVER w AS nxt, o_totalprice - lag(o_totalprice) OVER w AS lag_diff, first_value(o_orderkey) OVER w AS fv, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv,
    nth_value(o_orderkey, 2) OVER w AS second, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_ranking(s: S, d: str) -> DataFrame:
    """ROW_NUMBER, RANK, DENSE_RANK, NTILE, LAG, LEAD, FIRST, LAST and NTH_VALUE, PERCENT_RANK, CUME_DIST over one sort."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    by_date, prev = Window.partitionBy("o_custkey").orderBy("o_orderdate"), F.lag("o_totalprice")
    long = lambda c: c.cast("long")
    return t(s, d, "orders").select(
        "o_orderkey", long(F.row_number().over(w)).alias("rn"), long(F.rank().over(by_date)).alias("rk"), long(F.dense_rank().over(by_date)).alias("dr"), long(F.ntile(4).over(w)).alias("nt"),
        prev.over(w).alias("prev"), F.lead("o_totalprice", 1, 0.0).over(w).alias("nxt"), (F.col("o_totalprice") - prev.over(w)).alias("lag_diff"), F.first("o_orderkey").over(w).alias("fv"),
        F.last("o_orderkey").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("lv"), F.nth_value("o_orderkey", 2).over(w).alias("second"), F.round(F.percent_rank().over(w), 8).alias("pr"), F.round(F.cume_dist().over(w), 8).alias("cd"),
    )


@P.query("""SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)) AS DOUBLE) AS running, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving,
    count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS last_90, round(o_totalprice / nullif(CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) OVER (PARTITION BY o_custkey) AS DOUBLE), 0), 8) AS ratio,
    max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS next_two FROM orders""")
def window_frames(s: S, d: str) -> DataFrame:
    """Running sum (ties share it), moving average, interval RANGE frame, RATIO_TO_REPORT, FOLLOWING frame."""
    x = t(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", F.col("o_orderdate").cast("date").alias("day")).withColumn("day_no", F.unix_date("day"))
    c, rows = Window.partitionBy("o_custkey"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return x.select(
        "o_orderkey", F.sum(o.exact(F.col("o_totalprice"))).over(c.orderBy("day")).cast("double").alias("running"), F.round(F.avg("o_totalprice").over(rows.rowsBetween(-2, 0)), 4).alias("moving"),
        F.count("*").over(c.orderBy("day_no").rangeBetween(-90, 0)).alias("last_90"), F.round(F.col("o_totalprice") / F.nullif(F.sum(o.exact(F.col("o_totalprice"))).over(c).cast("double"), F.lit(0.0)), 8).alias("ratio"),
        F.max("o_totalprice").over(rows.rowsBetween(1, 2)).alias("next_two"),
    )


@P.query("""WITH x AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM events)
    SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_known, len(list_distinct(list(CAST(floor(v) AS BIGINT)) FILTER (WHERE v IS NOT NULL) OVER (PARTITION BY user_id)))::INTEGER AS kinds FROM x""")
def window_ignore_nulls(s: S, d: str) -> DataFrame:
    """LAG ... IGNORE NULLS and COUNT(DISTINCT) OVER; the distinct count is an aggregate joined back, without a set in memory."""
    x = t(s, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kinds = x.groupBy("user_id").agg(F.count_distinct(F.floor("v")).cast("int").alias("kinds"))
    return x.withColumn("prev_known", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).join(kinds, "user_id").select("event_id", "prev_known", "kinds")
