"""Projection, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import ora as o
from tamarack.operators.bounded import small
from tamarack.operators.relational import is_submultiset, next_values, quantified, ranked
from tamarack.plans.base import Plans
from tamarack.session import table as t

P = Plans()
S = SparkSession


@P.query("""
    WITH v AS (SELECT l_partkey AS part_key, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS value FROM lineitem GROUP BY 1 HAVING sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) > 0),
    w AS (SELECT part_key, value, CAST(value AS DOUBLE) / sum(CAST(value AS DOUBLE)) OVER () AS share, sum(value) OVER (ORDER BY value DESC) AS cum, sum(value) OVER () AS total, row_number() OVER (ORDER BY value DESC, part_key) AS value_rank FROM v)
    SELECT part_key, CAST(value AS DOUBLE) AS stock_value, round(100 * share, 4) AS value_pct, round(100 * CAST(cum AS DOUBLE) / CAST(total AS DOUBLE), 4) AS cum_pct, value_rank,
      CASE WHEN 100 * CAST(cum AS DOUBLE) / CAST(total AS DOUBLE) <= 80 THEN 'A' WHEN 100 * CAST(cum AS DOUBLE) / CAST(total AS DOUBLE) <= 95 THEN 'B' ELSE 'C' END AS abc_class FROM w""")
def pareto_abc(s: S, d: str) -> DataFrame:
    """Value of each part, its share, running share (ties share it), rank and ABC class, without a window over the whole table."""
    value = t(s, d, "lineitem").groupBy(F.col("l_partkey").alias("part_key")).agg(F.sum(o.exact(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("value")).where("value > 0")
    value = next_values(value, "value_rank", 1, F.col("value").desc(), F.col("part_key"))
    total = value.agg(F.sum("value").alias("total"))
    w = ranked(value, "value", ["value"]).crossJoin(F.broadcast(total))
    cum = 100 * F.col("cum_value").cast("double") / F.col("total").cast("double")
    return w.select(
        "part_key", F.col("value").cast("double").alias("stock_value"), F.round(100 * (F.col("value").cast("double") / F.col("total").cast("double")), 4).alias("value_pct"), F.round(cum, 4).alias("cum_pct"), "value_rank",
        F.when(cum <= 80, "A").when(cum <= 95, "B").otherwise("C").alias("abc_class"),
    )


@P.query("""
    WITH x AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal, c_nationkey AS nk FROM customer)
    SELECT c_custkey, coalesce(seg, 'none') AS nvl_seg, CASE WHEN seg IS NOT NULL THEN 'set' ELSE 'null' END AS nvl2_seg, coalesce(bal, nk, 0) AS coalesce_bal, nullif(nk, 5) AS nullif_nk,
      CASE WHEN seg IS NULL THEN 'N' WHEN seg = 'MACHINERY' THEN 'M' ELSE 'O' END AS decode_seg,
      CASE WHEN bal IS NULL THEN NULL ELSE greatest(bal, CAST(nk * 100 AS DOUBLE)) END AS greatest_bal, CASE WHEN bal IS NULL THEN NULL ELSE least(bal, CAST(nk * 100 AS DOUBLE)) END AS least_bal FROM x""")
def scalar_null(s: S, d: str) -> DataFrame:
    """NVL, NVL2, COALESCE, NULLIF, DECODE, and GREATEST and LEAST that let nulls through."""
    x = t(s, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal"), F.col("c_nationkey").alias("nk"))
    seg, bal, nk = F.col("seg"), F.col("bal"), (F.col("nk") * 100).cast("double")
    return x.select(
        "c_custkey", o.nvl(seg, F.lit("none")).alias("nvl_seg"), o.nvl2(seg, F.lit("set"), F.lit("null")).alias("nvl2_seg"), F.coalesce("bal", "nk", F.lit(0)).alias("coalesce_bal"), F.nullif("nk", F.lit(5)).alias("nullif_nk"),
        o.decode(seg, F.lit(None), F.lit("N"), F.lit("MACHINERY"), F.lit("M"), F.lit("O")).alias("decode_seg"), o.greatest_n(bal, nk).alias("greatest_bal"), o.least_n(bal, nk).alias("least_bal"),
    )


@P.query("""
    SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18,4)), 0) AS DOUBLE) AS rounded, CAST(abs(o_totalprice - 100000) AS DOUBLE) AS dist, trunc(o_totalprice) AS truncated,
      CASE WHEN o_custkey % 7 = 0 THEN o_custkey ELSE o_custkey % (o_custkey % 7) END AS mod_zero, CAST(sign(o_totalprice - 200000) AS DOUBLE) AS sgn, CAST(power(o_custkey % 10, 2) AS DOUBLE) AS squared,
      round(sin(o_custkey), 6) AS sine, CAST(ceil(o_totalprice) AS BIGINT) AS up, CAST(floor(o_totalprice) AS BIGINT) AS down FROM orders""")
def scalar_number(s: S, d: str) -> DataFrame:
    """ROUND half up, ABS, TRUNC, MOD by zero, SIGN, POWER, SIN, CEIL, FLOOR."""
    price, key = F.col("o_totalprice"), F.col("o_custkey")
    return t(s, d, "orders").select(
        "o_orderkey", o.round_n(o.exact(price)).cast("double").alias("rounded"), F.abs(price - 100000).alias("dist"), o.trunc_n(price).cast("double").alias("truncated"), o.mod_o(key, key % 7).alias("mod_zero"),
        F.signum(price - 200000).alias("sgn"), F.pow(key % 10, F.lit(2)).alias("squared"), F.round(F.sin(key), 6).alias("sine"), F.ceil(price).alias("up"), F.floor(price).alias("down"),
    )


@P.query("""
    SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, substr(p_name, 2, 4) AS sub, right(p_name, 3) AS tail, strpos(p_name, 'r') AS first_r,
      lpad(CAST(p_size AS VARCHAR), 6, '*') AS lp, rpad(p_type, 12, '.') AS rp, trim(both 'B' from p_brand) AS tr, translate(p_name, 'aei', '431') AS tl, chr(65 + p_size % 26) AS ch, length(p_name) AS len,
      p_name || '/' || coalesce(nullif(p_type, 'ECONOMY'), '') AS cat, replace(p_brand, '#', '-') AS rpl, reverse(p_name) AS rev, ascii(p_name) AS asc_code FROM part""")
def scalar_string(s: S, d: str) -> DataFrame:
    """SUBSTR from both ends, INSTR, LPAD, RPAD, TRIM, TRANSLATE, CHR, REPLACE and || over nulls."""
    c = F.col
    return t(s, d, "part").select(
        "p_partkey", F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"), o.substr_o(c("p_name"), 2, 4).alias("sub"), o.substr_o(c("p_name"), -3).alias("tail"), o.instr_o(c("p_name"), "r").cast("long").alias("first_r"),
        F.lpad(c("p_size").cast("string"), 6, "*").alias("lp"), F.rpad("p_type", 12, ".").alias("rp"), F.btrim("p_brand", F.lit("B")).alias("tr"), F.translate("p_name", "aei", "431").alias("tl"), F.char(65 + c("p_size") % 26).alias("ch"),
        F.length("p_name").cast("long").alias("len"), o.concat_o(c("p_name"), F.lit("/"), F.nullif("p_type", F.lit("ECONOMY"))).alias("cat"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("rpl"), F.reverse("p_name").alias("rev"), F.ascii("p_name").alias("asc_code"),
    )


@P.query("""
    SELECT p_partkey, regexp_matches(p_name, '^(red|blue)') AS starts, regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked, regexp_extract(p_brand, '([0-9]+)', 1) AS digits,
      CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS INTEGER) AS vowels FROM part""")
def scalar_regexp(s: S, d: str) -> DataFrame:
    """REGEXP_LIKE, REGEXP_REPLACE, REGEXP_SUBSTR and REGEXP_COUNT."""
    return t(s, d, "part").select(
        "p_partkey", F.col("p_name").rlike("^(red|blue)").alias("starts"), F.regexp_replace("p_name", "[aeiou]", "*").alias("masked"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"), F.regexp_count("p_name", F.lit("[aeiou]")).alias("vowels")
    )


@P.query("""
    WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dt FROM orders)
    SELECT o_orderkey, CAST(date_trunc('month', dt) AS DATE) AS month_start, last_day(dt) AS month_end,
      CASE WHEN dt = last_day(dt) THEN last_day(CAST(dt + INTERVAL 1 MONTH AS DATE)) ELSE CAST(dt + INTERVAL 1 MONTH AS DATE) END AS next_month,
      datediff('day', DATE '1998-12-31', dt) AS days, CAST(dt + INTERVAL 10 DAY AS DATE) AS plus10, CAST(extract(year FROM dt) AS INTEGER) AS yr, CAST(extract(quarter FROM dt) AS INTEGER) AS qr, strftime(dt, '%Y%m%d') AS ymd,
      strftime(dt, '%Y-%m') || '/x' AS ym, CASE WHEN dt BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' THEN 'in' ELSE 'out' END AS band,
      CASE WHEN day(dt) = 31 OR dt = last_day(dt) THEN CAST((year(dt) - 1998) * 12 + month(dt) - 12 AS DOUBLE) ELSE round((year(dt) - 1998) * 12 + month(dt) - 12 + (day(dt) - 31) / 31.0, 6) END AS months,
      CAST(dt + CAST(8 - isodow(dt) AS INTEGER) AS DATE) AS next_monday FROM x""")
def scalar_date(s: S, d: str) -> DataFrame:
    """TRUNC(d, 'MM'), LAST_DAY, ADD_MONTHS with month ends, date arithmetic, EXTRACT, TO_CHAR, MONTHS_BETWEEN, NEXT_DAY."""
    x = t(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("dt"))
    dt = F.col("dt")
    return x.select(
        "o_orderkey", F.trunc(dt, "MM").alias("month_start"), F.last_day(dt).alias("month_end"), o.add_months(dt, 1).alias("next_month"), F.datediff(dt, F.lit("1998-12-31").cast("date")).cast("long").alias("days"), F.date_add(dt, 10).alias("plus10"),
        F.year(dt).alias("yr"), F.quarter(dt).alias("qr"), o.to_char_date(dt, "YYYYMMDD").alias("ymd"), F.concat(o.to_char_date(dt, "YYYY-MM"), F.lit("/x")).alias("ym"),
        F.when(dt.between("1997-01-01", "1998-12-31"), "in").otherwise("out").alias("band"), F.round(o.months_between(dt, F.lit("1998-12-31").cast("date")), 6).alias("months"), F.next_day(dt, "Mon").alias("next_monday"),
    )


@P.query("""SELECT o_orderkey, trim(format('{:,.2f}', CAST(o_totalprice AS DECIMAL(18,2)))) AS money, format('{:,.0f}', CAST(o_totalprice AS DECIMAL(18,0))) AS whole, lpad(CAST(o_custkey % 1000 AS VARCHAR), 6, '0') AS code FROM orders""")
def to_char_number(s: S, d: str) -> DataFrame:
    """TO_CHAR of numbers by FM masks."""
    price = o.exact(F.col("o_totalprice"), 2)
    return t(s, d, "orders").select("o_orderkey", o.to_char_number(price, "FM999,999,990.00").alias("money"), o.to_char_number(price, "FM999,999,990").alias("whole"), o.to_char_number(F.col("o_custkey") % 1000, "FM000000").alias("code"))


@P.query("""
    WITH x AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE CAST(p_size AS VARCHAR) || '.5' END AS raw, CASE WHEN p_size % 4 = 0 THEN '1999-13-01' ELSE '1999-12-' || lpad(CAST(1 + p_size % 28 AS VARCHAR), 2, '0') END AS rd FROM part)
    SELECT p_partkey, CAST(coalesce(TRY_CAST(raw AS DECIMAL(18,6)), -1) AS DOUBLE) AS num, TRY_CAST(rd AS DATE) AS dt, CASE WHEN TRY_CAST(raw AS DOUBLE) IS NOT NULL THEN 1 ELSE 0 END AS valid FROM x""")
def conversions(s: S, d: str) -> DataFrame:
    """TO_NUMBER and TO_DATE with a default on conversion error, VALIDATE_CONVERSION."""
    size = F.col("p_size")
    x = t(s, d, "part").select(
        "p_partkey", F.when(size % 3 == 0, F.col("p_name")).otherwise(F.concat(size.cast("string"), F.lit(".5"))).alias("raw"),
        F.when(size % 4 == 0, F.lit("1999-13-01")).otherwise(F.concat(F.lit("1999-12-"), F.lpad((1 + size % 28).cast("string"), 2, "0"))).alias("rd"),
    )
    return x.select("p_partkey", o.to_number(F.col("raw"), F.lit(-1)).cast("double").alias("num"), o.to_date(F.col("rd"), "YYYY-MM-DD").alias("dt"), o.validate_conversion(F.col("raw"), "double").alias("valid"))


@P.query("""
    SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'big' END AS bucket, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS status_no FROM orders
    WHERE (o_orderpriority LIKE '1%' OR o_orderpriority IN ('2-HIGH', '5-LOW')) AND NOT (o_orderstatus = 'P') AND o_totalprice BETWEEN 1000 AND 400000 AND o_custkey <> 5 AND o_orderdate IS NOT NULL AND o_orderpriority NOT LIKE '%!_%' ESCAPE '!'""")
def predicates_and_case(s: S, d: str) -> DataFrame:
    """AND, OR, NOT, comparison, IN, BETWEEN, LIKE with ESCAPE, IS NULL, both forms of CASE; filters and columns reach the scan."""
    x = t(s, d, "orders").where((F.col("o_orderpriority").like("1%") | F.col("o_orderpriority").isin("2-HIGH", "5-LOW")) & ~(F.col("o_orderstatus") == "P") & F.col("o_totalprice").between(1000, 400000) & (F.col("o_custkey") != 5) & F.col("o_orderdate").isNotNull())
    x = x.where(~F.expr("o_orderpriority like '%!_%' escape '!'"))
    return x.select("o_orderkey", F.when(F.col("o_totalprice") < 100000, "small").when(F.col("o_totalprice") < 300000, "mid").otherwise("big").alias("bucket"), o.decode(F.col("o_orderstatus"), F.lit("F"), F.lit(1), F.lit("O"), F.lit(2), F.lit(3)).alias("status_no"))


@P.query("""SELECT s_suppkey, 'above all' AS kind FROM supplier WHERE s_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = 3 AND c_acctbal < 5000)
    UNION ALL SELECT s_suppkey, 'below any' FROM supplier WHERE s_acctbal < ANY (SELECT c_acctbal FROM customer WHERE c_nationkey = 3 AND c_acctbal < 1000)
    UNION ALL SELECT s_suppkey, 'equal any' FROM supplier WHERE s_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
    UNION ALL SELECT s_suppkey, 'unlike all' FROM supplier WHERE s_nationkey <> ALL (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def quantified_any_all(s: S, d: str) -> DataFrame:
    """Comparison with ANY and ALL of a subquery."""
    sup, cust, nat = t(s, d, "supplier"), t(s, d, "customer").where("c_nationkey = 3"), t(s, d, "nation").where("n_regionkey = 1").select("n_nationkey")
    parts = [("above all", "s_acctbal", ">", "ALL", cust.where("c_acctbal < 5000").select("c_acctbal")), ("below any", "s_acctbal", "<", "ANY", cust.where("c_acctbal < 1000").select("c_acctbal")), ("equal any", "s_nationkey", "=", "ANY", nat), ("unlike all", "s_nationkey", "<>", "ALL", nat)]
    out = None
    for kind, column, op, q, sub in parts:
        part = quantified(sup, F.col(column), op, q, sub).select("s_suppkey", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


@P.query("""SELECT c_custkey, c_acctbal, (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = c_nationkey) AS best_supplier, (SELECT count(*) FROM region) AS regions FROM customer
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def scalar_subquery(s: S, d: str) -> DataFrame:
    """Correlated and plain scalar subqueries and EXISTS, as aggregates and joins."""
    best = t(s, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_acctbal").alias("best_supplier"))
    regions = t(s, d, "region").agg(F.count("*").alias("regions"))
    big = t(s, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t(s, d, "customer").join(big, "c_custkey", "left_semi").join(small(best), "c_nationkey", "left").crossJoin(F.broadcast(regions)).select("c_custkey", "c_acctbal", "best_supplier", "regions")


@P.query("""
    WITH x AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderpriority) AS bag FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1)
    SELECT o_custkey, list_contains(bag, '1-URGENT') AS member, len(list_filter(bag, lambda y: y = '5-LOW')) >= 2 AS two_low, len(bag) = 0 AS is_empty, len(list_distinct(bag)) = len(bag) AS is_a_set, CAST(len(bag) AS INTEGER) AS n FROM x""")
def collection_predicates(s: S, d: str) -> DataFrame:
    """MEMBER OF, SUBMULTISET OF, IS EMPTY, IS A SET and COUNT of collections."""
    x = t(s, d, "orders").where("o_custkey is not null").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("bag"))
    bag = F.col("bag")
    return x.select(
        "o_custkey", F.array_contains(bag, "1-URGENT").alias("member"), is_submultiset(F.array(F.lit("5-LOW"), F.lit("5-LOW")), bag).alias("two_low"), (F.size(bag) == 0).alias("is_empty"), (F.size(F.array_distinct(bag)) == F.size(bag)).alias("is_a_set"), F.size(bag).alias("n")
    )


@P.query("""SELECT r_name, string_agg(n_name || ':' || CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS inner_rows FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name""")
def cursor_expression(s: S, d: str) -> DataFrame:
    """CURSOR(subquery): the inner rows of each outer row as a collection."""
    rows = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    x = t(s, d, "region").join(small(t(s, d, "nation")), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(rows.alias("cursor"))
    return x.select("r_name", F.array_join(F.transform("cursor", lambda r: F.concat(r["n_name"], F.lit(":"), r["n_nationkey"].cast("string"))), ",").alias("inner_rows"))


@P.query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000.0 AND o_orderstatus = 'F' AND (NULL IS NULL OR o_custkey = NULL)""")
def bind_variables(s: S, d: str) -> DataFrame:
    """Bound parameters; an optional one that is null restricts nothing and leaves no predicate behind."""
    least, status, customer = 250000.0, "F", None
    x = s.sql("SELECT o_orderkey, o_totalprice, o_custkey FROM {orders} WHERE o_totalprice > :least AND o_orderstatus = :status", args={"least": least, "status": status}, orders=t(s, d, "orders"))
    return (x if customer is None else x.where(F.col("o_custkey") == customer)).drop("o_custkey")


@P.query("""SELECT 1 AS x, 'DUAL' AS y""")
def dual(s: S, d: str) -> DataFrame:  # noqa: ARG001
    """DUAL, the table of one row."""
    return s.range(1).select(F.lit(1).alias("x"), F.lit("DUAL").alias("y"))


@P.query("""SELECT CAST(n AS BIGINT) AS level, CAST(DATE '2024-01-01' + CAST(n - 1 AS INTEGER) AS DATE) AS day FROM range(1, 367) g(n)""")
def row_generator(s: S, d: str) -> DataFrame:  # noqa: ARG001
    """SELECT LEVEL FROM DUAL CONNECT BY LEVEL <= n."""
    return s.range(1, 367).select(F.col("id").alias("level"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") - 1).cast("int")).alias("day"))
