"""Sorting, limits, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import ora as o
from tamarack.operators.relational import fetch_percent, multiset, next_values, sampled, with_ties
from tamarack.plans.base import Plans
from tamarack.session import table as t

P = Plans()
S = SparkSession


@P.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def fetch_first(s: S, d: str) -> DataFrame:
    """FETCH FIRST n ROWS ONLY, planned as a top-k without a full sort."""
    return t(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@P.query("SELECT l_quantity, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, rank() OVER (ORDER BY l_quantity DESC, l_discount DESC) AS r FROM lineitem) WHERE r <= 10")
def fetch_with_ties(s: S, d: str) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES."""
    return with_ties(t(s, d, "lineitem").select("l_quantity", "l_discount", "l_orderkey", "l_linenumber", "l_partkey"), ["l_quantity", "l_discount"], 10, descending=True).select("l_quantity", "l_orderkey", "l_linenumber", "l_partkey")


@P.query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn, count(*) OVER () AS n FROM orders) WHERE rn <= ceil(n * 2.5 / 100)")
def fetch_percent_rows(s: S, d: str) -> DataFrame:
    """FETCH FIRST p PERCENT ROWS ONLY."""
    return fetch_percent(t(s, d, "orders").select("o_orderkey", "o_totalprice"), 2.5, F.col("o_totalprice").desc(), F.col("o_orderkey")).select("o_orderkey")


@P.query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 40")
def offset_page(s: S, d: str) -> DataFrame:
    """OFFSET n ROWS FETCH NEXT m ROWS ONLY."""
    return t(s, d, "customer").orderBy("c_acctbal", "c_custkey").offset(40).limit(20).select("c_custkey", "c_name")


@P.query("SELECT c_custkey, row_number() OVER (ORDER BY k ASC NULLS LAST, c_custkey) AS up, row_number() OVER (ORDER BY k DESC NULLS FIRST, c_custkey) AS down FROM (SELECT c_custkey, nullif(c_nationkey, 7) AS k FROM customer)")
def null_ordering(s: S, d: str) -> DataFrame:
    """Nulls last ascending and first descending by default; positions of all rows by range-partitioned numbering, not by one task."""
    x = t(s, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(7)).alias("k"))
    up = next_values(x, "up", 1, o.asc("k"), "c_custkey").select("c_custkey", "up")
    return up.join(next_values(x, "down", 1, o.desc("k"), "c_custkey").select("c_custkey", "down"), "c_custkey")


@P.query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def set_union(s: S, d: str) -> DataFrame:
    """UNION."""
    return t(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")).union(t(s, d, "supplier").where("s_acctbal < 0").select("s_nationkey")).distinct()


@P.query("SELECT 'c' AS src, c_nationkey AS k, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 's', s_nationkey, count(*) FROM supplier GROUP BY 2")
def set_union_all(s: S, d: str) -> DataFrame:
    """UNION ALL."""
    a = t(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n")).withColumn("src", F.lit("c"))
    b = t(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n")).withColumn("src", F.lit("s"))
    return a.unionByName(b)


@P.query("SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_intersect(s: S, d: str) -> DataFrame:
    """INTERSECT."""
    return t(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")).intersect(t(s, d, "orders").where("o_totalprice > 300000").select("o_custkey"))


@P.query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_minus(s: S, d: str) -> DataFrame:
    """MINUS."""
    return t(s, d, "customer").select(F.col("c_custkey").alias("k")).subtract(t(s, d, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@P.query("SELECT l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def multiset_except(s: S, d: str) -> DataFrame:
    """MULTISET EXCEPT: bags, every copy counts."""
    x = t(s, d, "lineitem").select("l_partkey", "l_quantity", "l_returnflag")
    return multiset("except", x.where("l_returnflag = 'A'").drop("l_returnflag"), x.where("l_returnflag = 'R'").drop("l_returnflag"))


@P.query("SELECT l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'A' INTERSECT ALL SELECT l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def multiset_intersect(s: S, d: str) -> DataFrame:
    """MULTISET INTERSECT."""
    x = t(s, d, "lineitem").select("l_partkey", "l_quantity", "l_returnflag")
    return multiset("intersect", x.where("l_returnflag = 'A'").drop("l_returnflag"), x.where("l_returnflag = 'R'").drop("l_returnflag"))


@P.query("SELECT DISTINCT l_partkey, l_quantity FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity > 48")
def multiset_union_distinct(s: S, d: str) -> DataFrame:
    """MULTISET UNION DISTINCT."""
    x = t(s, d, "lineitem").where("l_quantity > 48").select("l_partkey", "l_quantity", "l_returnflag")
    return multiset("union", x.where("l_returnflag = 'A'").drop("l_returnflag"), x.where("l_returnflag = 'R'").drop("l_returnflag"), distinct=True)


@P.query("SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '#7'), 1, 8) AS BIGINT) < 429496730")
def sample_seed(s: S, d: str) -> DataFrame:
    """SAMPLE (10) SEED (7): by the hash of the key, so that a lost executor or another partitioning changes nothing."""
    return sampled(t(s, d, "orders"), ["o_orderkey"], 10, 7).select("o_orderkey")


@P.query("SELECT o_orderkey, o_custkey FROM orders WHERE CAST('0x' || substr(md5(CAST(o_custkey AS VARCHAR) || '#3'), 1, 8) AS BIGINT) < 858993459.2")
def sample_block(s: S, d: str) -> DataFrame:
    """SAMPLE BLOCK (20) SEED (3): all rows of the blocks chosen, here of a customer."""
    return sampled(t(s, d, "orders"), ["o_custkey"], 20, 3).select("o_orderkey", "o_custkey")


@P.query("SELECT o_orderkey, 5000 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS seq FROM orders")
def sequence_numbers(s: S, d: str) -> DataFrame:
    """Sequence NEXTVAL in a stated order, numbered by partition instead of in one task."""
    return next_values(t(s, d, "orders").select("o_orderkey", "o_orderdate"), "seq", 5000, "o_orderdate", "o_orderkey").select("o_orderkey", "seq")
