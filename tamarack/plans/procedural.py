"""Functions of users: scalar, aggregate, table; more windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.context import document_number
from tamarack.operators.relational import over_keys
from tamarack.plans.base import Plans
from tamarack.session import table as t

P = Plans()
S = SparkSession


@P.query("SELECT p_partkey, CASE WHEN p_retailprice IS NULL THEN NULL WHEN p_size <= 10 THEN 'A' WHEN p_size <= 30 THEN 'B' ELSE 'C' END AS class, round((p_retailprice + 5) * 1.1 + 2, 6) AS landed FROM part")
def user_scalar_functions(s: S, d: str) -> DataFrame:
    """DETERMINISTIC functions in SQL, inlined by the optimizer (also WITH FUNCTION)."""
    s.sql("CREATE OR REPLACE TEMPORARY FUNCTION tamarack_class(x DOUBLE, a DOUBLE, b DOUBLE) RETURNS STRING RETURN CASE WHEN x IS NULL THEN NULL WHEN x <= a THEN 'A' WHEN x <= b THEN 'B' ELSE 'C' END")
    s.sql("CREATE OR REPLACE TEMPORARY FUNCTION tamarack_landed(p DOUBLE, freight DOUBLE, duty DOUBLE, misc DOUBLE) RETURNS DOUBLE RETURN round((p + freight) * (1 + duty) + misc, 6)")
    return s.sql("SELECT p_partkey, tamarack_class(p_size, 10, 30) AS class, tamarack_landed(p_retailprice, 5, 0.1, 2) AS landed FROM {part}", part=t(s, d, "part"))


@P.query("SELECT n_nationkey, CAST(g AS INTEGER) AS step, n_regionkey * 10 + CAST(g AS INTEGER) AS v FROM nation, range(1, 4) r(g)")
def user_table_function(s: S, d: str) -> DataFrame:
    """A pipelined table function: a SQL table function, joined laterally."""
    s.sql("CREATE OR REPLACE TEMPORARY FUNCTION tamarack_steps(k INT) RETURNS TABLE(step INT, v INT) RETURN SELECT CAST(id AS INT), CAST(k * 10 + id AS INT) FROM range(1, 4)")
    return s.sql("SELECT n_nationkey, step, v FROM {nation}, LATERAL tamarack_steps(n_regionkey)", nation=t(s, d, "nation"))


@P.query("SELECT o_orderpriority, round(sum(o_totalprice * (1 + o_custkey % 3)) / sum(1 + o_custkey % 3), 6) AS weighted FROM orders GROUP BY 1")
def user_aggregate(s: S, d: str) -> DataFrame:
    """AGGREGATE USING: a user's aggregate of accumulate and merge; map-side sums in Arrow batches, merged by built-in ones."""

    def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["a"], b["w"] = b.x * b.w, b.w.astype("float64")
            yield b.groupby("k", as_index=False, dropna=False)[["a", "w"]].sum()

    x = t(s, d, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_totalprice").alias("x"), (1 + F.col("o_custkey") % 3).alias("w"))
    parts = x.mapInPandas(accumulate, "k string, a double, w double")
    return parts.groupBy(F.col("k").alias("o_orderpriority")).agg(F.round(F.sum("a") / F.sum("w"), 6).alias("weighted"))


@P.query("SELECT o_orderkey, round(avg(o_totalprice) OVER w, 6) AS a, min(o_totalprice) OVER w AS lo, max(o_totalprice) OVER w AS hi, count(*) OVER w AS n, round(stddev_pop(o_totalprice) OVER w, 4) AS sd, round(median(o_totalprice) OVER w, 4) AS med FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def window_aggregates(s: S, d: str) -> DataFrame:
    """AVG, MIN, MAX, COUNT, STDDEV and MEDIAN over whole partitions: aggregates joined back, so that no partition is held in memory."""
    x, p = t(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), F.col("o_totalprice")
    found = {"a": F.round(F.avg(p), 6), "lo": F.min(p), "hi": F.max(p), "n": F.count("*"), "sd": F.round(F.stddev_pop(p), 4), "med": F.round(F.median(p), 4)}
    return over_keys(x, ["o_custkey"], found).select("o_orderkey", *found)


@P.query("SELECT o_orderkey, first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice) AS first_price FROM orders")
def keep_over(s: S, d: str) -> DataFrame:
    """MIN(x) KEEP (DENSE_RANK FIRST ORDER BY y) OVER (PARTITION BY k)."""
    x = t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    first = F.min(F.struct("o_orderdate", "o_totalprice"))["o_totalprice"]
    return over_keys(x, ["o_custkey"], {"first_price": first}).select("o_orderkey", "first_price")


@P.query("SELECT o_orderkey, 'SO' || strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS doc_no FROM orders")
def document_numbers(s: S, d: str) -> DataFrame:
    """Document numbers of prefix, day and sequence."""
    return t(s, d, "orders").select("o_orderkey", document_number("SO", F.col("o_orderdate"), F.col("o_orderkey")).alias("doc_no"))
