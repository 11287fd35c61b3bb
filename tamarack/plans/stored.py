"""What is written and read again: snapshots, partitioned ledgers, external files, stored views, checked writes, logs."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack import context as c
from tamarack.dialect import run
from tamarack.operators.changes import returning
from tamarack.operators.relational import exactly_one, pivot_xml, split_rejects
from tamarack.plans.base import Plans
from tamarack.session import checkpoint_dir
from tamarack.session import table as t
from tamarack.sources import files

P = Plans()
S = SparkSession


def _folder(s: S) -> str:
    return f"{checkpoint_dir(s).rstrip('/')}/stored-{uuid.uuid4().hex}"


def _versions(s: S, d: str) -> str:
    folder, x = _folder(s), t(s, d, "supplier").select("s_suppkey", "s_acctbal")
    files.write_snapshot(x, folder, 1)
    files.write_snapshot(x.where("s_acctbal > 0").withColumn("s_acctbal", F.col("s_acctbal") + 1), folder, 3)
    return folder


@P.query("SELECT s_suppkey, s_acctbal FROM supplier")
def snapshot_as_of(s: S, d: str) -> DataFrame:
    """AS OF a version between two stored ones."""
    return files.as_of(s, _versions(s, d), 2)


@P.query("SELECT 1 AS version, s_suppkey, s_acctbal FROM supplier UNION ALL SELECT 3, s_suppkey, s_acctbal + 1 FROM supplier WHERE s_acctbal > 0")
def snapshot_versions(s: S, d: str) -> DataFrame:
    """VERSIONS BETWEEN."""
    return files.versions_between(s, _versions(s, d), 1, 3).select(F.col("_snapshot").alias("version"), "s_suppkey", "s_acctbal")


@P.query("SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1997 AND quarter(o_orderdate) = 2")
def ledger_partition(s: S, d: str) -> DataFrame:
    """A partition-extended table name: one quarter of a ledger."""
    folder = _folder(s)
    files.write_partitioned(t(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"), folder, "o_orderdate")
    return files.read_partition(s, folder, "1997Q2").select("o_orderkey", "o_totalprice")


@P.query("SELECT p_partkey, p_name, p_retailprice FROM part")
def external_files(s: S, d: str) -> DataFrame:
    """An external table over delimited files with a header."""
    folder = _folder(s)
    t(s, d, "part").select("p_partkey", "p_name", "p_retailprice").write.options(sep="|", header=True).csv(folder)
    return files.external_table(s, folder, "p_partkey bigint, p_name string, p_retailprice double", delimiter="|", header=True)


@P.query("SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM orders GROUP BY 1")
def materialized_view(s: S, d: str) -> DataFrame:
    """A stored view, refreshed in place from a query that reads the old one."""
    folder, x = _folder(s), t(s, d, "orders")
    total = F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("double").alias("total")
    first = files.refresh(x.where("o_custkey % 2 = 0").groupBy("o_custkey").agg(F.count("*").alias("n"), total), folder)
    return files.refresh(first.unionByName(x.where("o_custkey % 2 = 1").groupBy("o_custkey").agg(F.count("*").alias("n"), total)), folder)


@P.query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def check_option(s: S, d: str) -> DataFrame:
    """WITH CHECK OPTION: rows written through a view, each of which keeps its predicate."""
    rows = t(s, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal")
    return c.checked(rows, F.col("c_acctbal") > 0, "rich_customers")


@P.query("SELECT s_suppkey AS supplier_id, s_name AS supplier_name FROM supplier")
def view_insert(s: S, d: str) -> DataFrame:
    """INSTEAD OF: rows of a view as rows of its base table."""
    return c.view_writer({"s_suppkey": "supplier_id", "s_name": "supplier_name"})(t(s, d, "supplier"))


@P.query("SELECT count(*) AS n_rows FROM lineitem WHERE l_returnflag = 'R'")
def row_count(s: S, d: str) -> DataFrame:
    """SQL%ROWCOUNT of a write, without counting twice."""
    rows, seen = c.counted(t(s, d, "lineitem").where("l_returnflag = 'R'"), f"rows-{uuid.uuid4().hex}")
    rows.write.parquet(_folder(s))
    return s.createDataFrame([(seen.get["rows"],)], "n_rows bigint")


@P.query("SELECT l_orderkey || '/' || l_linenumber AS biz_key, CASE WHEN l_quantity < 5 THEN 'M_QTY' ELSE 'M_DISCOUNT' END AS error_code, 'line ' || l_linenumber || ' of ' || l_orderkey AS error_msg, 'batch' AS operator FROM lineitem WHERE l_quantity < 5 OR l_discount > 0.09")
def error_log(s: S, d: str) -> DataFrame:
    """Rejected rows as rows of the error log."""
    rules = {"M_QTY": F.col("l_quantity") >= 5, "M_DISCOUNT": F.col("l_discount") <= 0.09}
    _, bad = split_rejects(t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), rules)
    ctx = c.EngineContext(dt.date(2026, 5, 27), operator="batch")
    said = F.concat_ws("", F.lit("line "), "l_linenumber", F.lit(" of "), "l_orderkey")
    log = c.logged(bad, ctx, code=F.col("reject_reason"), message=said, key=F.concat_ws("/", "l_orderkey", "l_linenumber"), module="orders", procedure="receive", at=dt.datetime(2026, 5, 27))
    return log.select("biz_key", "error_code", "error_msg", "operator")


@P.query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = (SELECT max(n_nationkey) FROM nation)")
def select_into(s: S, d: str) -> DataFrame:
    """SELECT INTO: the only row, or an error."""
    last = t(s, d, "nation").agg(F.max("n_nationkey").alias("k"))
    key = exactly_one(last)["k"]
    row = exactly_one(t(s, d, "nation").where(F.col("n_nationkey") == key))
    return s.createDataFrame([(row["n_nationkey"], row["n_name"])], "n_nationkey int, n_name string")


@P.query("""SELECT c_custkey, CASE WHEN c_acctbal < -900 THEN 'DELETE' ELSE 'UPDATE' END AS action, CASE WHEN c_acctbal < -900 THEN c_acctbal ELSE c_acctbal + 1 END AS c_acctbal FROM customer WHERE c_acctbal < -900 OR c_custkey % 10 = 0
    UNION ALL SELECT s_suppkey + 10000000, 'INSERT', s_acctbal FROM supplier""")
def returning_rows(s: S, d: str) -> DataFrame:
    """RETURNING: the rows that a change inserted, updated and deleted."""
    old = t(s, d, "customer").select("c_custkey", "c_acctbal")
    new = old.where("c_acctbal >= -900").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    new = new.unionByName(t(s, d, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal")))
    return returning(old, new, ["c_custkey"])


@P.query("""SELECT c_nationkey, '<PivotSet>' || string_agg('<item><column name="C_MKTSEGMENT">' || seg || '</column><column name="N">' || n || '</column></item>', '' ORDER BY seg) || '</PivotSet>' AS xml
    FROM (SELECT c_nationkey, c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1""")
def pivot_as_xml(s: S, d: str) -> DataFrame:
    """PIVOT XML: the pivoted values of each row as a document, whatever values there are."""
    return pivot_xml(t(s, d, "customer"), ["c_nationkey"], "c_mktsegment", F.count("*"), name="n")


@P.query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def sql_wm_concat(s: S, d: str) -> DataFrame:
    """WM_CONCAT, whose order is not defined, sorted afterwards."""
    return run(s, "SELECT n_regionkey, ARRAY_JOIN(ARRAY_SORT(SPLIT(WM_CONCAT(n_name), ',')), ',') AS names FROM nation GROUP BY n_regionkey", nation=t(s, d, "nation"))
