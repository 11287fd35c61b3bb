"""Queries written in enterprise SQL, run through the translation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.dialect import run
from tamarack.plans.base import Plans
from tamarack.session import table as t

P = Plans()
S = SparkSession


def _run(s: S, d: str, sql: str, *names: str, **more) -> DataFrame:  # noqa: ANN003
    return run(s, sql, **more, **{n: t(s, d, n) for n in names})


@P.query("SELECT c_custkey, c_name || ' (' || coalesce(nullif(c_mktsegment, 'BUILDING'), '') || ')' AS label FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15")
def sql_fetch_and_concat(s: S, d: str) -> DataFrame:
    """|| over nulls, FETCH FIRST."""
    return _run(s, d, "SELECT c_custkey, c_name || ' (' || NULLIF(c_mktsegment, 'BUILDING') || ')' AS label FROM customer ORDER BY c_acctbal DESC, c_custkey FETCH FIRST 15 ROWS ONLY", "customer")


@P.query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, rank() OVER (ORDER BY l_quantity DESC, l_tax) AS r FROM lineitem) WHERE r <= 5")
def sql_with_ties(s: S, d: str) -> DataFrame:
    """FETCH FIRST ... WITH TIES."""
    return run(s, "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax FROM lineitem ORDER BY l_quantity DESC, l_tax FETCH FIRST 5 ROWS WITH TIES", lineitem=t(s, d, "lineitem")).drop("l_tax")


@P.query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 1 WHERE s_acctbal > 5000")
def sql_legacy_outer_join(s: S, d: str) -> DataFrame:
    """Comma joins with (+)."""
    return _run(s, d, "SELECT s.s_suppkey, n.n_name FROM supplier s, nation n WHERE s.s_nationkey = n.n_nationkey (+) AND n.n_regionkey (+) = 1 AND s.s_acctbal > 5000", "supplier", "nation")


@P.query("SELECT n_name, s_name FROM nation LEFT JOIN LATERAL (SELECT s_name FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC LIMIT 1) x ON true")
def sql_outer_apply(s: S, d: str) -> DataFrame:
    """OUTER APPLY of an ordered subquery."""
    return _run(s, d, "SELECT n_name, s_name FROM nation OUTER APPLY (SELECT s_name FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC FETCH FIRST 1 ROW ONLY) x", "nation", "supplier")


@P.query("""
    WITH RECURSIVE w AS (SELECT p_partkey, 1 AS lvl, '/' || p_partkey AS path, p_partkey AS root FROM part WHERE p_partkey = 1 UNION ALL SELECT p.p_partkey, w.lvl + 1, w.path || '/' || p.p_partkey, w.root FROM w JOIN part p ON p.p_partkey // 2 = w.p_partkey AND p.p_partkey > 1)
    SELECT p_partkey, lvl, path, root, CASE WHEN EXISTS (SELECT 1 FROM part c WHERE c.p_partkey // 2 = w.p_partkey AND c.p_partkey > 1) THEN 0 ELSE 1 END AS leaf FROM w WHERE p_partkey <> 7""")
def sql_connect_by(s: S, d: str) -> DataFrame:
    """START WITH, CONNECT BY NOCYCLE PRIOR, LEVEL, SYS_CONNECT_BY_PATH, CONNECT_BY_ROOT, CONNECT_BY_ISLEAF over all parts."""
    parts = t(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") != 1, F.floor(F.col("p_partkey") / 2)).alias("up"))
    sql = "SELECT p.p_partkey, LEVEL AS lvl, SYS_CONNECT_BY_PATH(p.p_partkey, '/') AS path, CONNECT_BY_ROOT p_partkey AS root, CONNECT_BY_ISLEAF AS leaf FROM parts p WHERE p.p_partkey <> 7 START WITH up IS NULL CONNECT BY NOCYCLE PRIOR p.p_partkey = p.up"
    return run(s, sql, parts=parts)


@P.query("""
    WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT h.item_id AS p, l.component_item_id AS c FROM t_bom_header h JOIN t_bom_line l ON l.bom_id = h.bom_id),
    w AS (SELECT c, p, 1 AS lvl, [c] AS path FROM e WHERE p NOT IN (SELECT c FROM e) UNION ALL SELECT e.c, e.p, w.lvl + 1, list_append(w.path, e.c) FROM w JOIN e ON e.p = w.c WHERE NOT list_contains(w.path, e.c) AND w.lvl < 5)
    SELECT c, p, lvl, CASE WHEN lvl < 5 AND EXISTS (SELECT 1 FROM e WHERE e.p = w.c AND NOT list_contains(w.path, e.c)) THEN 0 ELSE 1 END AS leaf, CASE WHEN lvl < 5 AND EXISTS (SELECT 1 FROM e WHERE e.p = w.c AND list_contains(w.path, e.c)) THEN 1 ELSE 0 END AS loop FROM w""")
def sql_nocycle(s: S, d: str) -> DataFrame:
    """CONNECT BY NOCYCLE over loops, with leaves and loops marked, joined tables and an end at a level."""
    sql = """SELECT x.c, x.p, LEVEL AS lvl, CONNECT_BY_ISLEAF AS leaf, CONNECT_BY_ISCYCLE AS loop FROM (SELECT DISTINCT h.item_id AS p, l.component_item_id AS c FROM t_bom_header h JOIN t_bom_line l ON l.bom_id = h.bom_id) x
        START WITH p NOT IN (SELECT component_item_id FROM t_bom_line b JOIN t_bom_header g ON g.bom_id = b.bom_id) CONNECT BY NOCYCLE PRIOR x.c = x.p AND LEVEL <= 5"""
    return _run(s, d, sql, "t_bom_header", "t_bom_line")


@P.query("""
    WITH RECURSIVE e AS (SELECT n_nationkey AS id, n_name AS name, NULL AS up FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey, n_name, n_nationkey % 5 FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT 100 + s_suppkey, s_name, s_nationkey FROM supplier),
    w AS (SELECT id, 1 AS lvl, [name || '#' || lpad(CAST(id AS VARCHAR), 9, '0')] AS k FROM e WHERE up IS NULL UNION ALL SELECT e.id, w.lvl + 1, list_append(w.k, e.name || '#' || lpad(CAST(e.id AS VARCHAR), 9, '0')) FROM w JOIN e ON e.up = w.id)
    SELECT id, lvl FROM w ORDER BY k LIMIT 40""")
def sql_order_siblings(s: S, d: str) -> DataFrame:
    """ORDER SIBLINGS BY, shown by the first rows in that order."""
    n = t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") >= 5, F.col("n_nationkey") % 5).cast("long").alias("up"))
    e = n.unionByName(t(s, d, "supplier").select((F.col("s_suppkey") + 100).alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("up")))
    return run(s, "SELECT id, LEVEL AS lvl FROM e START WITH up IS NULL CONNECT BY PRIOR id = up ORDER SIBLINGS BY name FETCH FIRST 40 ROWS ONLY", e=e)


@P.query("""
    WITH x AS (SELECT s_suppkey AS k, s_nationkey AS n, s_acctbal AS v FROM supplier)
    SELECT c_custkey, CASE WHEN k IS NOT NULL AND v > 0 THEN round(c_acctbal + v, 4) ELSE c_acctbal END AS c_acctbal, CASE WHEN k IS NOT NULL AND v > 0 THEN 'MERGED' ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN x ON k = c_custkey AND n = c_nationkey WHERE NOT coalesce(v > 0 AND c_acctbal + v > 9000, false)
    UNION ALL SELECT k + 1000000, round(v * 2, 4), 'NEW' FROM x WHERE v > 100 AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = k AND c_nationkey = n)""")
def sql_merge(s: S, d: str) -> DataFrame:
    """MERGE over two keys with conditional update, delete and insert."""
    sql = """MERGE INTO customer c USING (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier) s ON (c.c_custkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey)
        WHEN MATCHED THEN UPDATE SET c.c_acctbal = ROUND(c.c_acctbal + s.s_acctbal, 4), c.c_mktsegment = 'MERGED' WHERE s.s_acctbal > 0 DELETE WHERE c.c_acctbal > 9000
        WHEN NOT MATCHED THEN INSERT (c.c_custkey, c.c_acctbal, c.c_mktsegment) VALUES (s.s_suppkey + 1000000, ROUND(s.s_acctbal * 2, 4), 'NEW') WHERE s.s_acctbal > 100"""
    return _run(s, d, sql, "customer", "supplier").select("c_custkey", "c_acctbal", "c_mktsegment")


@P.query("SELECT o_orderkey AS k, l_linenumber AS line, l_partkey AS part, CAST(l_quantity AS DOUBLE) AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 10")
def sql_json_table(s: S, d: str) -> DataFrame:
    """JSON_TABLE with types, paths and a filter."""
    x = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"))).alias("items"))).alias("doc"))
    docs = x.join(t(s, d, "orders").select(F.col("o_orderkey").alias("k")), "k")
    out = run(s, "SELECT d.k, j.line, j.part, j.qty FROM docs d, JSON_TABLE(d.doc, '$.items[*]' COLUMNS (pos FOR ORDINALITY, line INTEGER PATH '$.line', part INTEGER PATH '$.part', qty NUMBER(10,2) PATH '$.qty')) j WHERE j.qty > 10 AND j.pos > 0", docs=docs)
    return out.withColumns({"qty": F.col("qty").cast("double"), "line": F.col("line").cast("int")})


@P.query("SELECT p_partkey, round(p_retailprice * 1.1 + p_size, 4) AS landed, round((p_retailprice * 1.1 + p_size) * 2, 4) AS twice FROM part")
def sql_with_function(s: S, d: str) -> DataFrame:
    """WITH FUNCTION: functions inlined."""
    sql = """WITH FUNCTION landed(p NUMBER, add_on NUMBER) RETURN NUMBER IS BEGIN RETURN p * 1.1 + add_on; END;
        FUNCTION twice(x NUMBER) RETURN NUMBER IS BEGIN RETURN landed(x, p_size) * 2; END;
        SELECT p_partkey, ROUND(landed(p_retailprice, p_size), 4) AS landed, ROUND(twice(p_retailprice), 4) AS twice FROM part"""
    return _run(s, d, sql, "part")


@P.query("SELECT o_orderkey, first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice) AS first_price, last_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_price FROM orders")
def sql_keep_over(s: S, d: str) -> DataFrame:
    """KEEP (DENSE_RANK ...) OVER (PARTITION BY ...)."""
    return _run(s, d, "SELECT o_orderkey, MIN(o_totalprice) KEEP (DENSE_RANK FIRST ORDER BY o_orderdate) OVER (PARTITION BY o_custkey) AS first_price, MAX(o_totalprice) KEEP (DENSE_RANK LAST ORDER BY o_orderdate) OVER (PARTITION BY o_custkey) AS last_price FROM orders", "orders")


@P.query("""SELECT po_line_id, lpad(CAST(line_no AS VARCHAR), 5, '0') AS no5, datediff('day', DATE '2024-01-01', need_date) AS days, need_date - DATE '2020-02-29' AS since, line_no % 7 AS m, CAST(line_no AS DOUBLE) ** 2 AS sq, nullif(coalesce(uom, '') || coalesce(line_note, ''), '') AS txt,
    CASE WHEN uom IS NULL THEN NULL ELSE coalesce(TRY_CAST(uom AS DOUBLE), -1) END AS num FROM (SELECT DISTINCT po_line_id, line_no, need_date, uom, line_note FROM t_po_line)""")
def sql_masks_and_operators(s: S, d: str) -> DataFrame:
    """FM masks with leading zeros, differences of dates, infix MOD, **, || of nulls, TO_NUMBER with a default, FOR UPDATE."""
    sql = """SELECT DISTINCT po_line_id, TO_CHAR(line_no, 'FM00000') AS no5, need_date - TO_DATE('2024-01-01', 'YYYY-MM-DD') AS days, (p.need_date - DATE '2020-02-29') AS since, line_no MOD 7 AS m, line_no ** 2 AS sq, uom || line_note AS txt,
        TO_NUMBER(uom DEFAULT -1 ON CONVERSION ERROR) AS num FROM t_po_line p FOR UPDATE OF p.uom NOWAIT"""
    return _run(s, d, sql, "t_po_line").withColumns({"num": F.col("num").cast("double"), "days": F.col("days").cast("long"), "since": F.col("since").cast("long")})


@P.query("SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, rank() OVER (ORDER BY o_orderpriority DESC, o_orderdate) AS r, count(*) OVER () AS n FROM orders) WHERE r <= ceil(n * 3 / 100)")
def sql_percent_with_ties(s: S, d: str) -> DataFrame:
    """FETCH FIRST p PERCENT ROWS WITH TIES over columns of mixed directions that are not selected."""
    return _run(s, d, "SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_orderpriority DESC, o_orderdate FETCH FIRST 3 PERCENT ROWS WITH TIES)", "orders")


@P.query("SELECT item_id, list_contains(tags, 'x') AS is_x, NOT list_contains(tags, item_type) AS no_type FROM (SELECT DISTINCT item_id, item_type, tags FROM t_item WHERE tags IS NOT NULL AND len(tags) > 0)")
def sql_member_of(s: S, d: str) -> DataFrame:
    """MEMBER OF and NOT MEMBER OF."""
    return _run(s, d, "SELECT DISTINCT item_id, 'x' MEMBER OF tags AS is_x, item_type NOT MEMBER OF tags AS no_type FROM t_item WHERE tags IS NOT NULL AND SIZE(tags) > 0", "t_item")


@P.query("SELECT CAST(n AS INTEGER) AS n, CAST(DATE '2024-02-01' + CAST(n AS INTEGER) AS DATE) AS d FROM range(1, 11) g(n)")
def sql_row_generator(s: S, d: str) -> DataFrame:  # noqa: ARG001
    """SELECT LEVEL FROM DUAL CONNECT BY LEVEL <= 10."""
    return run(s, "SELECT LEVEL AS n, TO_DATE('2024-02-01', 'YYYY-MM-DD') + LEVEL AS d FROM DUAL CONNECT BY LEVEL <= 10")


@P.query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = 3 AND c_acctbal < 7000) AND s_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def sql_any_all(s: S, d: str) -> DataFrame:
    """Comparison with ANY and ALL."""
    return _run(s, d, "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = 3 AND c_acctbal < 7000) AND s_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)", "supplier", "customer", "nation")


@P.query("SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS last_price, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY 1")
def sql_keep(s: S, d: str) -> DataFrame:
    """MAX and MIN with KEEP (DENSE_RANK LAST and FIRST)."""
    return _run(s, d, "SELECT o_custkey, MAX(o_totalprice) KEEP (DENSE_RANK LAST ORDER BY o_orderdate) AS last_price, MIN(o_orderkey) KEEP (DENSE_RANK FIRST ORDER BY o_orderdate) AS first_order FROM orders GROUP BY o_custkey", "orders")


@P.query("""SELECT c_custkey, round(c_acctbal / nullif(sum(c_acctbal) OVER (PARTITION BY c_nationkey), 0), 8) AS share, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_custkey % (c_custkey % 3) END AS m,
    CASE WHEN nullif(c_nationkey, 3) IS NULL THEN NULL ELSE greatest(nullif(c_nationkey, 3), 7) END AS g, DATE '2024-02-29' AS next_end, '2024-01-31' AS shown, format('{:,.2f}', CAST(c_acctbal AS DECIMAL(18,2))) AS money FROM customer""")
def sql_functions(s: S, d: str) -> DataFrame:
    """RATIO_TO_REPORT, MOD by 0, GREATEST with nulls, ADD_MONTHS at month ends, SYSDATE as a parameter, masks."""
    sql = """SELECT c_custkey, ROUND(RATIO_TO_REPORT(c_acctbal) OVER (PARTITION BY c_nationkey), 8) AS share, MOD(c_custkey, MOD(c_custkey, 3)) AS m, GREATEST(NULLIF(c_nationkey, 3), 7) AS g,
        ADD_MONTHS(SYSDATE, 1) AS next_end, TO_CHAR(SYSDATE, 'YYYY-MM-DD') AS shown, TO_CHAR(c_acctbal, 'FM999,990.00') AS money FROM customer"""
    return _run(s, d, sql, "customer", as_of="2024-01-31")


@P.query("SELECT 'x' AS c, 2 AS n UNION ALL SELECT count(*)::VARCHAR, 3 FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) q")
def sql_dual_and_minus(s: S, d: str) -> DataFrame:
    """DUAL and MINUS."""
    return _run(s, d, "SELECT 'x' AS c, 1 + 1 AS n FROM DUAL UNION ALL SELECT CAST(COUNT(*) AS STRING), 3 FROM (SELECT c_nationkey FROM customer MINUS SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) q", "customer", "supplier")


@P.query("SELECT count(*) AS n FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' LIMIT 7)")
def sql_rownum(s: S, d: str) -> DataFrame:
    """ROWNUM as a bound."""
    return _run(s, d, "SELECT COUNT(*) AS n FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND ROWNUM <= 7)", "orders")
