"""Source analytics: facts of stored-procedure texts, and checks over relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators.hierarchy import components
from tamarack.plans.base import Plans
from tamarack.session import table as t
from tamarack.sources import plsql, reports

P = Plans()
S = SparkSession


def _facts(s: S, d: str) -> DataFrame:
    return plsql.facts(t(s, d, "src_file"), file_id="file_id", text="source_text")


_UNITS = r"""SELECT file_id, unnest(regexp_extract_all(source_text, '(?m)^CREATE OR REPLACE\s+(?:/\*EDITIONABLE\*/\s*)?(?:PACKAGE BODY|PACKAGE)\s+[\w.]+')) AS head FROM src_file"""


@P.query(f"SELECT upper(regexp_extract(head, '(\\w+)$', 1)) AS package, min(CASE WHEN head NOT LIKE '%BODY%' THEN file_id END) AS spec_file, min(CASE WHEN head LIKE '%BODY%' THEN file_id END) AS body_file FROM ({_UNITS}) GROUP BY 1")
def src_packages(s: S, d: str) -> DataFrame:
    """Packages with their spec and body paired by name over all trees."""
    return plsql.packages(_facts(s, d))


@P.query()
def src_routines(s: S, d: str) -> DataFrame:
    """Routines with kind, return type, lines and whether only the body has them."""
    r = _facts(s, d).where("fact = 'routine'")
    spec = r.where("mode = 'SPEC'").select("package", "name").distinct().withColumn("public", F.lit(True))
    out = r.where("mode = 'BODY'").join(spec, ["package", "name"], "left")
    return out.select("file_id", "package", "name", F.col("type").alias("kind"), F.col("detail").alias("return_type"), F.coalesce(~F.col("public"), F.lit(True)).alias("is_private"), "line_start", "line_end")


@P.query()
def src_parameters(s: S, d: str) -> DataFrame:
    """Parameters with mode, type and default."""
    return _facts(s, d).where("fact = 'parameter'").select("file_id", "package", F.substring_index("unit", "@", 1).alias("routine"), "pos", "name", "mode", "type", F.col("detail").alias("default_value"), "line_start")


@P.query("""
    WITH f AS (SELECT file_id, source_text, len(source_text) - len(replace(source_text, chr(10), '')) + 1 AS n FROM src_file WHERE source_text IS NOT NULL), r AS (SELECT file_id, source_text, CAST(n // 3 + 1 AS INTEGER) AS first_line, CAST(n AS INTEGER) AS last_line FROM f)
    SELECT file_id, first_line, last_line, array_to_string(string_split(source_text, chr(10))[first_line:last_line], chr(10)) AS source FROM r""")
def src_slices(s: S, d: str) -> DataFrame:
    """Source lines of stated ranges: the last two thirds of every file."""
    files = t(s, d, "src_file").where("source_text is not null")
    n = F.size(F.split("source_text", "\n"))
    ranges = files.select("file_id", (F.floor(n / 3) + 1).cast("int").alias("first_line"), n.alias("last_line"))
    return plsql.slices(files, ranges, file_id="file_id", text="source_text", first="first_line", last="last_line")


# A corpus whose calls and references are known: a package for each item, which calls or refers to what its bills use.

_LINKS = "SELECT DISTINCT h.item_id AS a, l.component_item_id AS b FROM t_bom_header h JOIN t_bom_line l ON l.bom_id = h.bom_id WHERE h.item_id <> l.component_item_id"
_ITEMS = f"(SELECT a AS i FROM ({_LINKS}) UNION SELECT b FROM ({_LINKS}))"


def _made(s: S, d: str) -> DataFrame:
    links = t(s, d, "t_bom_header").select("bom_id", F.col("item_id").alias("a")).join(t(s, d, "t_bom_line").select("bom_id", F.col("component_item_id").alias("b")), "bom_id").where("a != b").select("a", "b").distinct()
    uses = F.when(F.col("b") % 3 == 0, F.format_string("    v := app.P_%d.C_LIMIT; -- P_%d.MAIN(0);\n", "b", "b")).otherwise(F.format_string("    IF v > 1 THEN P_%d.main('x; END', v); END IF;\n", "b"))
    body = links.groupBy(F.col("a").alias("i")).agg(F.array_join(F.sort_array(F.collect_list(uses)), "").alias("uses"))
    every = links.select(F.col("a").alias("i")).unionByName(links.select(F.col("b").alias("i"))).distinct().join(body, "i", "left").withColumn("uses", F.coalesce("uses", F.lit("    NULL;\n")))
    i, head = F.col("i").cast("string"), "CREATE OR REPLACE PACKAGE "
    spec = F.concat(F.lit(head + "app.P_"), i, F.lit(" IS\n  c_limit CONSTANT NUMBER := 1;\n  PROCEDURE main(p_text IN VARCHAR2, p_no IN OUT NUMBER);\nEND P_"), i, F.lit(";\n/\n"))
    code = F.concat(F.lit(head + "BODY app.P_"), i, F.lit(" AS\n  FUNCTION helper(p_a NUMBER DEFAULT 7) RETURN NUMBER IS BEGIN RETURN p_a; END helper;\n  PROCEDURE main(p_text IN VARCHAR2, p_no IN OUT NUMBER) IS\n    v NUMBER;\n  BEGIN\n"), F.col("uses"), F.lit("    v := helper(1);\n  END main;\nEND;\n/\n"))
    table = F.concat(F.lit("CREATE TABLE app.t_"), i, F.lit(" (id NUMBER(18) NOT NULL, /* x NUMBER, */ amount NUMBER(10,2) DEFAULT 0, CONSTRAINT pk PRIMARY KEY (id"), F.when(F.col("i") % 2 == 0, ", amount").otherwise(""), F.lit("));\n"))
    timing = F.when(F.col("i") % 2 == 0, "BEFORE INSERT OR UPDATE").otherwise("AFTER DELETE")
    trigger = F.concat(F.lit("CREATE TRIGGER trg_"), i, F.lit(" "), timing, F.lit(" ON app.t_"), i, F.lit(" FOR EACH ROW WHEN (NEW.id > 0)\nBEGIN NULL; END;\n/\n"))
    return plsql.facts(every.select(F.col("i").alias("file_id"), F.concat(spec, code, table, trigger).alias("text")), file_id="file_id", text="text")


@P.query(f"SELECT 'P_' || a AS package, 'MAIN' AS unit, 'P_' || b AS callee_package, 'MAIN' AS callee FROM ({_LINKS}) WHERE b % 3 <> 0 UNION ALL SELECT 'P_' || i, 'MAIN', 'P_' || i, 'HELPER' FROM {_ITEMS}")
def src_made_calls(s: S, d: str) -> DataFrame:
    """Call edges of the made corpus, comments and texts aside."""
    return plsql.calls(_made(s, d)).select("package", F.substring_index("unit", "@", 1).alias("unit"), "callee_package", "callee")


@P.query(f"SELECT 'P_' || a AS package, 'P_' || b AS ref_package, 'C_LIMIT' AS name FROM ({_LINKS}) WHERE b % 3 = 0")
def src_made_refs(s: S, d: str) -> DataFrame:
    """References to constants of other packages, apart from calls."""
    return plsql.package_refs(_made(s, d)).select("package", "ref_package", "name")


@P.query(f"SELECT 'P_' || a AS package, 'P_' || b AS depends_on, CASE WHEN b % 3 = 0 THEN 'ref' ELSE 'call' END AS how FROM ({_LINKS})")
def src_made_dependencies(s: S, d: str) -> DataFrame:
    """Dependencies of packages, by call or by reference."""
    return plsql.package_dependencies(_made(s, d))


@P.query(f"SELECT 'P_' || i AS package, x.* FROM {_ITEMS}, (VALUES ('MAIN', 'PROCEDURE', NULL, 'SPEC', 3, 3), ('HELPER', 'FUNCTION', 'NUMBER', 'BODY', 7, 7), ('MAIN', 'PROCEDURE', NULL, 'BODY', 8, NULL)) x(name, kind, return_type, mode, line_start, line_end) WHERE line_end IS NOT NULL UNION ALL SELECT 'P_' || i, 'MAIN', 'PROCEDURE', NULL, 'BODY', 8, CAST(12 + greatest(1, (SELECT count(*) FROM ({_LINKS}) WHERE a = i)) AS INTEGER) FROM {_ITEMS}")
def src_made_routines(s: S, d: str) -> DataFrame:
    """Routines with kind, return type and lines."""
    return _made(s, d).where("fact = 'routine'").select("package", "name", F.col("type").alias("kind"), F.col("detail").alias("return_type"), "mode", "line_start", "line_end")


@P.query(f"SELECT 'P_' || i AS package, x.* FROM {_ITEMS}, (VALUES ('MAIN', 'SPEC', 1, 'P_TEXT', 'IN', 'VARCHAR2', NULL), ('MAIN', 'SPEC', 2, 'P_NO', 'IN OUT', 'NUMBER', NULL), ('MAIN', 'BODY', 1, 'P_TEXT', 'IN', 'VARCHAR2', NULL), ('MAIN', 'BODY', 2, 'P_NO', 'IN OUT', 'NUMBER', NULL), ('HELPER', 'BODY', 1, 'P_A', 'IN', 'NUMBER', '7')) x(routine, part, pos, name, mode, type, default_value)")
def src_made_parameters(s: S, d: str) -> DataFrame:
    """Parameters with mode, type and default, of specs (line 3) and bodies."""
    part = F.when(F.col("line_start") == 3, "SPEC").otherwise("BODY")
    return _made(s, d).where("fact = 'parameter'").select("package", F.substring_index("unit", "@", 1).alias("routine"), part.alias("part"), "pos", "name", "mode", "type", F.col("detail").alias("default_value"))


@P.query(f"""SELECT 'T_' || i AS "table", 1 AS pos, 'ID' AS "column", 'NUMBER(18)' AS type, false AS nullable, NULL AS default_value, true AS is_key FROM {_ITEMS} UNION ALL SELECT 'T_' || i, 2, 'AMOUNT', 'NUMBER(10,2)', true, '0', i % 2 = 0 FROM {_ITEMS}""")
def src_made_tables(s: S, d: str) -> DataFrame:
    """Columns of tables with type, default and key."""
    return plsql.tables(_made(s, d))


@P.query(f"""SELECT 'TRG_' || i AS "trigger", 'T_' || i AS "table", CASE WHEN i % 2 = 0 THEN 'BEFORE' ELSE 'AFTER' END AS timing, 'ROW' AS level, CASE WHEN i % 2 = 0 THEN ['INSERT', 'UPDATE'] ELSE ['DELETE'] END AS events, 'NEW.id > 0' AS condition FROM {_ITEMS}""")
def src_made_triggers(s: S, d: str) -> DataFrame:
    """Triggers with table, timing, level, events and condition."""
    return plsql.triggers(_made(s, d))


@P.query("""
    WITH RECURSIVE e AS (SELECT file_id AS f, package_name AS p FROM src_file WHERE package_name IS NOT NULL UNION SELECT file_id, 'dir' || (file_id % 17) FROM src_file WHERE package_name IS NULL), m AS (SELECT p, min(f) AS root FROM e GROUP BY p)
    SELECT f AS file_id, root AS file_group FROM e JOIN m USING (p)""")
def src_file_groups(s: S, d: str) -> DataFrame:
    """Files that share a package, as connected components, to be scanned together."""
    x = t(s, d, "src_file").select("file_id", F.coalesce("package_name", F.concat(F.lit("dir"), (F.col("file_id") % 17).cast("string"))).alias("p"))
    first = x.groupBy("p").agg(F.min("file_id").alias("first"))
    c = components(x.join(first, "p"), "file_id", "first")
    return c.select(F.col("node").alias("file_id"), F.col("label").alias("file_group"))


@P.query("""
    WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9900), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
    SELECT k, 'missing in b' AS finding FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'missing in a' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def consistency_both_ways(s: S, d: str) -> DataFrame:
    """Consistency of two artifacts: anti joins in both directions."""
    a = t(s, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k")).distinct()
    b = t(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
    return a.join(b, "k", "left_anti").withColumn("finding", F.lit("missing in b")).unionByName(b.join(a, "k", "left_anti").withColumn("finding", F.lit("missing in a")))


_UNITS_DONE = """SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus <> 'P') AS completed, count(DISTINCT o_orderpriority) + 6 AS methods, avg(o_totalprice) / 3000 AS score, bool_and(o_totalprice > 20000) AS all_passed,
      count(*) FILTER (WHERE o_totalprice > 450000) AS must_fix, min(o_totalprice) > 2000 AS compiled, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 60000) AS passed_tests, count(*) FILTER (WHERE o_orderstatus = 'F') AS total_tests FROM orders GROUP BY 1"""


@P.query(f"""WITH u AS ({_UNITS_DONE}) SELECT o_custkey, g.gate, CASE g.gate WHEN 'G1' THEN total = 0 OR completed / total >= 0.8 WHEN 'G2' THEN methods >= completed WHEN 'G3' THEN score >= 70 WHEN 'G4' THEN NOT all_passed OR must_fix = 0 WHEN 'G5' THEN compiled
    ELSE total_tests = 0 OR passed_tests / total_tests >= 0.7 END AS passed FROM u, (VALUES ('G1'), ('G2'), ('G3'), ('G4'), ('G5'), ('G6')) g(gate)""")
def quality_gates(s: S, d: str) -> DataFrame:
    """Six gates over counts of units; what has nothing to judge passes."""
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    x = t(s, d, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("total"), F.count_if(status != "P").alias("completed"), (F.count_distinct("o_orderpriority") + 6).alias("methods"), (F.avg(price) / 3000).alias("score"), F.bool_and(price > 20000).alias("all_passed"),
        F.count_if(price > 450000).alias("must_fix"), (F.min(price) > 2000).alias("compiled"), F.count_if((status == "F") & (price > 60000)).alias("passed_tests"), F.count_if(status == "F").alias("total_tests"),
    )
    return reports.gates(x, "o_custkey")


@P.query("""SELECT p_type, p_size, count(*) AS members, count(DISTINCT p_brand) AS brands, CASE WHEN p_type = 'PROMO' THEN 'exclude' WHEN count(DISTINCT p_brand) >= 2 THEN 'extract' WHEN p_size = 1 THEN 'extract' ELSE 'keep' END AS verdict FROM part GROUP BY 1, 2""")
def duplicate_groups(s: S, d: str) -> DataFrame:
    """Groups of duplicates: over two or more owners they are extracted; exclusion beats it, force beats a single owner."""
    x = t(s, d, "part").groupBy("p_type", "p_size").agg(F.count("*").alias("members"), F.count_distinct("p_brand").alias("brands"))
    return x.withColumn("verdict", F.when(F.col("p_type") == "PROMO", "exclude").when(F.col("brands") >= 2, "extract").when(F.col("p_size") == 1, "extract").otherwise("keep"))


@P.query("""SELECT event_type AS tool, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS cost, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*), 6) AS mean_cost, max(value) AS worst FROM events GROUP BY 1""")
def metrics_rollup(s: S, d: str) -> DataFrame:
    """Run metrics by tool."""
    total = F.sum(F.col("value").cast("decimal(18,4)")).cast("double")
    return t(s, d, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("calls"), total.alias("cost"), F.round(total / F.count("*"), 6).alias("mean_cost"), F.max("value").alias("worst"))


def _by_order(s: S, d: str, element: Column, head: str, foot: str) -> DataFrame:
    x = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit(head), F.array_join(F.collect_list(element), ""), F.lit(foot)).alias("xml"))
    return x.withColumnRenamed("l_orderkey", "report")


def _xml(text: str) -> Column:
    """A text with {column} filled in."""
    parts = text.replace("}", "{").split("{")
    return F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)])


@P.query("""SELECT l_orderkey AS report, 'src/F' || l_suppkey || '.java' AS file, l_linenumber AS line, CASE WHEN l_returnflag = 'A' THEN 'major' WHEN l_returnflag = 'N' THEN 'minor' ELSE 'info' END AS severity,
    CASE WHEN l_linestatus = 'O' THEN 'MethodName' ELSE 'LineLength' END AS rule, CASE WHEN l_linestatus = 'O' THEN 'naming-convention' ELSE 'code-format' END AS category, 'part ' || l_partkey AS message FROM lineitem""")
def report_findings(s: S, d: str) -> DataFrame:
    """Findings out of checkstyle reports: attributes of errors and of their files, mapped."""
    level = F.when(F.col("l_returnflag") == "A", 'severity="error" ').when(F.col("l_returnflag") == "N", 'severity="warning" ').otherwise("")
    source = F.when(F.col("l_linestatus") == "O", "naming.MethodNameCheck").otherwise("sizes.LineLengthCheck")
    element = F.concat(_xml('<file name="src/F{l_suppkey}.java"><error line="{l_linenumber}" column="3" '), level, _xml('message="part {l_partkey}" source="checks.'), source, F.lit('"/></file>'))
    return reports.checkstyle(_by_order(s, d, element, '<?xml version="1.0"?>\n<checkstyle version="9.3"><file name="none"></file>', "</checkstyle>"), "xml").drop("tool")


@P.query("""SELECT l_orderkey AS report, 'F' || l_suppkey AS file, l_linenumber AS line, CASE WHEN l_partkey % 5 < 2 THEN 'major' WHEN l_partkey % 5 = 2 THEN 'minor' ELSE 'info' END AS severity, CASE WHEN l_partkey % 2 = 0 THEN 'CloseResource' ELSE 'Unused' END AS rule,
    CASE WHEN l_partkey % 2 = 0 THEN 'collection-exception' ELSE 'code-format' END AS category, 'part ' || l_partkey AS message FROM lineitem""")
def report_violations(s: S, d: str) -> DataFrame:
    """Findings out of PMD reports, with texts of elements."""
    marked = F.concat(_xml('<file name="F{l_suppkey}"><violation beginline="{l_linenumber}" rule="'), F.when(F.col("l_partkey") % 2 == 0, "CloseResource").otherwise("Unused"), F.lit('" priority="'), (F.col("l_partkey") % 5 + 1).cast("string"), _xml('"> part {l_partkey}\n</violation></file>'))
    return reports.pmd(_by_order(s, d, marked, '<pmd version="6">', "</pmd>"), "xml").drop("tool")


@P.query("SELECT l_orderkey AS report, round(count(*) FILTER (WHERE l_partkey % 3 > 0) / count(*), 8) AS line_rate, round(CAST(sum(l_linenumber % 4) AS DOUBLE) / nullif(sum(l_linenumber % 4 + l_suppkey % 2), 0), 8) AS branch_rate FROM lineitem GROUP BY 1")
def report_coverage(s: S, d: str) -> DataFrame:
    """Rates of lines and branches out of coverage reports."""
    x = _xml('<sourcefile name="F{l_suppkey}"><line nr="{l_linenumber}" mi="1" ci="')
    element = F.concat(x, (F.col("l_partkey") % 3).cast("string"), F.lit('" mb="'), (F.col("l_suppkey") % 2).cast("string"), F.lit('" cb="'), (F.col("l_linenumber") % 4).cast("string"), F.lit('"/></sourcefile>'))
    rates = reports.coverage(reports.jacoco(_by_order(s, d, element, '<report name="r"><package name="p">', "</package></report>"), "xml"), "report")
    return rates.select("report", F.round("line_rate", 8).alias("line_rate"), F.round("branch_rate", 8).alias("branch_rate"))
