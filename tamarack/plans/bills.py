"""Bills of material on the delivered header, line and item tables, whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators import bom
from tamarack.operators.connect_by import low_level_codes as codes
from tamarack.operators.relational import merge_into, running
from tamarack.plans.base import Plans
from tamarack.session import table as t

P = Plans()
S = SparkSession

#: The business date of these queries.
AS_OF = "2024-06-30"
_VALID = f"status = 'ACTIVE' AND effective_from <= DATE '{AS_OF}' AND (effective_to IS NULL OR effective_to >= DATE '{AS_OF}')"
_LINES = """SELECT DISTINCT l.line_id, l.bom_id, l.line_no, l.component_item_id, l.qty_per, l.uom, l.scrap_rate, i.item_code, i.item_name, i.item_type,
        CASE WHEN l.is_phantom = 'Y' OR i.is_phantom = 'Y' THEN 'Y' ELSE 'N' END AS is_phantom, CAST(l.qty_per AS DOUBLE) / (CAST(1 AS DOUBLE) - coalesce(CAST(l.scrap_rate AS DOUBLE), 0)) AS eff
      FROM t_bom_line l JOIN t_item i ON i.item_id = l.component_item_id"""
_EDGES = f"SELECT h.item_id AS p, l.component_item_id AS c, l.* FROM (SELECT DISTINCT bom_id, item_id FROM t_bom_header WHERE is_default = 'Y' AND {_VALID}) h JOIN ({_LINES}) l ON l.bom_id = h.bom_id"


def _tables(s: S, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return t(s, d, "t_bom_header"), t(s, d, "t_bom_line"), t(s, d, "t_item")


def _walk(first: str, later: str, shown: str) -> str:
    return f"""
    WITH RECURSIVE e AS MATERIALIZED ({_EDGES}),
    w AS (SELECT p AS root, 1 AS lvl, p, c, item_code, item_name, item_type, qty_per, {first} AS cum, uom, is_phantom, '/' || item_code AS path, [p, c] AS ids FROM e WHERE p <> c
      UNION ALL SELECT w.root, w.lvl + 1, e.p, e.c, e.item_code, e.item_name, e.item_type, e.qty_per, {later}, e.uom, e.is_phantom, w.path || '/' || e.item_code, list_append(w.ids, e.c) FROM w JOIN e ON e.p = w.c WHERE NOT list_contains(w.ids, e.c))
    SELECT root AS root_item_id, lvl, p AS parent_item_id, c AS component_item_id, item_code AS component_code, item_name AS component_name, item_type, CAST(qty_per AS DOUBLE) AS qty_per, round(cum, 6) AS cum_qty, uom, path, is_phantom{shown} FROM w"""


@P.query(_walk("CAST(1 AS DOUBLE) * eff", "w.cum * e.eff", """,
      CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.p = w.c AND NOT list_contains(w.ids, e.c)) THEN 'N' ELSE 'Y' END AS is_leaf, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.p = w.c AND list_contains(w.ids, e.c)) THEN 'Y' ELSE 'N' END AS is_cycle"""))
def bom_explosion(s: S, d: str) -> DataFrame:
    """Every item with a bill exploded: quantities with scrap multiplied on the way and rounded at the end, phantoms, leaves and loops marked."""
    return bom.explode(*_tables(s, d), AS_OF).withColumn("qty_per", F.col("qty_per").cast("double"))


@P.query(_walk("round(CAST(1 AS DOUBLE) * eff, 6)", "round(w.cum * e.eff, 6)", ""))
def bom_explosion_rounded(s: S, d: str) -> DataFrame:
    """The same with rounding at every level, as a recursive WITH that rounds gives it."""
    return bom.explode(*_tables(s, d), AS_OF, round_each=True).withColumn("qty_per", F.col("qty_per").cast("double")).drop("is_leaf", "is_cycle")


@P.query(f"""
    WITH RECURSIVE e AS MATERIALIZED (SELECT h.item_id AS p, i.item_code AS code, l.component_item_id AS c FROM (SELECT DISTINCT bom_id, item_id FROM t_bom_header WHERE {_VALID}) h
      JOIN (SELECT DISTINCT line_id, bom_id, component_item_id FROM t_bom_line) l ON l.bom_id = h.bom_id JOIN (SELECT DISTINCT item_id, item_code FROM t_item) i ON i.item_id = h.item_id),
    w AS (SELECT c AS start, 1 AS lvl, p, code, '<-' || code AS use_path, [c, p] AS ids FROM (SELECT e.* FROM e) WHERE p <> c
      UNION ALL SELECT w.start, w.lvl + 1, e.p, e.code, w.use_path || '<-' || e.code, list_append(w.ids, e.p) FROM w JOIN e ON e.c = w.p WHERE NOT list_contains(w.ids, e.p))
    SELECT start AS component_item_id, lvl, p AS parent_item_id, code AS parent_code, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.c = w.p AND NOT list_contains(w.ids, e.p)) THEN 0 ELSE 1 END AS is_top, use_path FROM w""")
def where_used(s: S, d: str) -> DataFrame:
    """The walk up from every component to everything that it is used in."""
    return bom.where_used(*_tables(s, d), AS_OF)


@P.query(f"""
    WITH RECURSIVE e AS MATERIALIZED (SELECT h.item_id AS p, l.component_item_id AS c FROM (SELECT DISTINCT bom_id, item_id FROM t_bom_header WHERE {_VALID}) h JOIN (SELECT DISTINCT line_id, bom_id, component_item_id FROM t_bom_line) l ON l.bom_id = h.bom_id)
    SELECT c AS component_item_id, count(*) AS n FROM (SELECT c, p, 1 AS lvl FROM e WHERE p <> c UNION ALL SELECT a.c, b.p, 2 FROM e a JOIN e b ON b.c = a.p WHERE a.p <> a.c AND b.p <> a.p AND b.p <> a.c) GROUP BY 1""")
def where_used_two_levels(s: S, d: str) -> DataFrame:
    """The walk up that ends at a stated level."""
    headers, lines, items = _tables(s, d)
    every = headers.select("item_id").distinct().withColumn("item_code", F.lit("-"))
    return bom.where_used(headers, lines, every, AS_OF, max_levels=2).groupBy("component_item_id").agg(F.count("*").alias("n"))


@P.query(f"SELECT item_id, bom_id, CAST(base_qty AS DOUBLE) AS base_qty FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY effective_from DESC, bom_id DESC) AS k FROM (SELECT DISTINCT item_id, bom_id, base_qty, effective_from FROM t_bom_header WHERE is_default = 'Y' AND {_VALID})) WHERE k = 1")
def active_bill(s: S, d: str) -> DataFrame:
    """The default bill in force of every item."""
    return bom.active_bills(t(s, d, "t_bom_header"), AS_OF).withColumn("base_qty", F.col("base_qty").cast("double"))


@P.query(f"SELECT bom_id, row_number() OVER (PARTITION BY bom_id ORDER BY line_no, line_id) AS pos, component_item_id, item_code AS component_code, CAST(qty_per AS DOUBLE) AS qty_per, uom, CAST(scrap_rate AS DOUBLE) AS scrap_rate FROM ({_LINES})")
def bill_components(s: S, d: str) -> DataFrame:
    """The components of every bill in order of their lines."""
    x = running(bom.components(t(s, d, "t_bom_line"), t(s, d, "t_item")), ["bom_id"], ["line_no", "line_id"], {}, position="pos")
    return x.select("bom_id", "pos", "component_item_id", "component_code", F.col("qty_per").cast("double").alias("qty_per"), "uom", F.col("scrap_rate").cast("double").alias("scrap_rate"))


@P.query(f"""
    WITH v AS (SELECT lag(bom_id) OVER (PARTITION BY item_id ORDER BY effective_from, bom_id) AS o, bom_id AS n FROM (SELECT DISTINCT bom_id, item_id, effective_from FROM t_bom_header)), l AS MATERIALIZED (SELECT *, coalesce(scrap_rate, 0) AS sr FROM ({_LINES})),
    a AS (SELECT o, n, l.* FROM v JOIN l ON l.bom_id = o), b AS (SELECT o, n, l.* FROM v JOIN l ON l.bom_id = n WHERE o IS NOT NULL),
    same AS (SELECT a.o, a.n, a.component_item_id AS c FROM a JOIN b ON a.o = b.o AND a.n = b.n AND a.component_item_id = b.component_item_id AND a.qty_per = b.qty_per AND a.uom = b.uom AND a.sr = b.sr),
    r AS (
      SELECT 'ADDED' AS change_type, o, n, component_item_id, item_code, CAST(NULL AS DOUBLE) AS q1, CAST(qty_per AS DOUBLE) AS q2, uom FROM b WHERE (o, n, component_item_id) NOT IN (SELECT (o, n, component_item_id) FROM a)
      UNION ALL SELECT 'REMOVED', o, n, component_item_id, item_code, CAST(qty_per AS DOUBLE), NULL, uom FROM a WHERE (o, n, component_item_id) NOT IN (SELECT (o, n, component_item_id) FROM b)
      UNION ALL SELECT 'QTY_CHANGED', a.o, a.n, a.component_item_id, a.item_code, CAST(a.qty_per AS DOUBLE), CAST(b.qty_per AS DOUBLE), b.uom FROM a JOIN b ON a.o = b.o AND a.n = b.n AND a.component_item_id = b.component_item_id AND a.qty_per <> b.qty_per
        WHERE (a.o, a.n, a.component_item_id) NOT IN (SELECT (o, n, c) FROM same))
    SELECT change_type, o AS old_bom_id, n AS new_bom_id, component_item_id, item_code AS component_code, q1 AS old_qty_per, q2 AS new_qty_per, uom FROM r""")
def compare_versions(s: S, d: str) -> DataFrame:
    """What each version of a bill adds, removes and changes against the version before."""
    placed = running(t(s, d, "t_bom_header").select("bom_id", "item_id", "effective_from").distinct(), ["item_id"], ["effective_from", "bom_id"], {}, position="k")
    new = placed.select("item_id", (F.col("k") - 1).alias("k"), F.col("bom_id").alias("new_bom_id"))
    pairs = placed.select("item_id", "k", F.col("bom_id").alias("old_bom_id")).join(new, ["item_id", "k"])
    out = bom.compare_versions(pairs, t(s, d, "t_bom_line"), t(s, d, "t_item"))
    return out.withColumns({c: F.col(c).cast("double") for c in ("old_qty_per", "new_qty_per")})


#: Rounds of the comparison SQL, more than the deliveries are deep.
_DEEP = 20


def _rolled() -> str:
    rounds = ", ".join(
        f"v{k} AS MATERIALIZED (SELECT * FROM v{k - 1} UNION ALL SELECT l.p, round(sum(l.eff * v.v) / max(l.base), 6) FROM l JOIN v{k - 1} v ON v.i = l.c WHERE l.p NOT IN (SELECT i FROM v{k - 1}) GROUP BY l.p HAVING count(*) = max(l.need))" for k in range(1, _DEEP + 1)
    )
    return f"""
    WITH h AS MATERIALIZED (SELECT item_id, arg_max(bom_id, (effective_from, bom_id)) AS bom_id, CAST(arg_max(base_qty, (effective_from, bom_id)) AS DOUBLE) AS base FROM t_bom_header WHERE is_default = 'Y' AND {_VALID} GROUP BY 1),
    l AS MATERIALIZED (SELECT h.item_id AS p, x.component_item_id AS c, coalesce(nullif(h.base, 0), 1) AS base, CAST(x.qty_per AS DOUBLE) / (CAST(1 AS DOUBLE) - coalesce(CAST(x.scrap_rate AS DOUBLE), 0)) AS eff, count(*) OVER (PARTITION BY h.item_id) AS need FROM h JOIN (SELECT DISTINCT * FROM t_bom_line) x ON x.bom_id = h.bom_id),
    o AS (SELECT DISTINCT item_id AS i, CASE WHEN item_id IN (SELECT item_id FROM h) THEN 0.0 ELSE CAST(std_cost AS DOUBLE) END AS v FROM t_item WHERE item_id NOT IN (SELECT p FROM l)),
    v0 AS MATERIALIZED (SELECT i, v FROM o UNION ALL SELECT DISTINCT c, 0.0 FROM l WHERE c NOT IN (SELECT i FROM o) AND c NOT IN (SELECT p FROM l)), {rounds}
    SELECT item_id, v AS unit_cost FROM (SELECT item_id FROM t_item UNION SELECT p FROM l UNION SELECT c FROM l UNION SELECT item_id FROM h) LEFT JOIN v{_DEEP} ON i = item_id"""


_ROLLED = _rolled()


@P.query(_ROLLED)
def rolled_cost(s: S, d: str) -> DataFrame:
    """Unit costs of all items rolled up over their bills in force, rounded at every node; null on and above loops."""
    return bom.unit_costs(*_tables(s, d), AS_OF)


@P.query(f"""
    WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT h.item_id AS p, l.component_item_id AS c FROM t_bom_header h JOIN t_bom_line l ON l.bom_id = h.bom_id WHERE {_VALID.replace("effective", "h.effective").replace("status", "h.status")}),
    r AS (SELECT p AS a, c AS b FROM e UNION SELECT r.a, e.c FROM r JOIN e ON e.p = r.b),
    bad AS MATERIALIZED (SELECT a AS i FROM r WHERE a = b UNION SELECT b FROM r WHERE a IN (SELECT a FROM r WHERE a = b)),
    w AS (SELECT DISTINCT p AS item, 0 AS l FROM e WHERE p NOT IN (SELECT c FROM e) UNION SELECT e.c, w.l + 1 FROM w JOIN e ON e.p = w.item WHERE e.c NOT IN (SELECT i FROM bad))
    SELECT item, max(l) AS llc FROM w GROUP BY 1 UNION ALL SELECT i, NULL FROM bad""")
def low_level_codes(s: S, d: str) -> DataFrame:
    """The deepest level at which each item occurs in any bill in force; null on and below loops."""
    bills = t(s, d, "t_bom_header").where(bom.effective(AS_OF)).select("bom_id", "item_id")
    return codes(bills.join(t(s, d, "t_bom_line").select("bom_id", "component_item_id"), "bom_id"), parent="item_id", child="component_item_id")


@P.query(f"SELECT i.item_id, CASE WHEN i.item_id IN (SELECT item_id FROM ({_ROLLED}) WHERE unit_cost IS NOT NULL AND item_id IN (SELECT item_id FROM t_bom_header WHERE is_default = 'Y' AND {_VALID})) THEN r.unit_cost ELSE i.cost END AS std_cost FROM (SELECT DISTINCT item_id, CAST(std_cost AS DOUBLE) AS cost FROM t_item) i LEFT JOIN ({_ROLLED}) r ON r.item_id = i.item_id")
def rolled_items(s: S, d: str) -> DataFrame:
    """The items with their standard cost rolled up anew where they have a bill; items on loops keep theirs."""
    headers, lines, items = _tables(s, d)
    made = bom.unit_costs(headers, lines, items, AS_OF).where("unit_cost is not null").join(bom.active_bills(headers, AS_OF).select("item_id"), "item_id", "left_semi")
    old = items.select("item_id", F.col("std_cost").cast("double").alias("std_cost")).distinct()
    return merge_into(old, made, ["item_id"], update={"std_cost": F.col("s.unit_cost")}, insert_where=F.lit(False))
