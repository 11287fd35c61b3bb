"""Hierarchical queries, recursion, roll-ups and MODEL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators import connect_by as h
from tamarack.operators import graph as g
from tamarack.operators.model import Rule, iterate, model, moving_average, trend
from tamarack.plans.base import Plans
from tamarack.session import table as t

P = Plans()
S = SparkSession

#: Regions above nations above customers, as one edge table: id, up.
_TREE = "SELECT 'R' || r_regionkey AS id, 'TOP' AS up FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer"


def _tree(s: S, d: str) -> DataFrame:
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    r = t(s, d, "region").select(text("R", "r_regionkey").alias("id"), F.lit("TOP").alias("up"))
    n = t(s, d, "nation").select(text("N", "n_nationkey").alias("id"), text("R", "n_regionkey").alias("up"))
    c = t(s, d, "customer").select(text("C", "c_custkey").alias("id"), text("N", "c_nationkey").alias("up"))
    return r.unionByName(n).unionByName(c)


@P.query(f"""
    WITH RECURSIVE e AS ({_TREE}), w AS (SELECT id AS root, id AS item, 1 AS level, '/' || id AS path FROM e WHERE up = 'TOP' UNION ALL SELECT w.root, e.id, w.level + 1, w.path || '/' || e.id FROM w JOIN e ON e.up = w.item)
    SELECT root, item, level, path, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.up = w.item) THEN 0 ELSE 1 END AS is_leaf FROM w""")
def connect_by_tree(s: S, d: str) -> DataFrame:
    """START WITH, CONNECT BY PRIOR, LEVEL, SYS_CONNECT_BY_PATH, CONNECT_BY_ROOT, CONNECT_BY_ISLEAF."""
    e = _tree(s, d)
    x = h.connect_by(e, e.where("up = 'TOP'").select("id"), parent="up", child="id", root="id")
    return x.select("root", "item", "level", F.concat(F.lit("/"), F.array_join("path", "/")).alias("path"), "is_leaf")


@P.query(f"""
    WITH RECURSIVE e AS ({_TREE}), w AS (SELECT id AS item, 1 AS level, lpad(id, 12, '0') AS k FROM e WHERE up = 'TOP' UNION ALL SELECT e.id, w.level + 1, w.k || '/' || lpad(e.id, 12, '0') FROM w JOIN e ON e.up = w.item)
    SELECT item, level, k AS sort_key FROM w""")
def order_siblings(s: S, d: str) -> DataFrame:
    """ORDER SIBLINGS BY: a sort key for each path."""
    e = _tree(s, d)
    x = h.connect_by(e, e.where("up = 'TOP'").select("id"), parent="up", child="id", root="id")
    return x.select("item", "level", h.sibling_order(F.col("path"), 12).alias("sort_key"))


@P.query("""
    WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation), w AS (SELECT a AS item, 1 AS level, [a] AS path, a AS root FROM e UNION ALL SELECT e.b, w.level + 1, list_append(w.path, e.b), w.root FROM w JOIN e ON e.a = w.item WHERE NOT list_contains(w.path, e.b))
    SELECT root, item, level, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.a = w.item AND NOT list_contains(w.path, e.b)) THEN 0 ELSE 1 END AS is_leaf, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.a = w.item AND list_contains(w.path, e.b)) THEN 1 ELSE 0 END AS is_cycle FROM w""")
def connect_by_nocycle(s: S, d: str) -> DataFrame:
    """NOCYCLE: the walk turns back where it would enter an item again; CONNECT_BY_ISCYCLE."""
    k = F.col("n_nationkey")
    e = t(s, d, "nation").select(k.alias("a"), ((k * 3 + 1) % 25).alias("b"))
    return h.connect_by(e, e.select("a"), parent="a", child="b", root="a").select("root", "item", "level", "is_leaf", "is_cycle")


_HALVES = "SELECT n_nationkey AS start, n_nationkey AS k, 1 AS lvl FROM nation UNION ALL SELECT start, CAST(floor(k / 2) AS INT), lvl + 1 FROM x WHERE k > 0"


@P.query(f"WITH RECURSIVE x AS ({_HALVES}) SELECT start, k, lvl FROM x")
def recursive_with(s: S, d: str) -> DataFrame:
    """Recursive WITH over a table, as Spark runs it; its limits of levels and rows are why hierarchies have an operator."""
    return s.sql(f"WITH RECURSIVE x(start, k, lvl) AS ({_HALVES.replace('FROM nation', 'FROM {nation}')}) SELECT start, k, lvl FROM x", nation=t(s, d, "nation"))


@P.query("""
    WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation), w AS (SELECT a AS root, a AS item, 1 AS level, [a] AS path, 0 AS closes FROM e UNION ALL SELECT w.root, e.b, w.level + 1, list_append(w.path, e.b), CASE WHEN list_contains(w.path, e.b) THEN 1 ELSE 0 END FROM w JOIN e ON e.a = w.item WHERE w.closes = 0)
    SELECT root, item, level, closes, row_number() OVER (ORDER BY path) AS depth_no, row_number() OVER (ORDER BY level, path) AS breadth_no FROM w""")
def recursive_search_cycle(s: S, d: str) -> DataFrame:
    """SEARCH DEPTH FIRST and BREADTH FIRST, and CYCLE ... SET: the row that closes a loop is marked and not led on."""
    k = F.col("n_nationkey")
    e = t(s, d, "nation").select(k.alias("a"), ((k * 3 + 1) % 25).alias("b"))
    x = h.connect_by(e, e.select("a"), parent="a", child="b", root="a", keep_closing=True)
    x = h.search_order(x, path="path", level="level", name="depth_no")
    return h.search_order(x, path="path", level="level", name="breadth_no", breadth_first=True).select("root", "item", "level", "closes", "depth_no", "breadth_no")


def _monthly(s: S, d: str) -> DataFrame:
    x = t(s, d, "orders").where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).join(t(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1 - 1998 * 12).alias("n")
    return x.groupBy("c_nationkey", month).agg(F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("double").alias("qty"))


_MONTHS = "SELECT c_nationkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 - 1998 * 12 AS INTEGER) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS qty FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2"
_CELLS = "SELECT c_nationkey, " + ", ".join(f"coalesce(sum(qty) FILTER (WHERE n = {-i}), 0.0) AS q{i}" for i in range(1, 7)) + f" FROM ({_MONTHS}) GROUP BY 1"


@P.query(f"""
    WITH RECURSIVE c AS ({_CELLS}), w AS (SELECT c_nationkey, -1 AS n, q3 AS a, q2 AS b, q1 AS c FROM c UNION ALL SELECT c_nationkey, n + 1, b, c, greatest((a + b + c) / 3.0, 0.0) FROM w WHERE n < 5)
    SELECT c_nationkey, n, round(c, 4) AS qty FROM w WHERE n >= 0""")
def model_moving_average_3(s: S, d: str) -> DataFrame:
    """MODEL with ITERATE: six months of a three-month moving average that feeds on its own cells."""
    return iterate(_monthly(s, d), ["c_nationkey"], "n", "qty", anchor=-1, window=3, ahead=6, rule=moving_average(3))


@P.query(f"""
    WITH RECURSIVE c AS ({_CELLS}), w AS (SELECT c_nationkey, -1 AS n, [q6, q5, q4, q3, q2, q1] AS q FROM c UNION ALL SELECT c_nationkey, n + 1, list_append(q[2:], greatest((q[1] + q[2] + q[3] + q[4] + q[5] + q[6]) / 6.0, 0.0)) FROM w WHERE n < 3)
    SELECT c_nationkey, n, round(q[6], 4) AS qty FROM w WHERE n >= 0""")
def model_moving_average_6(s: S, d: str) -> DataFrame:
    """The same over six months."""
    return iterate(_monthly(s, d), ["c_nationkey"], "n", "qty", anchor=-1, window=6, ahead=4, rule=moving_average(6))


@P.query(f"""
    WITH RECURSIVE c AS ({_CELLS}), w AS (SELECT c_nationkey, -1 AS n, q4 AS z, q3 AS a, q2 AS b, q1 AS c FROM c UNION ALL SELECT c_nationkey, n + 1, a, b, c, greatest(c + (c - z) / 3.0, 0.0) FROM w WHERE n < 5)
    SELECT c_nationkey, n, round(c, 4) AS qty FROM w WHERE n >= 0""")
def model_trend(s: S, d: str) -> DataFrame:
    """MODEL with a trend rule."""
    return iterate(_monthly(s, d), ["c_nationkey"], "n", "qty", anchor=-1, window=4, ahead=6, rule=trend(3))


@P.query(f"""
    WITH RECURSIVE c AS ({_CELLS}), w AS (SELECT c_nationkey, -1 AS n, q3 AS a, q2 AS b, q1 AS c FROM c UNION ALL SELECT c_nationkey, n + 1, b, c, greatest((a + b + c) / 3.0, 0.0) FROM w WHERE n < 3),
    f AS (SELECT c_nationkey, n, c AS qty FROM w WHERE n >= 0)
    SELECT c_nationkey, n, round(qty, 4) AS qty, CASE WHEN n = 2 THEN round(sum(qty) FILTER (WHERE n <= 2) OVER (PARTITION BY c_nationkey), 4) END AS quarter FROM f""")
def model_rules(s: S, d: str) -> DataFrame:
    """MODEL with several measures and rules, UPSERT, ITERATE ... UNTIL, FOR ranges and CV()."""
    cells = _monthly(s, d).withColumn("quarter", F.lit(None).cast("double"))
    forecast = Rule("qty", lambda i: i, lambda i, cv, cell: F.greatest((cell("qty", cv - 3) + cell("qty", cv - 2) + cell("qty", cv - 1)) / 3.0, F.lit(0.0)))
    total = Rule("quarter", lambda i: F.sequence(F.lit(2), F.when(i == 3, 2).otherwise(1), F.when(i == 3, 1).otherwise(-1)), lambda i, cv, cell: cell("qty", cv - 2) + cell("qty", cv - 1) + cell("qty", cv), many=True, upsert=False)
    out = model(cells, ["c_nationkey"], "n", ["qty", "quarter"], [forecast, total], iterations=1000, until=lambda i, cell: i + 1 >= 4, keep_nav=False, between=(-3, -1))
    return out.where("n >= 0").select("c_nationkey", F.col("n").cast("int").alias("n"), F.round("qty", 4).alias("qty"), F.when(F.col("n") == 2, F.round("quarter", 4)).alias("quarter"))


@P.query(f"""
    WITH RECURSIVE c AS ({_CELLS}), w AS (SELECT m.method, c_nationkey, -1 AS n, [q6, q5, q4, q3, q2, q1] AS q FROM c, (VALUES ('MA3'), ('MA6'), ('TREND')) m(method)
      UNION ALL SELECT method, c_nationkey, n + 1, list_append(q[2:], greatest(CASE method WHEN 'MA3' THEN (q[4] + q[5] + q[6]) / 3.0 WHEN 'MA6' THEN (q[1] + q[2] + q[3] + q[4] + q[5] + q[6]) / 6.0 ELSE q[6] + (q[6] - q[3]) / 3.0 END, 0.0)) FROM w WHERE n < 2)
    SELECT method, c_nationkey, CAST(DATE '1998-01-01' + to_months(n) AS DATE) AS period, round(q[6], 4) AS qty FROM w WHERE n >= 0""")
def forecasts(s: S, d: str) -> DataFrame:
    """Forecasts by three methods for the months ahead, with method and month as data."""
    cells, out = _monthly(s, d), None
    for method, window, rule in (("MA3", 3, moving_average(3)), ("MA6", 6, moving_average(6)), ("TREND", 4, trend(3))):
        x = iterate(cells, ["c_nationkey"], "n", "qty", anchor=-1, window=window, ahead=3, rule=rule)
        x = x.select(F.lit(method).alias("method"), "c_nationkey", F.add_months(F.lit("1998-01-01").cast("date"), F.col("n")).alias("period"), "qty")
        out = x if out is None else out.unionByName(x)
    return out


# Graphs: items and what their bills use, loops included

_CALLS = "SELECT DISTINCT h.item_id AS a, l.component_item_id AS b FROM t_bom_header h JOIN t_bom_line l ON l.bom_id = h.bom_id"
_REACH = f"RECURSIVE e AS MATERIALIZED ({_CALLS}), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"
_FROM_TOP = "c AS (SELECT DISTINCT item_id AS node FROM t_item WHERE item_type = 'FG' UNION SELECT e.b FROM c JOIN e ON e.a = c.node)"


def _calls(s: S, d: str, where: str = "true") -> DataFrame:
    bills = t(s, d, "t_bom_header").where(where).select("bom_id", F.col("item_id").alias("a"))
    return bills.join(t(s, d, "t_bom_line").select("bom_id", F.col("component_item_id").alias("b")), "bom_id").select("a", "b").distinct()


def _top(s: S, d: str) -> DataFrame:
    return t(s, d, "t_item").where("item_type = 'FG'").select(F.col("item_id").alias("node")).distinct()


@P.query(f"WITH {_REACH} SELECT a, b FROM r")
def graph_closure(s: S, d: str) -> DataFrame:
    """All pairs of items with a way between them."""
    return g.closure(_calls(s, d), a="a", b="b")


@P.query(f"WITH RECURSIVE e AS MATERIALIZED ({_CALLS}), {_FROM_TOP} SELECT node FROM c")
def graph_reachable(s: S, d: str) -> DataFrame:
    """The scope of entry points."""
    return g.reachable(_calls(s, d), _top(s, d), a="a", b="b", node="node")


@P.query(f"""WITH RECURSIVE e AS MATERIALIZED ({_CALLS} WHERE h.status = 'ACTIVE'), f AS MATERIALIZED ({_CALLS} WHERE h.status <> 'ACTIVE'), {_FROM_TOP}
    SELECT node, 'call' AS how FROM c UNION ALL SELECT DISTINCT b, 'ref' FROM f WHERE a IN (SELECT node FROM c) AND b NOT IN (SELECT node FROM c)""")
def graph_lazy_closure(s: S, d: str) -> DataFrame:
    """What a scan from entry points has to read: what is called, and what is only referred to."""
    return g.lazy_closure(_calls(s, d, "status = 'ACTIVE'"), _calls(s, d, "status <> 'ACTIVE'"), _top(s, d), a="a", b="b", node="node")


_PARTS = f"{_REACH}, n AS (SELECT DISTINCT item_id AS node FROM t_item), m AS MATERIALIZED (SELECT x.a AS node, min(x.b) AS b FROM r x WHERE EXISTS (SELECT 1 FROM r y WHERE y.a = x.b AND y.b = x.a) GROUP BY 1), c AS MATERIALIZED (SELECT node, coalesce(b, node) AS component FROM n LEFT JOIN m USING (node))"


@P.query(f"WITH {_PARTS} SELECT node, component FROM c")
def graph_strong_components(s: S, d: str) -> DataFrame:
    """Strongly connected components, named by their smallest item."""
    return g.strong_components(t(s, d, "t_item"), _calls(s, d), node="item_id", a="a", b="b")


@P.query(f"""
    WITH {_PARTS}, l AS MATERIALIZED (SELECT DISTINCT x.component AS ca, y.component AS cb FROM e JOIN c x ON x.node = e.a JOIN c y ON y.node = e.b WHERE x.component <> y.component),
    w AS (SELECT DISTINCT component AS c, 0 AS layer FROM c UNION SELECT l.ca, w.layer + 1 FROM w JOIN l ON l.cb = w.c)
    SELECT node, component, layer FROM c JOIN (SELECT c AS component, max(layer) AS layer FROM w GROUP BY 1) USING (component)""")
def graph_layers(s: S, d: str) -> DataFrame:
    """Dependency layers: what is used first, members of a component together."""
    return g.layers(t(s, d, "t_item"), _calls(s, d), node="item_id", a="a", b="b")


@P.query(f"""
    WITH RECURSIVE c AS MATERIALIZED ({_CALLS}), u AS MATERIALIZED (SELECT DISTINCT item_id AS unit, item_type = 'FG' AS top, category_id % 5 AS pkg FROM t_item),
    r AS (SELECT p.unit AS owner, p.pkg, f.unit AS f, 1 AS dist FROM u p JOIN c ON c.a = p.unit JOIN u f ON f.unit = c.b AND f.pkg = p.pkg WHERE p.top AND NOT f.top
      UNION SELECT r.owner, r.pkg, f.unit, r.dist + 1 FROM r JOIN c ON c.a = r.f JOIN u f ON f.unit = c.b AND f.pkg = r.pkg WHERE NOT f.top AND r.dist < 40)
    SELECT f AS unit, arg_min(owner, (dist, owner)) AS owner FROM r GROUP BY 1""")
def graph_owners(s: S, d: str) -> DataFrame:
    """The top item of its group that each item belongs to: the nearest that uses it, directly or through others of the group."""
    kind = F.when(F.col("item_type") == "FG", "PROCEDURE").otherwise("FUNCTION")
    units = t(s, d, "t_item").select(F.col("item_id").alias("unit"), kind.alias("kind"), (F.col("category_id") % 5).alias("pkg")).distinct()
    return g.owners(units, _calls(s, d), unit="unit", kind="kind", package="pkg", caller="a", callee="b")


@P.query("""
    WITH RECURSIVE i AS MATERIALIZED (SELECT layer, g, n, row_number() OVER (PARTITION BY layer ORDER BY g) AS k FROM (SELECT DISTINCT coalesce(category_id, 0) AS layer, item_code AS g, CAST(1 + item_id % 4 AS INTEGER) AS n FROM t_item)),
    w AS (SELECT layer, g, k, 0 AS shard, n AS used FROM i WHERE k = 1 UNION ALL SELECT i.layer, i.g, i.k, CASE WHEN w.used + i.n > 25 THEN w.shard + 1 ELSE w.shard END, CASE WHEN w.used + i.n > 25 THEN i.n ELSE w.used + i.n END FROM w JOIN i ON i.layer = w.layer AND i.k = w.k + 1)
    SELECT layer, g AS "group", shard FROM w""")
def graph_shards(s: S, d: str) -> DataFrame:
    """Groups packed into shards of bounded size, in order."""
    x = t(s, d, "t_item").select(F.coalesce("category_id", F.lit(0)).alias("layer"), F.col("item_code").alias("g"), (1 + F.col("item_id") % 4).cast("int").alias("n")).distinct()
    return g.shards(x, layer="layer", group="g", size="n", most=25)


@P.query("""SELECT item_id, CASE WHEN count(*) OVER (PARTITION BY category_id, upper(item_name)) > 1 THEN item_name || '__' || row_number() OVER (PARTITION BY category_id, upper(item_name) ORDER BY item_id) ELSE item_name END AS ref_name
    FROM (SELECT DISTINCT item_id, category_id, item_name FROM t_item)""")
def overload_names(s: S, d: str) -> DataFrame:
    """Reference names of units that share a name."""
    x = t(s, d, "t_item").select("item_id", "category_id", "item_name").distinct()
    return g.ref_names(x, package="category_id", name="item_name", position="item_id").select("item_id", "ref_name")
