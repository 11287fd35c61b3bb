"""Queries p1 to p4: the general operators applied to the whole ERP tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators.asof import as_of_join
from tamarack.operators.hierarchy import all_below, hierarchy
from tamarack.operators.intervals import periods_and_gaps
from tamarack.operators.units import ALIASES, NUMBER_WORDS, PHRASES, to_base_units
from tamarack.session import table

STANDARD = "rule_type = 'LIST' and item_id is not null and category_id is null and customer_id is null"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Of every sales line the standard price rule that was valid and recorded on the order date."""
    orders = table(spark, d, "t_sales_order").select("so_id", "order_date", "price_list_id").where("price_list_id is not null").distinct()
    lines = table(spark, d, "t_so_line").select("so_line_id", "so_id", "item_id").where("item_id is not null")
    return as_of_join(
        lines.join(orders, "so_id"),
        table(spark, d, "t_price_rule").where(STANDARD),
        event_id="so_line_id", keys=[("price_list_id", "price_list_id"), ("item_id", "item_id")], event_date="order_date",
        rule_id="rule_id", valid_from="valid_from", valid_to="valid_to", known_from="created_at",
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous periods of two or more records and the gaps, of BOM versions and of standard price rules."""
    bom = table(spark, d, "t_bom_header").select(F.lit("bom").alias("src"), F.lit(0).cast("long").alias("price_list_id"), "item_id", F.col("bom_id").alias("id"), F.col("effective_from").alias("date_from"), F.col("effective_to").alias("date_to"))
    price = table(spark, d, "t_price_rule").where(STANDARD).select(F.lit("price").alias("src"), "price_list_id", "item_id", F.col("rule_id").alias("id"), F.col("valid_from").alias("date_from"), F.col("valid_to").alias("date_to"))
    out = periods_and_gaps(bom.unionByName(price), entity=["src", "price_list_id", "item_id"], record_id="id", date_from="date_from", date_to="date_to")
    written = lambda c: F.date_format(F.date_from_unix_date(F.col(c)), "yyyy-MM-dd")
    return out.where("kind = 'gap' or n_records > 1").select("src", "price_list_id", "item_id", "kind", written("first_day").alias("date_from"), written("last_day").alias("date_to"))


def _bom(spark: SparkSession, d: str) -> DataFrame:
    headers = table(spark, d, "t_bom_header").select("bom_id", "item_id").distinct()
    lines = table(spark, d, "t_bom_line").select("bom_id", "component_item_id")
    return headers.join(lines, "bom_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every path from a root item through the bills of material, and every item on a loop."""
    paths, cycles = hierarchy(_bom(spark, d), parent="item_id", child="component_item_id")
    rows = paths.select(F.lit("path").alias("kind"), F.col("root").alias("root_item_id"), F.col("item").alias("item_id"), "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))
    loops = cycles.select(F.lit("cycle").alias("kind"), F.col("root").alias("root_item_id"), F.col("item").alias("item_id"), F.lit(-1).alias("depth"), F.lit("").alias("path"))
    return rows.unionByName(loops)


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Everything below every item, on loops too, with the smallest number of links."""
    return all_below(_bom(spark, d), parent="item_id", child="component_item_id").select(F.col("item").alias("item_id"), F.col("descendant").alias("descendant_item_id"), "links")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Order lines whose quantity in the item's base unit differs from the figure as written."""
    items, conversions = table(spark, d, "t_item"), table(spark, d, "t_uom_conversion")
    common = {"items": items, "conversions": conversions, "item_id": "item_id", "quantity": "qty_ordered", "unit": "uom"}
    purchase = to_base_units(table(spark, d, "t_po_line"), line_id="po_line_id", note="line_note", **common)
    sales = to_base_units(table(spark, d, "t_so_line"), line_id="so_line_id", **common)
    both = purchase.select(F.lit("po").alias("line_kind"), F.col("po_line_id").alias("line_id"), "qty_e4", "base_qty_e4").unionByName(
        sales.select(F.lit("so").alias("line_kind"), F.col("so_line_id").alias("line_id"), "qty_e4", "base_qty_e4")
    )
    return both.where("qty_e4 != base_qty_e4").select("line_kind", "line_id", "base_qty_e4")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_descendants": p3_descendants, "p4_found": p4_found}

_STD = "rule_type = 'LIST' AND item_id IS NOT NULL AND category_id IS NULL AND customer_id IS NULL"

ORACLES = {
    "p1_found": f"""
        SELECT so_line_id, m[2] AS rule_id FROM (
          SELECT l.so_line_id, max((r.valid_from, r.rule_id)) AS m
          FROM (SELECT DISTINCT so_line_id, so_id, item_id FROM t_so_line) l
          JOIN (SELECT DISTINCT so_id, order_date, price_list_id FROM t_sales_order) o ON l.so_id = o.so_id
          JOIN (SELECT DISTINCT rule_id, price_list_id, item_id, valid_from, valid_to, created_at FROM t_price_rule WHERE {_STD}) r
            ON r.price_list_id = o.price_list_id AND r.item_id = l.item_id AND r.valid_from <= o.order_date
           AND (r.valid_to IS NULL OR r.valid_to >= o.order_date) AND CAST(r.created_at AS DATE) <= o.order_date
          GROUP BY 1)""",
    "p2_found": f"""
        WITH rec AS (
          SELECT DISTINCT 'bom' AS src, CAST(0 AS BIGINT) AS price_list_id, item_id, bom_id AS id, effective_from AS f, coalesce(effective_to, DATE '9999-12-31') AS t FROM t_bom_header
          UNION ALL
          SELECT DISTINCT 'price', price_list_id, item_id, rule_id, valid_from, coalesce(valid_to, DATE '9999-12-31') FROM t_price_rule WHERE {_STD}),
        ok AS (SELECT *, max(t) OVER (PARTITION BY src, price_list_id, item_id ORDER BY f, t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM rec WHERE f <= t),
        isl AS (SELECT *, sum(CASE WHEN seen IS NULL OR datediff('day', seen, f) > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY src, price_list_id, item_id ORDER BY f, t, id ROWS UNBOUNDED PRECEDING) AS g FROM ok),
        per AS (SELECT src, price_list_id, item_id, g, min(f) AS f, max(t) AS t, count(*) AS n FROM isl GROUP BY ALL),
        nxt AS (SELECT *, lead(f) OVER (PARTITION BY src, price_list_id, item_id ORDER BY g) AS nf FROM per)
        SELECT src, price_list_id, item_id, 'period' AS kind, strftime(f, '%Y-%m-%d') AS date_from, strftime(t, '%Y-%m-%d') AS date_to FROM per WHERE n > 1
        UNION ALL
        SELECT src, price_list_id, item_id, 'gap', strftime(t + INTERVAL 1 DAY, '%Y-%m-%d'), strftime(nf - INTERVAL 1 DAY, '%Y-%m-%d') FROM nxt WHERE nf IS NOT NULL""",
    "p3_found": """
        WITH RECURSIVE link AS (SELECT DISTINCT h.item_id AS p, l.component_item_id AS c FROM t_bom_header h JOIN t_bom_line l ON h.bom_id = l.bom_id),
        walk AS (
          SELECT DISTINCT p AS root, p AS item, 0 AS depth, [p] AS path FROM link WHERE p NOT IN (SELECT c FROM link)
          UNION ALL
          SELECT w.root, k.c, w.depth + 1, list_append(w.path, k.c) FROM walk w JOIN link k ON w.item = k.p WHERE NOT list_contains(w.path, k.c)),
        reach AS (SELECT p AS a, c AS b FROM link UNION SELECT r.a, k.c FROM reach r JOIN link k ON r.b = k.p),
        loops AS (SELECT x.a AS item, min(x.b) AS root FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
        SELECT 'path' AS kind, root AS root_item_id, item AS item_id, depth, array_to_string(path, '/') AS path FROM walk
        UNION ALL SELECT 'cycle', root, item, -1, '' FROM loops""",
    "p3_descendants": """
        WITH RECURSIVE link AS (SELECT DISTINCT h.item_id AS p, l.component_item_id AS c FROM t_bom_header h JOIN t_bom_line l ON h.bom_id = l.bom_id),
        walk AS (
          SELECT p AS item_id, c AS descendant_item_id, [p, c] AS path FROM link WHERE p <> c
          UNION ALL
          SELECT w.item_id, k.c, list_append(w.path, k.c) FROM walk w JOIN link k ON w.descendant_item_id = k.p WHERE NOT list_contains(w.path, k.c))
        SELECT item_id, descendant_item_id, min(CAST(len(path) - 1 AS INTEGER)) AS links FROM walk GROUP BY 1, 2""",
}

_NAMES = ", ".join(f"('{w}', '{u}')" for u, words in ALIASES.items() for w in [*words.split(), *PHRASES.get(u, [])])
_WORDS = ", ".join(f"('{w}', {v})" for w, v in NUMBER_WORDS.items())
_BAGS = "(?:bag|sack|roll|reel|drum|can|pack|pallet|pal|桶|袋|卷|罐|包)s?"
_TIDY = "trim(replace(regexp_replace(lower(replace(replace(replace(translate({}, '０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ：，（）　', '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ:,() '), '³', '3'), '½', ' 1/2 '), '⁄', '/')), '\\s+', ' ', 'g'), 'ton (metric)', 'tonne'))"

#: The same reading in other steps: drop cue words and containers from both ends, then split what is left into a number and a unit.
ORACLES["p4_found"] = f"""
    WITH nm(spelling, unit) AS (VALUES {_NAMES}), wd(word, v) AS (VALUES {_WORDS}),
    ln AS (
      SELECT DISTINCT 'po' AS line_kind, po_line_id AS line_id, item_id, qty_ordered AS q, {_TIDY.format("uom")} AS u, {_TIDY.format("line_note")} AS t FROM t_po_line WHERE qty_ordered IS NOT NULL
      UNION ALL SELECT DISTINCT 'so', so_line_id, item_id, qty_ordered, {_TIDY.format("uom")}, NULL FROM t_so_line WHERE qty_ordered IS NOT NULL),
    cl AS (SELECT line_kind, line_id, unnest(regexp_split_to_array(t, '[;,] ')) AS c FROM ln WHERE t IS NOT NULL),
    cue AS (
      SELECT line_kind, line_id, trim(CASE
          WHEN regexp_matches(c, '^(content|pack size:|规格|quantity stated in|qty in|all figures|supplier counts|uom=|mengenangabe:|单位:|数量以|按)') THEN regexp_replace(regexp_replace(c, '^(content|pack size:|规格|quantity stated in|qty in|all figures|supplier counts|uom=|mengenangabe:|单位:|数量以|按) ?', ''), '( here|计|下单)$', '')
          WHEN regexp_matches(c, '^每{_BAGS}') THEN regexp_replace(c, '^每{_BAGS} ?', '')
          WHEN regexp_matches(c, '^1 {_BAGS} = ') THEN regexp_replace(c, '^1 {_BAGS} = ', '')
          WHEN regexp_matches(c, '^each {_BAGS} holds ') THEN regexp_replace(c, '^each {_BAGS} holds ', '')
          WHEN regexp_matches(c, '^[0-9].* per {_BAGS}$') THEN regexp_replace(c, ' per {_BAGS}$', '') END) AS x FROM cl),
    fld AS (
      SELECT line_kind, line_id, item_id, q, trim(regexp_replace(regexp_replace(regexp_replace(u, '^每?{_BAGS} ?(of |@|[(])? ?', ''), ' ?(/ ?{_BAGS}|[)])$', ''), '^(x|per ) ?', '')) AS x FROM ln),
    src AS (
      SELECT line_kind, line_id, item_id, q, 1 AS pr, x FROM fld UNION ALL
      SELECT f.line_kind, f.line_id, f.item_id, f.q, 2, c.x FROM fld f JOIN cue c USING (line_kind, line_id) WHERE c.x IS NOT NULL),
    prs AS (
      SELECT *, trim(regexp_extract(x, '^([0-9]+ ?/ ?[0-9]+|[0-9][0-9.,]*|[半十百千万]|(?:half|hundred|thousand|mille) )? ?(.*)$', 1)) AS n,
             trim(regexp_extract(x, '^([0-9]+ ?/ ?[0-9]+|[0-9][0-9.,]*|[半十百千万]|(?:half|hundred|thousand|mille) )? ?(.*)$', 2)) AS w FROM src),
    one AS (
      SELECT p.*, nm.unit, row_number() OVER (PARTITION BY line_kind, line_id ORDER BY pr) AS k,
        CASE WHEN n = '' THEN 1 WHEN n LIKE '%/%' THEN CAST(split_part(n, '/', 1) AS DECIMAL(18,6)) / CAST(split_part(n, '/', 2) AS DECIMAL(18,6))
             WHEN regexp_matches(n, '^[0-9]{{1,3}}(,[0-9]{{3}})+$') THEN CAST(replace(n, ',', '') AS DECIMAL(18,6))
             WHEN regexp_matches(n, '^[0-9]') THEN CAST(replace(n, ',', '.') AS DECIMAL(18,6)) ELSE wd.v END AS size
      FROM prs p JOIN nm ON p.w = nm.spelling LEFT JOIN wd ON p.n = wd.word),
    it AS (SELECT DISTINCT i.item_id, nm.unit AS base FROM t_item i JOIN nm ON {_TIDY.format("i.base_uom")} = nm.spelling),
    cv AS (SELECT from_uom AS unit, to_uom AS common, factor FROM t_uom_conversion UNION SELECT to_uom, to_uom, 1 FROM t_uom_conversion UNION SELECT from_uom, from_uom, 1 FROM t_uom_conversion),
    rt AS (SELECT a.unit, b.unit AS base, arg_min(CAST(a.factor AS DECIMAL(18,8)), (a.common <> b.unit, a.common)) AS up, arg_min(CAST(b.factor AS DECIMAL(18,8)), (a.common <> b.unit, a.common)) AS down FROM cv a JOIN cv b ON a.common = b.common GROUP BY 1, 2),
    res AS (
      SELECT line_kind, line_id, CAST(q * 10000 AS BIGINT) AS q4,
        CAST(sign(q) AS BIGINT) * CAST((2 * qi * si * ui + di * 1000000) // (2 * di * 1000000) AS BIGINT) AS base_qty_e4
      FROM (SELECT *, CAST(abs(q) * 10000 AS HUGEINT) AS qi, CAST(replace(CAST(CAST(size AS DECIMAL(18,6)) AS VARCHAR), '.', '') AS HUGEINT) AS si,
              CAST(replace(CAST(CAST(up AS DECIMAL(20,8)) AS VARCHAR), '.', '') AS HUGEINT) AS ui, CAST(replace(CAST(CAST(down AS DECIMAL(20,8)) AS VARCHAR), '.', '') AS HUGEINT) AS di
            FROM one JOIN it USING (item_id) JOIN rt USING (unit, base) WHERE k = 1))
    SELECT line_kind, line_id, base_qty_e4 FROM res WHERE q4 <> base_qty_e4"""
