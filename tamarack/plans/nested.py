"""JSON, XML, collections, object types, and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import ora as o
from tamarack.operators import nested as n
from tamarack.plans.base import Plans
from tamarack.session import table as t

P = Plans()
S = SparkSession


@P.query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_exists(props, '$.z') AS has_z, json_extract_string(props, '$.k') || 'x' AS txt FROM events")
def json_scalars(s: S, d: str) -> DataFrame:
    """JSON_VALUE, JSON_EXISTS and JSON_QUERY."""
    k = F.get_json_object("props", "$.k")
    return t(s, d, "events").select("event_id", k.try_cast("int").alias("k"), F.get_json_object("props", "$.z").isNotNull().alias("has_z"), F.concat(k, F.lit("x")).alias("txt"))


@P.query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'none' AS z FROM events")
def json_table_object(s: S, d: str) -> DataFrame:
    """JSON_TABLE over an object, with a default for what is missing."""
    return n.json_table(t(s, d, "events").select("event_id", "props"), "props", "k int, z string", defaults={"z": "none"})


#: Documents of orders, each with its lines; a third of the lines have no quantity, a fifth of the orders have no lines in the text.
_DOCS = """SELECT o_orderkey AS k, l_linenumber AS no, CASE WHEN l_partkey % 3 > 0 THEN CAST(l_quantity AS BIGINT) END AS q, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 5 > 0"""


def _docs(s: S, d: str) -> DataFrame:
    lines = t(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("no"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_quantity").cast("long")).alias("q"), F.col("l_partkey").alias("p"))
    return t(s, d, "orders").select(F.col("o_orderkey").alias("k")).join(lines, "k", "left")


@P.query(f"SELECT k, no, row_number() OVER (PARTITION BY k ORDER BY no, p, q NULLS FIRST) AS pos, q, p FROM ({_DOCS})")
def json_table_array(s: S, d: str) -> DataFrame:
    """JSON_TABLE over an array in a field, with ORDINALITY; fields that are missing are null."""
    x = _docs(s, d).groupBy("k").agg(F.sort_array(F.collect_list(F.when(F.col("no").isNotNull() & (F.col("k") % 5 > 0), F.struct("no", "p", "q")))).alias("items"))
    doc = x.select("k", F.to_json(F.struct(F.struct("items").alias("doc"))).alias("doc"))
    out = n.json_table(doc, "doc", "no int, p bigint, q bigint", path="$.doc.items[*]", ordinality="pos")
    return out.select("k", "no", F.col("pos").cast("long").alias("pos"), "q", "p")


@P.query(f"""WITH x AS ({_DOCS}), o AS (SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey)
    SELECT c_custkey, pos, o_orderkey AS id, no, q FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS pos FROM o) LEFT JOIN x ON k = o_orderkey""")
def json_table_nested(s: S, d: str) -> DataFrame:
    """JSON_TABLE with NESTED PATH: orders of a customer, lines of an order; orders without lines stay."""
    lines = _docs(s, d).groupBy("k").agg(F.sort_array(F.collect_list(F.when(F.col("no").isNotNull() & (F.col("k") % 5 > 0), F.struct("no", "p", "q")))).alias("lines"))
    orders = t(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("k")).join(lines, "k")
    doc = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(F.col("k").alias("id"), "lines"))).alias("orders"))).alias("doc"))
    out = n.json_table(doc, "doc", "id bigint", path="$.orders[*]", ordinality="pos", nested=("$.lines[*]", "no int, q bigint"))
    return out.select("c_custkey", F.col("pos").cast("long").alias("pos"), "id", "no", "q")


@P.query(f"SELECT k, no, row_number() OVER (PARTITION BY k ORDER BY no, p, q NULLS FIRST) AS pos, q, p FROM ({_DOCS})")
def xml_table_rows(s: S, d: str) -> DataFrame:
    """XMLTABLE over documents made by XMLAGG, XMLELEMENT and XMLFOREST: attributes, and children that some rows lack."""
    x = _docs(s, d).where("k % 5 > 0 and no is not null")
    item = F.concat(F.lit('<i no="'), F.col("no").cast("string"), F.lit('">'), n.xml_forest(q=F.col("q"), p=F.col("p")), F.lit("</i>"))
    rows = x.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("no", "p", "q", item.alias("x")))).alias("rows"))
    doc = rows.select("k", n.xml_root(F.concat(F.lit("<r>"), F.array_join(F.transform("rows", lambda r: r["x"]), ""), F.lit("</r>"))).alias("doc"))
    out = n.xml_table(doc, "doc", "/r/i", {"no": ("int", "@no"), "q": ("bigint", "q"), "p": ("bigint", "p")}, ordinality="pos")
    return out.select("k", "no", F.col("pos").cast("long").alias("pos"), "q", "p")


@P.query("""SELECT p_partkey, '<part key="' || p_partkey || '">' || p_name || '</part>' AS element, '{"key":' || p_partkey || ',"name":"' || p_name || '"}' AS obj, '[' || p_size || ',' || p_partkey || ']' AS arr FROM part""")
def xml_and_json_constructors(s: S, d: str) -> DataFrame:
    """XMLELEMENT with XMLATTRIBUTES, JSON_OBJECT and JSON_ARRAY."""
    return t(s, d, "part").select(
        "p_partkey", n.xml_element("part", F.col("p_name"), key=F.col("p_partkey")).alias("element"), F.to_json(F.struct(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))).alias("obj"), F.to_json(F.array(F.col("p_size").cast("long"), F.col("p_partkey"))).alias("arr")
    )


@P.query("SELECT event_id, '{\"k\":' || CAST(json_extract_string(props, '$.k') AS INTEGER) || ',\"kind\":\"' || event_type || '\"}' AS changed FROM events")
def json_transform(s: S, d: str) -> DataFrame:
    """JSON_TRANSFORM: a field set, others kept."""
    x = t(s, d, "events").select("event_id", "event_type", F.from_json("props", "k int").alias("j"))
    return x.select("event_id", F.to_json(F.col("j").withField("kind", F.col("event_type"))).alias("changed"))


@P.query("SELECT item_id, tag, pos FROM (SELECT DISTINCT item_id, tags FROM t_item WHERE tags IS NOT NULL) x, LATERAL (SELECT unnest(tags) AS tag, unnest(range(1, len(tags) + 1)) AS pos) y")
def table_of_collection(s: S, d: str) -> DataFrame:
    """TABLE(collection): elements as rows, with their position."""
    x = t(s, d, "t_item").where("tags is not null").select("item_id", "tags").distinct()
    return x.select("item_id", F.posexplode("tags").alias("p", "tag")).select("item_id", "tag", (F.col("p") + 1).cast("long").alias("pos"))


@P.query("""SELECT DISTINCT item_id, CAST(coalesce(dim.length_cm, 0) * coalesce(dim.width_cm, 0) * coalesce(dim.height_cm, 0) AS DOUBLE) AS volume,
    round(CAST(coalesce(dim.length_cm, 0) * coalesce(dim.width_cm, 0) * coalesce(dim.height_cm, 0) AS DOUBLE) / 5000, 3) AS vol_weight FROM t_item""")
def object_methods(s: S, d: str) -> DataFrame:
    """Methods of an object type: expressions over a struct."""
    return t(s, d, "t_item").select("item_id", n.volume_cm3(F.col("dim")).cast("double").alias("volume"), n.volumetric_weight_kg(F.col("dim")).cast("double").alias("vol_weight")).distinct()


@P.query("SELECT DISTINCT item_id, CASE item_type WHEN 'SVC' THEN 'NONE' WHEN 'RAW' THEN 'FIFO' ELSE 'STD' END AS method, CASE item_type WHEN 'SVC' THEN 'N' ELSE 'Y' END AS stocked FROM t_item")
def object_subtypes(s: S, d: str) -> DataFrame:
    """Subtype dispatch (UNDER, OVERRIDING) by a discriminator."""
    kind = F.col("item_type")
    return t(s, d, "t_item").select("item_id", F.when(kind == "SVC", "NONE").when(kind == "RAW", "FIFO").otherwise("STD").alias("method"), F.when(kind == "SVC", "N").otherwise("Y").alias("stocked")).distinct()


@P.query("""SELECT DISTINCT i.item_id, i.item_code, i.item_name, i.item_type, i.category_id, u.factor IS NOT NULL AS has_unit, CAST(i.dim.length_cm AS DOUBLE) AS length_cm, CAST(i.dim.weight_kg AS DOUBLE) AS weight_kg,
    CAST(coalesce(i.dim.length_cm, 0) * coalesce(i.dim.width_cm, 0) * coalesce(i.dim.height_cm, 0) AS DOUBLE) AS volume_cm3 FROM t_item i LEFT JOIN (SELECT from_uom, max(factor) AS factor FROM t_uom_conversion GROUP BY 1) u ON u.from_uom = i.base_uom""")
def item_view(s: S, d: str) -> DataFrame:
    """A flat view over objects: fields, a method and a left join."""
    units = t(s, d, "t_uom_conversion").groupBy(F.col("from_uom").alias("base_uom")).agg(F.max("factor").alias("factor"))
    x = t(s, d, "t_item").select("item_id", "item_code", "item_name", "item_type", "category_id", "base_uom", "dim").distinct().join(units, "base_uom", "left")
    return x.select(
        "item_id", "item_code", "item_name", "item_type", "category_id", F.col("factor").isNotNull().alias("has_unit"), F.col("dim.length_cm").cast("double").alias("length_cm"), F.col("dim.weight_kg").cast("double").alias("weight_kg"), n.volume_cm3(F.col("dim")).cast("double").alias("volume_cm3")
    )


@P.query("""SELECT DISTINCT so_line_id, CAST(CASE uom WHEN 'KG' THEN round(qty_ordered, 3) WHEN 'EA' THEN round(qty_ordered, 0) WHEN 'M' THEN round(qty_ordered, 2) ELSE qty_ordered END AS DOUBLE) AS rounded,
    CASE WHEN qty_ordered IS NOT NULL THEN concat_ws(' ', CASE uom WHEN 'KG' THEN format('{:,.3f}', CAST(round(qty_ordered, 3) AS DECIMAL(18,3))) WHEN 'EA' THEN format('{:,}', CAST(round(qty_ordered, 0) AS BIGINT)) ELSE format('{:,.2f}', CAST(round(qty_ordered, 2) AS DECIMAL(18,2))) END, uom) END AS shown FROM t_so_line""")
def quantities_shown(s: S, d: str) -> DataFrame:
    """Quantities rounded and written by the digits of their unit."""
    digits = F.create_map(F.lit("EA"), F.lit(0), F.lit("M"), F.lit(2), F.lit("KG"), F.lit(3))
    x = t(s, d, "t_so_line").select("so_line_id", "qty_ordered", "uom").distinct()
    return x.select("so_line_id", o.round_qty(F.col("qty_ordered"), F.col("uom"), digits).cast("double").alias("rounded"), o.format_qty(F.col("qty_ordered"), F.col("uom"), digits).alias("shown")).distinct()
