"""Bills of material: explosion, use, versions and rolled costs over header, line and item tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.operators.connect_by import connect_by, rolled_up


def effective(as_of: str, *, status: str = "ACTIVE") -> Column:
    """Whether a header is in ``status`` and valid on ``as_of``, both ends included; a null end is open."""
    day = F.lit(as_of).cast("date")
    return (F.col("status") == status) & (F.col("effective_from") <= day) & (F.col("effective_to").isNull() | (F.col("effective_to") >= day))


def active_bills(headers: DataFrame, as_of: str) -> DataFrame:
    """item_id, bom_id and base_qty of the default bill in force on ``as_of``; of several the latest, then the highest bom_id.

    Items without one give no row. A repeated header changes nothing.
    """
    usable = headers.where(effective(as_of) & (F.col("is_default") == "Y"))
    best = usable.groupBy("item_id").agg(F.max(F.struct("effective_from", "bom_id", "base_qty")).alias("_b"))
    return best.select("item_id", "_b.bom_id", "_b.base_qty")


def components(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Lines with code, name, type and phantom flag of their component; the line's flag or the item's makes a phantom.

    Repeated lines and items count once; a line whose component is no item gives no row.
    """
    part = items.select(F.col("item_id").alias("component_item_id"), F.col("item_code").alias("component_code"), F.col("item_name").alias("component_name"), "item_type", F.col("is_phantom").alias("_phantom")).distinct()
    line = lines.select("line_id", "bom_id", "line_no", "component_item_id", "qty_per", "uom", "scrap_rate", F.col("is_phantom").alias("_line_phantom")).distinct()
    flag = F.when((F.coalesce("_line_phantom", F.lit("N")) == "Y") | (F.coalesce("_phantom", F.lit("N")) == "Y"), "Y").otherwise("N")
    return line.join(part, "component_item_id").withColumn("is_phantom", flag).drop("_phantom", "_line_phantom")


def with_scrap() -> Column:
    """The quantity to use with scrap: qty_per over 1 - scrap_rate (missing: 0)."""
    return F.col("qty_per").cast("double") / (1.0 - F.coalesce(F.col("scrap_rate").cast("double"), F.lit(0.0)))


def explode(headers: DataFrame, lines: DataFrame, items: DataFrame, as_of: str, *, start: DataFrame | None = None, qty: float = 1.0, round_each: bool = False, digits: int = 6) -> DataFrame:
    """Explosion of the items of ``start`` (column item_id; by default of every item with a bill) over all default bills in force.

    Returns root_item_id, lvl, parent_item_id, component_item_id, component_code,
    component_name, item_type, qty_per, cum_qty, uom, path (codes, each after a slash), is_leaf,
    is_phantom and is_cycle. cum_qty is the product of the quantities with scrap on the way,
    rounded at the end or, with ``round_each``, at every level. Phantoms are shown and passed
    through. A way never enters an item again: the row before has is_cycle 'Y'.
    """
    bills = headers.where(effective(as_of) & (F.col("is_default") == "Y")).select("bom_id", "item_id").distinct()
    edges = bills.join(components(lines, items), "bom_id").select(F.col("item_id").alias("parent_item_id"), "component_item_id", "component_code", "component_name", "item_type", "qty_per", "uom", "is_phantom", with_scrap().alias("eff"))
    roots = (start if start is not None else edges.select(F.col("parent_item_id").alias("item_id"))).select("item_id").distinct()
    step = F.col("up_cum") * F.col("eff")
    text = F.lit(None).cast("string")
    carry = {
        "cum": (F.lit(float(qty)), F.round(step, digits) if round_each else step),
        "parent_item_id": (F.lit(None).cast("long"), F.col("_up")),
        "path_text": (F.lit(""), F.concat("up_path_text", F.lit("/"), "component_code")),
        "qty_per": (F.lit(None).cast("decimal(18,6)"), F.col("qty_per")),
        **{c: (text, F.col(c)) for c in ("component_code", "component_name", "item_type", "uom", "is_phantom")},
    }
    rows = connect_by(edges, roots, parent="parent_item_id", child="component_item_id", root="item_id", carry=carry).where("level > 1")
    yes = lambda c: F.when(F.col(c) == 1, "Y").otherwise("N")
    return rows.select(
        F.col("root").alias("root_item_id"), (F.col("level") - 1).alias("lvl"), "parent_item_id", F.col("item").alias("component_item_id"), "component_code", "component_name", "item_type",
        "qty_per", F.round("cum", digits).alias("cum_qty"), "uom", F.col("path_text").alias("path"), yes("is_leaf").alias("is_leaf"), "is_phantom", yes("is_cycle").alias("is_cycle"),
    )


def where_used(headers: DataFrame, lines: DataFrame, items: DataFrame, as_of: str, *, start: DataFrame | None = None, max_levels: int | None = None) -> DataFrame:
    """The walk up from the components of ``start`` (by default all): everything they are used in, by all bills in force.

    Returns component_item_id (where the walk began), lvl, parent_item_id, parent_code, is_top
    and use_path (codes, each after '<-'). ``max_levels`` ends the walk; a way never enters an
    item again.
    """
    bills = headers.where(effective(as_of)).select("bom_id", "item_id").distinct()
    names = items.select("item_id", F.col("item_code").alias("parent_code")).distinct()
    edges = lines.select("line_id", "bom_id", "component_item_id").distinct().join(bills, "bom_id").join(names, "item_id").select(F.col("item_id").alias("parent_item_id"), "component_item_id", "parent_code")
    roots = (start if start is not None else edges).select(F.col("component_item_id")).distinct()
    carry = {"parent_code": (F.lit(None).cast("string"), F.col("parent_code")), "use_path": (F.lit(""), F.concat("up_use_path", F.lit("<-"), "parent_code"))}
    stop = None if max_levels is None else max_levels + 1
    rows = connect_by(edges, roots, parent="component_item_id", child="parent_item_id", root="component_item_id", carry=carry, stop_level=stop).where("level > 1")
    return rows.select(F.col("root").alias("component_item_id"), (F.col("level") - 1).alias("lvl"), F.col("item").alias("parent_item_id"), "parent_code", F.col("is_leaf").alias("is_top"), "use_path")


def compare_versions(pairs: DataFrame, lines: DataFrame, items: DataFrame) -> DataFrame:
    """How the new bill of each pair (old_bom_id, new_bom_id) differs from the old one.

    change_type is ADDED or REMOVED for components that only one of them has, QTY_CHANGED for
    each two lines of a component with unequal quantities, unless some line of it is equal in
    all columns. Bags, as MULTISET EXCEPT and INTERSECT compare; one cogroup by pair and
    component with anti joins only. A pair with a null bill or one without lines counts as empty.
    """
    line = components(lines, items).select("bom_id", "component_item_id", "component_code", "qty_per", "uom", F.coalesce("scrap_rate", F.lit(0).cast("decimal(8,4)")).alias("scrap_rate"))
    pair = pairs.select("old_bom_id", "new_bom_id").dropna().distinct()
    ids = ["old_bom_id", "new_bom_id", "component_item_id"]
    old = pair.join(line, F.col("old_bom_id") == F.col("bom_id")).drop("bom_id")
    new = pair.join(line, F.col("new_bom_id") == F.col("bom_id")).drop("bom_id")
    nothing = F.lit(None).cast("decimal(18,6)")
    added = new.join(old.select(*ids), ids, "left_anti").select(F.lit("ADDED").alias("change_type"), *ids, "component_code", nothing.alias("old_qty_per"), F.col("qty_per").alias("new_qty_per"), "uom")
    removed = old.join(new.select(*ids), ids, "left_anti").select(F.lit("REMOVED").alias("change_type"), *ids, "component_code", F.col("qty_per").alias("old_qty_per"), nothing.alias("new_qty_per"), "uom")
    equal = old.join(new, [*ids, "component_code", "qty_per", "uom", "scrap_rate"], "left_semi").select(*ids)
    both = old.select(*ids, "component_code", F.col("qty_per").alias("old_qty_per")).join(new.select(*ids, F.col("qty_per").alias("new_qty_per"), "uom"), ids).where("old_qty_per <> new_qty_per")
    changed = both.join(equal, ids, "left_anti").select(F.lit("QTY_CHANGED").alias("change_type"), *ids, "component_code", "old_qty_per", "new_qty_per", "uom")
    return added.unionByName(removed).unionByName(changed)


def unit_costs(headers: DataFrame, lines: DataFrame, items: DataFrame, as_of: str, *, digits: int = 6) -> DataFrame:
    """item_id and unit_cost of every item: its standard cost, or what its bill in force adds up to per unit of output.

    Costs are rounded at each node. A bill without lines costs 0. Items on a loop or above one
    have a null cost.
    """
    bills = active_bills(headers, as_of)
    line = lines.select("line_id", "bom_id", "component_item_id", "qty_per", "scrap_rate").distinct()
    edges = bills.join(line, "bom_id").select("item_id", "component_item_id", "base_qty", with_scrap().alias("eff"))
    own = items.select("item_id", "std_cost").distinct()
    empty = bills.join(line, "bom_id", "left_anti").select("item_id", F.lit(0.0).alias("std_cost"))
    leaves = own.select("item_id", F.col("std_cost").cast("double").alias("std_cost")).join(empty, "item_id", "left_anti").unionByName(empty)
    rolled = rolled_up(edges, leaves, parent="item_id", child="component_item_id", quantity="eff", item="item_id", value="std_cost", per="base_qty", digits=digits)
    made = edges.select("item_id", F.lit(True).alias("_made")).distinct()
    return leaves.join(rolled.select(F.col("item").alias("item_id"), "value"), "item_id", "full").join(made, "item_id", "left").select("item_id", F.when(F.col("_made"), F.col("value")).otherwise(F.coalesce("value", "std_cost")).alias("unit_cost"))
