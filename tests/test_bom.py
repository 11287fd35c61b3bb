"""Bills of material: explosion, use, versions, costs and levels on small tables, loops and deep chains included."""

import datetime as dt

import pytest

from tamarack.operators import bom
from tamarack.operators import connect_by as c

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    def bill(b, item, base=1.0, default="Y", since=DAY, to=None, status="ACTIVE"):
        return b, item, base, status, default, since, to

    def line(n, b, item, qty, scrap=None, phantom="N", no=10):
        return n, b, no, item, qty, "PCS", scrap, phantom

    headers = [bill(1, 101, 2.0), bill(2, 111), bill(2, 111), bill(3, 101, since=dt.date(2023, 1, 1), default="N"), bill(4, 201), bill(5, 202), bill(6, 301), bill(7, 111, status="DRAFT")]
    lines = [line(1, 1, 111, 3.0, 0.1), line(2, 1, 121, 1.0, no=20), line(2, 1, 121, 1.0, no=20), line(3, 2, 121, 0.3333333, phantom="Y"), line(4, 3, 111, 4.0), line(5, 4, 202, 1.0), line(6, 5, 201, 1.0), line(7, 3, 131, 1.0)]
    items = [(i, f"C{i}", f"name {i}", "RAW", "N", 1.5) for i in (101, 111, 121, 131, 201, 202, 301, 999)]
    return (
        spark.createDataFrame(headers, "bom_id long, item_id long, base_qty double, status string, is_default string, effective_from date, effective_to date"),
        spark.createDataFrame(lines, "line_id long, bom_id long, line_no int, component_item_id long, qty_per double, uom string, scrap_rate double, is_phantom string"),
        spark.createDataFrame(items, "item_id long, item_code string, item_name string, item_type string, is_phantom string, std_cost double"),
    )


def test_explosion(spark, tables):
    got = {(r["root_item_id"], r["path"]): (r["lvl"], r["cum_qty"], r["is_leaf"], r["is_phantom"], r["is_cycle"]) for r in bom.explode(*tables, "2024-06-30").collect()}
    assert got[101, "/C111"] == (1, 3.333333, "N", "N", "N")
    assert got[101, "/C111/C121"] == (2, 1.111111, "Y", "Y", "N")
    assert got[201, "/C202"] == (1, 1.0, "Y", "N", "Y") and got[202, "/C201"][4] == "Y"
    assert len(got) == 6
    twice = bom.explode(*tables, "2024-06-30", start=spark.createDataFrame([(101,)], "item_id long"), qty=2.0, round_each=True).collect()
    assert sorted(r["cum_qty"] for r in twice) == [2.0, 2.222222, 6.666667]
    assert bom.explode(tables[0].limit(0), tables[1], tables[2], "2024-06-30").count() == 0


def test_use_versions_and_bills(spark, tables):
    headers, lines, items = tables
    used = {(r["component_item_id"], r["use_path"]): r["is_top"] for r in bom.where_used(headers, lines, items, "2024-06-30").collect()}
    assert used[121, "<-C111<-C101"] == 1 and used[121, "<-C101"] == 1 and used[131, "<-C101"] == 1 and (202, "<-C201") in used
    pairs = spark.createDataFrame([(3, 1), (None, 1), (3, 1)], "old_bom_id long, new_bom_id long")
    got = sorted((r["change_type"], r["component_item_id"], r["old_qty_per"], r["new_qty_per"]) for r in bom.compare_versions(pairs, lines, items).collect())
    assert got == [("ADDED", 121, None, 1.0), ("QTY_CHANGED", 111, 4.0, 3.0), ("REMOVED", 131, 1.0, None)]
    assert {r["item_id"]: r["bom_id"] for r in bom.active_bills(headers, "2023-06-30").collect()} == {}


def test_costs(tables):
    got = {r["item_id"]: r["unit_cost"] for r in bom.unit_costs(*tables, "2024-06-30").collect()}
    assert got[111] == 0.5 and got[101] == round((0.5 * 3 / 0.9 + 1.5) / 2, 6) and got[999] == 1.5
    assert got[301] == 0.0 and got[201] is None and got[202] is None


def test_a_chain_of_two_hundred_links(spark):
    links = spark.createDataFrame([(i, i + 1, 1.0) for i in range(200)], "p long, c long, q double")
    got = c.rolled_up(links, spark.createDataFrame([(200, 7.0)], "i long, v double"), parent="p", child="c", quantity="q", item="i", value="v").collect()
    assert {r["item"]: r["value"] for r in got} == {i: 7.0 for i in range(201)}


def test_levels_stop_at_loops_only(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(0, 60), (70, 71), (71, 72), (72, 71), (72, 73), (None, 5)], "p long, c long")
    got = {r["item"]: r["llc"] for r in c.low_level_codes(links, parent="p", child="c").collect()}
    assert got == {**{i: i for i in range(61)}, 70: 0, 71: None, 72: None, 73: None}
    assert c.low_level_codes(links.limit(0), parent="p", child="c").count() == 0


def test_walk_that_ends_at_a_level(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "p long, c long")
    start = spark.createDataFrame([(1,)], "i long")
    got = sorted((r["item"], r["level"], r["is_leaf"], r["is_cycle"]) for r in c.connect_by(links, start, parent="p", child="c", root="i", stop_level=2).collect())
    assert got == [(1, 1, 0, 0), (2, 2, 1, 0)]
    full = sorted((r["item"], r["is_cycle"]) for r in c.connect_by(links, start, parent="p", child="c", root="i").collect())
    assert full == [(1, 0), (2, 0), (3, 1)]
