"""Units: readings, factors and rounding, and the defined cases."""

from decimal import Decimal

import pytest

from tamarack.operators.units import to_base_units

FACTORS = [("PCS", "EA", 1), ("DZ", "EA", 12), ("BOX", "EA", 50), ("MIL", "EA", 1000), ("G", "KG", Decimal("0.001")), ("LB", "KG", Decimal("0.453592")), ("OZ", "KG", Decimal("0.02835")), ("CM", "M", Decimal("0.01")), ("FT", "M", Decimal("0.3048")), ("M3", "L", 1000), ("ML", "L", Decimal("0.001")), ("KG", "G", 1000)]
ITEMS = [(1, "Stück"), (2, "ＫＧ"), (3, "metre"), (4, "L"), (5, "g."), (6, "?"), (7, None), (1, "Stück")]


def run(spark, rows, factors=FACTORS, **more):
    lines = spark.createDataFrame([(i, item, None if q is None else Decimal(str(q)), u, n, "x", "y") for i, (item, q, u, n) in enumerate(rows)], "id long, item_id long, qty decimal(18,4), uom string, note string, unit string, size string")
    items = spark.createDataFrame(ITEMS, "item_id long, base_uom string")
    conv = spark.createDataFrame([(a, b, Decimal(str(f))) for a, b, f in factors], "from_uom string, to_uom string, factor decimal(20,8)")
    got = to_base_units(lines, items, conv, line_id="id", item_id="item_id", quantity="qty", unit="uom", note="note", **more).collect()
    return {r["id"]: r["base_qty_e4"] for r in got}


CASES = [
    ((1, 3, "Dz.", None), 36), ((1, 3, "per 30 PCS", None), 90), ((1, 2, "x1,000 ea", None), 2000), ((1, 2, "千件", None), 2000), ((1, 2, "per mille pcs", None), 2000), ((1, 2, "thousand pcs", None), 2000), ((1, 2, "百个", None), 200),
    ((1, 2, "bag", "content 12 EA"), 24), ((1, 2, "bag of 6 pcs", None), 12), ((1, 2, "30件/袋", None), 60), ((1, 2, "每袋4件", None), 8), ((1, 2, "roll@8EA", None), 16), ((1, 2, "PACK (9 EA)", None), 18),
    ((1, 2, None, "urgent; all figures pieces"), 2), ((1, 2, "see note", "UoM=BOX"), 100), ((1, 2, "", "Mengenangabe: DZ"), 24), ((1, 2, "桶", "1 桶 = 25 个, 加急"), 50), ((1, 2, "LOT", "each 桶 holds 5 PCS"), 10), ((1, 2, "PAL", "10 Ea. per 袋"), 20),
    ((1, 2, "Each", "forklift limit 2 t"), 2), ((1, 2, None, "单位：个"), 2), ((1, 2, None, "按件下单"), 2), ((1, 2, None, "数量以件计"), 2), ((1, 2, "can", "pack size: 12PCS, urgent"), 24), ((1, 2, "卷", "规格 6个"), 12),
    ((2, 2, "½ kg", None), 1), ((2, 2, "1/2 KG", None), 1), ((2, 2, "每桶2,5公斤", None), 5), ((2, 2, "ton (metric)", None), None), ((2, 10, "lbs", None), Decimal("4.53592")), ((2, 3, "g", None), Decimal("0.003")), ((5, 2, "LB", None), Decimal("907.184")), ((5, 2, "oz", None), Decimal("56.7")),
    ((3, 2, "英尺", None), Decimal("0.6096")), ((3, 2, None, "all figures feet"), Decimal("0.6096")), ((4, 2, "m³", None), 2000), ((4, 250, "毫升", None), Decimal("0.25")), ((4, 2, "x1.5 liter", None), 3),
    ((1, 2, "KG", None), None), ((1, 2, "AU", None), None), ((1, 2, None, "stack max 3 layers, 25 kg per hand lift"), None), ((1, 2, None, None), None), ((6, 2, "ea", None), None), ((7, 2, "ea", None), None), ((99, 2, "ea", None), None), ((1, None, "ea", None), None), ((None, 2, "ea", None), None),
]


def test_readings(spark):
    got = run(spark, [c for c, _ in CASES])
    for i, (case, want) in enumerate(CASES):
        exact = None if want is None else int((Decimal(want) * 10000).quantize(Decimal(1), rounding="ROUND_HALF_UP"))
        assert got.get(i) == exact, case


def test_later_clauses_of_a_note_count(spark):
    cases = [((2, 2, "LOT", "unit price agreed; content 25 kg"), 50), ((1, 2, None, "unit price agreed, UoM=DZ"), 24), ((1, 2, "bag", "按时交货; 10 ea per bag"), 20), ((1, 2, "bag", "content as agreed; pack size: 5 pcs, content 6 pcs"), 10), ((1, 2, "bag", "unit price agreed"), None)]
    got = run(spark, [c for c, _ in cases])
    assert [got.get(i) for i in range(len(cases))] == [None if want is None else want * 10000 for _, want in cases]


def test_rounds_half_up_away_from_zero(spark):
    got = run(spark, [(5, "0.0001", "x", None)] and [(3, "0.0050", "CM", None), (3, "-0.0050", "CM", None), (3, "0.0049", "CM", None)])
    assert got == {0: 1, 1: -1, 2: 0}


def test_default_unit_and_offsets(spark):
    from pyspark.sql import functions as F

    assert run(spark, [(1, 2, None, None)], default_unit=F.lit("DZ")) == {0: 240000}
    lines = spark.createDataFrame([(1, 2, Decimal(212), "oz")], "id long, item_id long, qty decimal(18,4), uom string")
    conv = spark.createDataFrame([("OZ", "KG", Decimal("0.5"), Decimal("-16"))], "from_uom string, to_uom string, factor decimal(20,8), shift decimal(20,8)")
    items = spark.createDataFrame(ITEMS, "item_id long, base_uom string")
    got = to_base_units(lines, items, conv, line_id="id", item_id="item_id", quantity="qty", unit="uom", offset="shift").collect()
    assert got[0]["base_qty_e4"] == 900000


def test_repeats_empty_and_long_texts(spark):
    rows = [(1, 2, "Dz.", None)]
    lines = spark.createDataFrame([(1, 1, Decimal(2), "dz", None)] * 3, "id long, item_id long, qty decimal(18,4), uom string, note string")
    items = spark.createDataFrame(ITEMS, "item_id long, base_uom string")
    conv = spark.createDataFrame([("DZ", "EA", Decimal(12))], "from_uom string, to_uom string, factor decimal(20,8)")
    how = {"line_id": "id", "item_id": "item_id", "quantity": "qty", "unit": "uom", "note": "note"}
    assert to_base_units(lines, items, conv, **how).count() == 1
    assert to_base_units(lines.limit(0), items, conv, **how).count() == to_base_units(lines, items.limit(0), conv, **how).count() == to_base_units(lines, items, conv.limit(0), **how).count() - 0 == 0
    assert run(spark, [(1, 2, "x" * 50_000, "urgent, " * 8_000 + "UoM=DZ"), *rows]) == {0: 240000, 1: 240000}


@pytest.mark.parametrize("text", ["99999999999999.9999"])
def test_results_beyond_64_bits_are_unknown(spark, text):
    assert run(spark, [(1, text, "x999999 thousand pcs", None), (1, text, "x999999 MIL", None)]) == {}
