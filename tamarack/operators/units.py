"""Quantities in different units and spellings to common units."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators.bounded import small

# Spellings of units, by standard unit.
ALIASES = {
    "EA": "ea ea. each stk stk. stück stueck unit units unidad unidades 个 只",
    "PCS": "pcs pcs. pc pc. piece pieces pieza piezas 件",
    "PR": "pr pr. pair pairs paar par pares 双 对",
    "DZ": "dz dz. doz doz. dozen dozens dutzend docena docenas 打",
    "BOX": "box box. boxes 盒",
    "CTN": "ctn ctn. ctns carton cartons karton kartons 箱",
    "MIL": "mil mille thousand",
    "KG": "kg kg. kgs kgs. kilo kilos kilogram kilograms kilogramm kilogramo kilogramos 千克 公斤",
    "G": "g g. gm gms gr gr. gram grams gramm gramme gramo gramos 克",
    "MG": "mg mg. milligram milligrams milligramm miligramo 毫克",
    "T": "t t. mt ton tons tonne tonnes tonelada toneladas 吨 公吨",
    "LB": "lb lb. lbs lbs. pound pounds pfund libra libras 磅",
    "OZ": "oz oz. ounce ounces unze unzen onza onzas 盎司",
    "M": "m m. mtr mtr. mtrs meter meters metre metres metro metros 米 公尺",
    "CM": "cm cm. cms centimetre centimetres centimeter centimeters zentimeter centímetro centímetros 厘米 公分",
    "MM": "mm mm. mms millimetre millimetres millimeter millimeters milímetro milímetros 毫米",
    "KM": "km km. kms kilometre kilometres kilometer kilometers kilómetro kilómetros 千米 公里",
    "FT": "ft ft. foot feet fuß fuss pie pies 英尺",
    "IN": "in in. inch inches zoll pulgada pulgadas 英寸",
    "L": "l l. ltr ltr. ltrs liter liters litre litres litro litros 升 公升",
    "ML": "ml ml. mls millilitre millilitres milliliter milliliters mililitro mililitros 毫升",
    "M3": "m3 m^3 cbm kubikmeter 立方米 立方",
    "GAL": "gal gal. gallon gallons gallone gallonen galón galones 加仑",
}
# Spellings of several words.
PHRASES = {"PCS": ["single piece", "single pieces"], "GAL": ["us gal", "us gallon", "us gallons"], "M3": ["cubic metre", "cubic metres", "cubic meter", "cubic meters"]}
# Words for numbers.
NUMBER_WORDS = {
    "half": "0.5", "½": "0.5", "¼": "0.25", "¾": "0.75", "a": "1", "one": "1", "two": "2", "hundred": "100", "thousand": "1000", "mille": "1000", "per mille": "1000",
    "hundert": "100", "tausend": "1000", "cien": "100", "mil": "1000", "半": "0.5", "十": "10", "百": "100", "千": "1000", "万": "10000",
}
# Words for containers, which are no units.
CONTAINERS = "bags bag sacks sack rolls roll reels reel drums drum cans can packs pack pallets pallet pal beutel sack rolle fass dose palette bolsa saco rollo bidón lata palé 桶 袋 卷 罐 包 托盘 托"

_NUM = r"\d+\s*/\s*\d+|\d[\d.,]*|[½¼¾半十百千万]|(?:half|one|two|hundred|thousand|mille|hundert|tausend|cien|mil)(?=\s)"
_CONT = "|".join(sorted(set(CONTAINERS.split()), key=len, reverse=True))
_UNIT = r"\p{L}[^/@()=;]*?"
#: Any spelling of a unit: a clause of a text has to name one, else the next clause is read.
_KNOWN = "|".join(re.escape(x) for x in sorted({x for words in ALIASES.values() for x in words.split()} | {x for phrases in PHRASES.values() for x in phrases}, key=lambda x: (-len(x), x)))
#: A field: an optional container, a number, a unit, an optional container. Groups: number, unit.
FIELD = rf"^(?:每?\s*(?:{_CONT})\s*(?:of\s|@|\(|=|:)?\s*)?(?:x|per\s|每)?\s*({_NUM})?\s*({_UNIT})\s*\)?\s*(?:(?:/|\sper\s)\s*(?:{_CONT}))?$"
_END = r"(?=\s*(?:$|;|,\s))"
#: The first clause of a text that states a content in a known unit, or such a unit, after a cue. Groups: number, unit.
CUED = (
    rf"(?:^|[;,]\s*)(?:contents?|pack size|inhalt|contenido|规格|含量|quantity stated in|quantity in|qty in|all figures(?: in(?=\s))?|supplier counts|uom|unit|"
    rf"mengenangabe|menge in|mengeneinheit|cantidad en|unidad|单位|数量以|按|每\s*(?:{_CONT})|\d+\s*(?:{_CONT})\s*=|each\s+(?:{_CONT})\s+(?:holds|contains))"
    rf"\s*[:=]?\s*({_NUM})?\s*({_KNOWN})(?:\s+here|计|下单)?{_END}"
)
#: The first clause of a text that states a content in a known unit by container. Groups: number, unit.
BY_CONTAINER = rf"(?:^|[;,]\s*)({_NUM})\s*({_KNOWN})\s*(?:per\s|/)\s*(?:{_CONT}){_END}"


def tidy(text: Column) -> Column:
    """Lower case, full-width signs as ASCII, white space as single blanks, without blanks at the ends."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "³　 ⁄"
    narrow = "".join(chr(c) for c in range(0x21, 0x7F)) + "3  /"
    plain = F.regexp_replace(F.translate(text, wide, narrow), r"(?U)\s+", " ")
    return F.regexp_replace(F.lower(F.trim(plain)), r"\bton \(metric\)", "tonne")


def alias_table(spark: SparkSession) -> DataFrame:
    """spelling and unit: a constant of a few hundred rows."""
    rows = {s: u for u, words in ALIASES.items() for s in words.split()} | {s: u for u, phrases in PHRASES.items() for s in phrases}
    return spark.createDataFrame(sorted(rows.items()), "spelling string, unit string")


def number(text: Column) -> Column:
    """The column ``_num``, given as ``text``: a number in digits (decimal point or comma, thousands separators, fraction a/b) or words; null if none."""
    value = lambda x: F.expr(f"try_cast({x} as decimal(18,6))")
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    part = "try_cast(trim(split_part(_num, '/', {})) as decimal(18,6))"
    return (
        F.when(text.rlike(r"^\d+\s*/\s*\d+$"), F.expr(f"try_divide({part.format(1)}, {part.format(2)})").cast("decimal(18,6)"))
        .when(text.rlike(r"^\d{1,3}(?:,\d{3})+(?:\.\d+)?$"), value("replace(_num, ',', '')"))
        .when(text.rlike(r"^\d{1,3}(?:\.\d{3}){2,}(?:,\d+)?$"), value("replace(replace(_num, '.', ''), ',', '.')"))
        .when(text.rlike(r"^\d+[.,]?\d*$"), value("trim(trailing '.' from replace(_num, ',', '.'))"))
        .otherwise(words[text].try_cast("decimal(18,6)"))
    )


def factors(conversions: DataFrame, *, from_unit: str, to_unit: str, factor: str, offset: str | None = None) -> DataFrame:
    """unit, base, up, up_offset, down and down_offset: q unit = ((q * up + up_offset) - down_offset) / down base.

    Both sides are led through a common unit; listed directly counts first, then the smallest
    name of the common unit. Factors and offsets are integers, in units of 1e-8.
    """
    scaled = lambda c: (c.cast("decimal(20,8)") * F.lit(100_000_000).cast("decimal(9,0)")).cast("decimal(20,0)")
    rows = conversions.select(
        F.upper(F.trim(F.col(from_unit))).alias("unit"), F.upper(F.trim(F.col(to_unit))).alias("common"), scaled(F.col(factor)).alias("f"),
        (scaled(F.col(offset)) if offset else F.lit(0).cast("decimal(20,0)")).alias("o"),
    ).dropna().where("f != 0")
    itself = rows.select(F.explode(F.array("unit", "common")).alias("unit")).distinct()
    one = F.lit(100_000_000).cast("decimal(20,0)")
    to_common = rows.unionByName(itself.select("unit", F.col("unit").alias("common"), one.alias("f"), F.lit(0).cast("decimal(20,0)").alias("o")))
    to_common = to_common.groupBy("unit", "common").agg(F.min(F.struct("f", "o")).alias("x")).select("unit", "common", "x.*")
    back = to_common.select(F.col("unit").alias("base"), "common", F.col("f").alias("down"), F.col("o").alias("down_offset"))
    best = F.min(F.struct((F.col("base") != F.col("common")).alias("indirect"), "common", F.col("f").alias("up"), F.col("o").alias("up_offset"), "down", "down_offset"))
    return to_common.join(back, "common").groupBy("unit", "base").agg(best.alias("x")).select("unit", "base", "x.up", "x.up_offset", "x.down", "x.down_offset")


def _stated(text: Column, patterns: list[str]) -> tuple[Column, Column]:
    """The number and the unit of the first pattern that a tidied text matches; '' if none does."""
    num, unit = F.lit(""), F.lit("")
    for pattern in reversed(patterns):
        hit = F.regexp_extract(text, pattern, 2)
        num, unit = F.when(hit != "", F.regexp_extract(text, pattern, 1)).otherwise(num), F.when(hit != "", F.trim(hit)).otherwise(unit)
    return num, unit


def to_base_units(
    lines: DataFrame,
    items: DataFrame,
    conversions: DataFrame,
    *,
    line_id: str,
    item_id: str,
    quantity: str,
    unit: str,
    note: str | None = None,
    default_unit: Column | None = None,
    item_key: str = "item_id",
    base_unit: str = "base_uom",
    from_unit: str = "from_uom",
    to_unit: str = "to_uom",
    factor: str = "factor",
    offset: str | None = None,
) -> DataFrame:
    """``line_id``, qty_e4 and base_qty_e4: the quantity as written and in the item's base unit, times 10,000.

    Number and unit are taken out of the unit field and out of the note by regular expressions,
    spellings become standard units by a join with a constant table; of a note, the first clause that
    names a known unit after a cue counts, else the first by container. The first known of field
    unit, note unit and ``default_unit`` holds; a stated size multiplies the quantity. Factor and
    offset lead through a common unit, in exact integers, rounded half up (away from zero).

    No row: lines whose id, item, quantity, base unit or unit is null or unknown, whose unit
    measures something else than the base unit, or whose result leaves 63 bits. Repeated lines
    and items (equal in every column) count once. Lines and items are joined by plain shuffles,
    which adaptive execution can split where an item is hot; only the spellings and, after a
    check of their number, the factors are broadcast. Other columns are ignored.
    """
    spark = lines.sparkSession
    names = F.broadcast(alias_table(spark))
    wanted = items.select(F.col(item_key).alias("_item"), tidy(F.col(base_unit)).alias("spelling")).dropna().join(names, "spelling").select("_item", F.col("unit").alias("base")).distinct()
    field = tidy(F.col(unit))
    f_num, f_unit = _stated(F.coalesce(field, F.lit("")), [FIELD])
    n_num, n_unit = _stated(F.coalesce(tidy(F.col(note)), F.lit("")), [CUED, BY_CONTAINER]) if note else (F.lit(""), F.lit(""))
    read = (
        lines.select(
            F.col(line_id).alias("_line"), F.col(item_id).alias("_item"), (F.col(quantity).cast("decimal(18,4)") * F.lit(10_000).cast("decimal(5,0)")).cast("decimal(18,0)").alias("qty_e4"),
            f_num.alias("f_num"), f_unit.alias("f_unit"), n_num.alias("n_num"), n_unit.alias("n_unit"), (default_unit if default_unit is not None else F.lit(None).cast("string")).alias("d_unit"),
        )
        .dropna(subset=["_line", "_item", "qty_e4"])
        .distinct()
    )
    known = (
        read.join(names.select(F.col("spelling").alias("f_unit"), F.col("unit").alias("_fu")), "f_unit", "left")
        .join(names.select(F.col("spelling").alias("n_unit"), F.col("unit").alias("_nu")), "n_unit", "left")
        .withColumn("unit", F.coalesce("_fu", "_nu", "d_unit"))
        .withColumn("_num", F.when(F.col("_fu").isNotNull(), F.col("f_num")).when(F.col("_nu").isNotNull(), F.col("n_num")).otherwise(F.lit("")))
        .where("unit is not null")
        .select("_line", "_item", "qty_e4", "unit", F.when(F.col("_num") == "", F.lit(1).cast("decimal(18,6)")).otherwise(number(F.col("_num"))).alias("size"))
        .where("size is not null")
    )
    ratio = small(factors(conversions, from_unit=from_unit, to_unit=to_unit, factor=factor, offset=offset))
    exact = known.join(wanted, "_item").join(ratio, ["unit", "base"])
    size_e6 = (F.col("size") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,0)")
    exact = exact.withColumn("_x", F.try_multiply(F.col("qty_e4") * size_e6, F.col("up")).cast("decimal(38,0)")).where("_x is not null")
    exact = exact.withColumn("_x", F.expr("_x + (up_offset - down_offset) * cast(10000000000 as decimal(11,0))").cast("decimal(38,0)"))
    exact = exact.withColumn("_d", F.expr("down * cast(1000000 as decimal(7,0))").cast("decimal(38,0)"))
    rounded = F.expr("case when abs(cast(_x as double) / cast(_d as double)) < 9e18 then ((abs(_x) * 2 + abs(_d)) div (2 * abs(_d))) * if((_x < 0) = (_d < 0), 1L, -1L) end")
    return exact.select(F.col("_line").alias(line_id), F.col("qty_e4").cast("long").alias("qty_e4"), rounded.cast("long").alias("base_qty_e4")).where("base_qty_e4 is not null")

