"""Column functions that follow enterprise-SQL semantics where Spark's differ.

All are compositions of built-in expressions, so they stay inside generated code. Unless said
otherwise a null argument gives null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _col(x: Column | str | int | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def ora_str(x: Column) -> Column:
    """The empty string as null."""
    return F.nullif(x, F.lit(""))


def nvl(x: Column, y: Column) -> Column:
    return F.coalesce(x, y)


def nvl2(x: Column, if_set: Column, if_null: Column) -> Column:
    return F.when(x.isNotNull(), if_set).otherwise(if_null)


def decode(x: Column, *pairs: Column) -> Column:
    """DECODE(x, search, result, ..., default): null equals null; null without default."""
    out = pairs[-1] if len(pairs) % 2 else F.lit(None)
    for search, result in reversed(list(zip(pairs[0 : len(pairs) // 2 * 2 : 2], pairs[1::2], strict=False))):
        out = F.when(x.eqNullSafe(search), result).otherwise(out)
    return out


def greatest_n(*xs: Column) -> Column:
    """GREATEST that is null if any argument is."""
    missing = xs[0].isNull()
    for x in xs[1:]:
        missing = missing | x.isNull()
    return F.when(~missing, F.greatest(*xs))


def least_n(*xs: Column) -> Column:
    """LEAST that is null if any argument is."""
    missing = xs[0].isNull()
    for x in xs[1:]:
        missing = missing | x.isNull()
    return F.when(~missing, F.least(*xs))


def concat_o(*xs: Column) -> Column:
    """The || operator: null counts as the empty string; an empty result is null."""
    return ora_str(F.concat_ws("", *xs))


def mod_o(x: Column, y: Column) -> Column:
    """MOD with the sign of x; MOD(x, 0) is x."""
    return F.when(y == 0, x).otherwise(F.try_mod(x, y))


def trunc_n(x: Column, digits: int = 0) -> Column:
    """TRUNC of a number towards zero."""
    scale = F.lit(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def round_n(x: Column, digits: int = 0) -> Column:
    """ROUND half away from zero."""
    return F.round(x, digits)


def substr_o(x: Column, start: int, length: int | None = None) -> Column:
    """SUBSTR: 0 counts as 1, negative positions from the end; null where nothing is left."""
    at = F.lit(start or 1)
    n = F.length(x) if length is None else F.lit(length)
    outside = (F.length(x) + start < 0) if start < 0 else F.lit(False)
    return F.when(~outside & (n >= 1), ora_str(F.substring(x, at, n)))


def instr_o(x: Column, part: str, start: int = 1, nth: int = 1) -> Column:
    """INSTR with start position and occurrence; 0 if there is none."""
    at = F.locate(part, x, start)
    for _ in range(nth - 1):
        at = F.when(at > 0, F.call_function("locate", F.lit(part), x, at + 1)).otherwise(F.lit(0))
    return at


_MASKS = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "MON": "MMM", "DD": "dd", "DDD": "D", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "FF3": "SSS", "FF6": "SSSSSS", "Q": "Q", "AM": "a", "PM": "a"}


def date_mask(mask: str) -> str:
    """A datetime mask as the pattern that Spark uses; quoted parts stay literal."""
    out = []
    for part in re.findall(r'"[^"]*"|' + "|".join(sorted(_MASKS, key=len, reverse=True)) + r"|[A-Za-z]+|[^A-Za-z\"]", mask, re.I):
        key = part.upper()
        if part.startswith('"'):
            out.append("'" + part[1:-1] + "'")
        elif key in _MASKS:
            out.append(_MASKS[key])
        elif part.isalpha():
            if key == "T":
                out.append("'T'")
            else:
                raise ValueError(f"unsupported datetime element {part} in {mask}")
        else:
            out.append(part)
    return "".join(out)


def to_char_date(x: Column, mask: str) -> Column:
    return F.date_format(x, date_mask(mask))


def to_char_number(x: Column, mask: str) -> Column:
    """TO_CHAR of a number for masks of 9, 0, comma and point, with or without FM, without sign elements.

    FM drops the blanks in front. With 9s behind the point FM also drops trailing zeros.
    """
    fill = not mask.upper().startswith("FM")
    body = mask[0 if fill else 2 :]
    whole, _, part = body.partition(".")
    if not re.fullmatch(r"[90,]+", whole) or not re.fullmatch(r"[90]*", part):
        raise ValueError(f"unsupported number mask {mask}")
    digits, least = len(whole.replace(",", "")), len(re.sub(r"[,9]", "", whole))
    shown = F.round(x.cast("decimal(38,12)"), len(part))
    grouped = F.format_number(F.abs(shown), len(part))
    if "," not in whole:
        grouped = F.regexp_replace(grouped, ",", "")
    if not least:
        grouped = F.regexp_replace(grouped, r"^0(?=\.)", "")
    elif "," not in whole:
        point = F.instr(grouped, ".")
        head = F.when(point > 0, F.substring(grouped, F.lit(1), point - 1)).otherwise(grouped)
        grouped = F.concat(F.lpad(head, F.greatest(F.length(head), F.lit(least)), F.lit("0")), F.when(point > 0, F.substring(grouped, point, F.length(grouped))).otherwise(F.lit("")))
    if not fill and part and set(part) == {"9"}:
        grouped = F.regexp_replace(grouped, r"0+$", "")
    signed = F.concat(F.when(shown < 0, F.lit("-")).otherwise(F.lit("")), grouped)
    out = F.lpad(signed, len(body) + 1, " ") if fill else signed
    return F.when(F.abs(shown) >= F.lit(10**digits).cast("decimal(38,0)"), F.lit("#" * (len(body) + 1))).otherwise(out)


def number_mask_sql(x: str, mask: str) -> str:
    """The text of ``to_char_number`` for an expression that is given as SQL."""
    fill = not mask.upper().startswith("FM")
    body = mask[0 if fill else 2 :]
    whole, _, part = body.partition(".")
    if not re.fullmatch(r"[90,]+", whole) or not re.fullmatch(r"[90]*", part):
        raise ValueError(f"unsupported number mask {mask}")
    digits, least = len(whole.replace(",", "")), len(re.sub(r"[,9]", "", whole))
    shown = f"round(cast({x} as decimal(38, 12)), {len(part)})"
    grouped = f"format_number(abs({shown}), {len(part)})"
    if "," not in whole:
        grouped = f"replace({grouped}, ',', '')"
    if not least:
        grouped = f"regexp_replace({grouped}, '^0(?=[.])', '')"
    elif "," not in whole:
        head = f"substring_index({grouped}, '.', 1)"
        grouped = f"concat(lpad({head}, greatest(length({head}), {least}), '0'), substring({grouped}, length({head}) + 1))"
    if not fill and part and set(part) == {"9"}:
        grouped = f"regexp_replace({grouped}, '0+$', '')"
    out = f"concat(if({shown} < 0, '-', ''), {grouped})"
    out = f"lpad({out}, {len(body) + 1}, ' ')" if fill else out
    return f"if(abs({shown}) >= cast('1{'0' * digits}' as decimal(38, 0)), '{'#' * (len(body) + 1)}', {out})"


def to_number(x: Column, default: Column | None = None, scale: int = 6) -> Column:
    """TO_NUMBER(x DEFAULT d ON CONVERSION ERROR): without default an invalid text is null."""
    out = F.trim(x).try_cast(f"decimal(38,{scale})")
    return out if default is None else F.when(x.isNotNull(), F.coalesce(out, default))


def to_date(x: Column, mask: str, default: Column | None = None) -> Column:
    """TO_DATE(x DEFAULT d ON CONVERSION ERROR, mask): without default an invalid text is null."""
    out = F.try_to_timestamp(x, F.lit(date_mask(mask))).cast("date")
    return out if default is None else F.when(x.isNotNull(), F.coalesce(out, default))


def validate_conversion(x: Column, kind: str) -> Column:
    """VALIDATE_CONVERSION: 1 if x is null or can be cast to the type, else 0."""
    return F.when(x.isNull() | x.try_cast(kind).isNotNull(), 1).otherwise(0)


def add_months(x: Column, n: Column | int) -> Column:
    """ADD_MONTHS: the last day of a month stays a last day."""
    moved = F.add_months(x, n)
    return F.when(x.cast("date") == F.last_day(x), F.last_day(moved)).otherwise(moved)


def months_between(later: Column, earlier: Column) -> Column:
    return F.months_between(later, earlier, False)


def effective_at(start: Column, end: Column, day: Column) -> Column:
    """start <= day and (end is null or end >= day)."""
    return (start <= day) & (end.isNull() | (end >= day))


def wildcard(rule: Column, value: Column) -> Column:
    """A rule column that is null matches every value."""
    return rule.isNull() | (rule == value)


def ratio_to_report(x: Column, *partition: Column | str) -> Column:
    """RATIO_TO_REPORT(x) OVER (PARTITION BY ...): null if the sum is 0."""
    total = F.sum(x).over(Window.partitionBy(*partition))
    return x / F.nullif(total, F.lit(0).cast("double"))


def asc(x: Column | str) -> Column:
    """Ascending as enterprise SQL sorts: nulls last."""
    return _col(x).asc_nulls_last()


def desc(x: Column | str) -> Column:
    """Descending as enterprise SQL sorts: nulls first."""
    return _col(x).desc_nulls_first()


def exact(x: Column, scale: int = 4) -> Column:
    """A double as a decimal, so that sums don't depend on their order."""
    return x.cast(f"decimal(18,{scale})")


def round_qty(quantity: Column, unit: Column, digits: Column) -> Column:
    """A quantity rounded to the digits of its unit (``digits``: a map by unit); four where the unit is unknown or null."""
    n = F.coalesce(F.try_element_at(digits, unit), F.lit(4))
    return F.round(quantity.cast("decimal(28,10)") * F.pow(F.lit(10), n).cast("decimal(10,0)"), 0) / F.pow(F.lit(10), n).cast("decimal(10,0)")


def format_qty(quantity: Column, unit: Column, digits: Column) -> Column:
    """A quantity with thousands separators, the digits of its unit (two where it is unknown) and the unit behind, if there is one."""
    n = F.coalesce(F.try_element_at(digits, unit), F.lit(2))
    shown = F.element_at(F.array(*[to_char_number(quantity, "FM999,999,999,990" + ("." + "0" * i if i else "")) for i in range(7)]), (F.least(n, F.lit(6)) + 1).cast("int"))
    return F.when(quantity.isNotNull(), F.concat_ws(" ", shown, unit))
