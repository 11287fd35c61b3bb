"""Context, parameters, errors, counts and checked writes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tamarack import context as c
from tamarack.operators.relational import BizError


def test_typed_parameters():
    ctx = c.EngineContext(dt.date(2026, 5, 27), params={"a": "0.8", "d": "2024-02-30", "e": "2024-02-29"}, numbers={"NO_BOM": -20301}, flags={"debug": True})
    assert (ctx.number("a"), ctx.number("x", 3), ctx.number("d"), ctx.day("d"), ctx.day("e"), ctx.text("x", "y")) == (0.8, 3, None, None, dt.date(2024, 2, 29), "y")
    assert ctx.error_number(BizError("NO_BOM", "x")) == -20301 and ctx.error_number(BizError("?", "x")) == -20999
    assert ctx.on("debug", lambda: 1, lambda: 2) == 1 and ctx.on("other", lambda: 1, lambda: 2) == 2


def test_log_cuts_long_messages(spark):
    ctx = c.EngineContext(dt.date(2026, 5, 27))
    rows = c.log_rows(spark, ctx, [(BizError("X", "m" * 5000), "mod", "proc", None)], dt.datetime(2026, 5, 27)).collect()
    assert len(rows[0]["error_msg"]) == 2000 and rows[0]["biz_key"] is None
    assert c.log_rows(spark, ctx, [], dt.datetime(2026, 5, 27)).count() == 0


def test_row_count(spark):
    df, seen = c.counted(spark.range(7), "n1")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 7


def test_check_option_and_view_writer(spark):
    assert c.checked(spark.range(3), F.col("id") < 3, "v").count() == 3
    with pytest.raises(Exception, match="breaks the check of v"):
        c.checked(spark.range(4), F.col("id") < 3, "v").collect()
    assert c.view_writer({"id": "item_id"})(spark.range(1)).columns == ["item_id"]


def test_overloads():
    assert c.to_text(dt.date(2024, 1, 2)) == "2024-01-02" and c.to_text(1234.5) == "1,234.50" and c.to_text("x") == "x"
