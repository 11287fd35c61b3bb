"""Routines and their comments, and the defined cases."""

import pytest
from pyspark.sql import functions as F

from tamarack.llm.functions import description, documented_functions, routines, says_something
from tamarack.sources import plsql

SOURCE = """-- Banner of the file.
CREATE OR REPLACE PACKAGE app.P IS
  -- Declared only, with a comment.
  FUNCTION one RETURN NUMBER;
END P;
/
CREATE OR REPLACE /*EDITIONABLE*/ PACKAGE BODY app.P AS
  /* old:
  FUNCTION gone RETURN NUMBER IS BEGIN RETURN 0; END;
  */
  g CHAR(1) := 'N'; -- trailing words

  /****************
  创建作者：dev
  创建日期：2024-01-01
  功能描述：Adds the
            totals per site.
  版    本：1.2
  ****************/

  FUNCTION one(a VARCHAR2 DEFAULT 'A;B', b NUMBER DEFAULT CAST('1' AS NUMBER)) RETURN NUMBER IS
    v VARCHAR2(99) := q'[it's; END; FUNCTION no IS]';
    -- Local helper that rounds.
    PROCEDURE local_one AS BEGIN NULL; END local_one;
  BEGIN
    IF 1 = 1 THEN v := CASE WHEN 1 = 1 THEN 'x' END; END IF;
    DECLARE w NUMBER; BEGIN LOOP EXIT; END LOOP; END;
    RETURN 1;
  END one; -- done
  -- one_more function
  procedure
    ONE_MORE is begin null; end;
  /** TODO: describe */
  PROCEDURE two IS BEGIN NULL; END;
  -- ---------
  -- 【功能描述】汇总批号
  -- ---------
  PROCEDURE "Three" IS BEGIN NULL; END;
BEGIN
  g := 'Y';
END P;
/
-- Author : x
-- Stands above CREATE.
CREATE OR REPLACE FUNCTION app.solo
RETURN NUMBER IS BEGIN RETURN 1; END;
/
"""


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "file_id long, source_text string, line_start int, routine_name string")
    return documented_functions(df, file_id="file_id", text="source_text", code=True)


def test_documented_routines(spark):
    got = {r["routine_name"]: r for r in run(spark, [(1, SOURCE)]).collect()}
    line = lambda part: next(i for i, x in enumerate(SOURCE.split("\n"), 1) if part in x)
    assert {n: (r["line_start"], r["line_end"]) for n, r in got.items()} == {
        "one": (line("FUNCTION one(a"), line("END one;")), "local_one": (line("PROCEDURE local_one"),) * 2, "three": (line('"Three"'),) * 2, "solo": (line("FUNCTION app.solo"), line("RETURN NUMBER IS BEGIN RETURN 1; END;")),
    }
    assert got["one"]["description"] == "Adds the totals per site." and got["three"]["description"] == "汇总批号" and got["solo"]["description"] == "Stands above CREATE."
    assert got["one"]["code"].startswith("  FUNCTION one(a") and got["one"]["code"].endswith("END one; -- done")


def test_all_routines_with_a_body(spark):
    df = spark.createDataFrame([(1, SOURCE)], "file_id long, source_text string")
    got = routines(df, file_id="file_id", text="source_text")
    assert sorted(r["routine_name"] for r in got.collect()) == ["local_one", "one", "one_more", "solo", "three", "two"]
    core = plsql.facts(df, file_id="file_id", text="source_text").where("fact = 'routine' and mode = 'BODY'").select(F.lower("name").alias("n"), "line_start", "line_end")
    mine = {(r["routine_name"], r["line_start"], r["line_end"]) for r in got.collect()}
    assert {tuple(r) for r in core.collect()} <= mine


@pytest.mark.parametrize(
    ("comment", "name", "want"),
    [
        ("-- TODO", "f", False), ("/* n/a */", "f", False), ("-- 待补充", "f", False), ("--", "f", False), ("/** ... */", "f", False), ("-- calc_x函数", "calc_x", False), ("-- Calc X", "calc_x", False), ("-- procedure calc_x()", "calc_x", False),
        ("-- Author : me\n-- Purpose : description", "f", False), ("-- 功能描述：", "f", False), ("-- calc_x: adds up", "calc_x", True), ("-- Adds up (TODO: index)", "f", True), ("-- @param a what\n-- @author b", "f", False), ("-- see above", "f", False),
        ("-- Purpose : Adds\n--           up.", "f", True), ("-- 参数：a", "f", False), ("-- Modified by x: fix", "f", False), ("-- in: stock per site", "f", False), ("-- oldest first", "f", True), (None, "f", False),
    ],
)
def test_what_a_comment_says(spark, comment, name, want):
    df = spark.createDataFrame([(comment, name)], "c string, n string")
    assert df.select(says_something(description(F.col("c")), F.col("n"))).first()[0] is want


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (None, SOURCE), (3, "FUNCTION f IS"), (4, "-- says much\r\n\r\nPROCEDURE p IS\r\nBEGIN\r\n  NULL;\r\nEND;\r\n"), (5, "/* never ends"), (6, "x := 'never ends")]
    got = {(r["file_id"], r["routine_name"], r["line_start"], r["line_end"]) for r in run(spark, rows).collect()}
    assert got == {(4, "p", 3, 6)}
    assert run(spark, []).count() == 0
    long = "-- adds up\nPROCEDURE p IS\nBEGIN\n" + "  v := v + 1; -- step\n" * 20_000 + "END;\n" + "/* " + "x" * 200_000 + " */\n"
    assert [(r["line_start"], r["line_end"]) for r in run(spark, [(1, long)]).collect()] == [(2, 20_004)]
    assert run(spark, [(1, SOURCE), (1, SOURCE)]).count() == 4
