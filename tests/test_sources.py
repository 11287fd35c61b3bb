"""Sources: source-text facts, files, snapshots, URLs, streams."""

import pytest
from pyspark.sql import functions as F

from tamarack.operators.nested import json_table, xml_table
from tamarack.operators.relational import BizError
from tamarack.sources import files, plsql
from tamarack.streaming import events

SPEC = """SET DEFINE OFF
CREATE OR REPLACE /* note */ PACKAGE app.CORE IS
  c_max CONSTANT NUMBER := 20;
  TYPE t_row IS RECORD (id NUMBER);
  FUNCTION total(p_id IN NUMBER, p_day IN DATE DEFAULT SYSDATE, x OUT NOCOPY VARCHAR2) RETURN t_item%ROWTYPE;
  PROCEDURE run;
END CORE;
/
"""
BODY = """CREATE OR REPLACE PACKAGE BODY app.CORE AS
  g_n NUMBER := 0;
  FUNCTION total(p_id IN NUMBER, p_day IN DATE DEFAULT SYSDATE, x OUT NOCOPY VARCHAR2) RETURN t_item%ROWTYPE IS
    v NUMBER;
    PROCEDURE inner_one IS BEGIN helper(1); END;
  BEGIN
    -- helper_not_called();
    IF p_id > 1 THEN v := UTIL.fmt('x; END'); ELSE v := CORE.c_max; END IF;
    FOR r IN (SELECT CASE WHEN 1 = 1 THEN 2 END q FROM dual) LOOP total(v); END LOOP;
    RETURN util.c_limit;
  END total;
  PROCEDURE helper(a NUMBER) IS BEGIN NULL; END helper;
  PROCEDURE run IS BEGIN helper(1); END;
END CORE;
/
CREATE OR REPLACE FUNCTION solo RETURN NUMBER IS BEGIN core.run; RETURN 1; END;
/
"""
UTIL = """CREATE PACKAGE UTIL IS c_limit CONSTANT NUMBER := 1; FUNCTION fmt(a VARCHAR2) RETURN NUMBER; END;
/
CREATE TABLE app.t_a (id NUMBER(18) NOT NULL, /* gone NUMBER, */ "EXIT" VARCHAR2(10) DEFAULT 'x', amount NUMBER(10,2), CONSTRAINT pk PRIMARY KEY (id, amount));
CREATE SEQUENCE seq_a START WITH 1;
CREATE VIEW v_a AS SELECT * FROM t_a a JOIN app.t_b b ON a.id = b.id;
CREATE TRIGGER trg BEFORE INSERT OR UPDATE ON t_a FOR EACH ROW WHEN (NEW.id > 0)
BEGIN IF :NEW.id > 1 THEN NULL; END IF; END;
/
"""


@pytest.fixture(scope="module")
def found(spark):
    rows = [(1, SPEC), (2, BODY), (3, UTIL), (4, None), (5, ""), (6, "nothing; here 'open")]
    return plsql.facts(spark.createDataFrame(rows, "file_id long, source string"), file_id="file_id", text="source").cache()


def test_packages_are_paired(found):
    got = {r["package"]: (r["spec_file"], r["body_file"]) for r in plsql.packages(found).collect()}
    assert got == {"CORE": (1, 2), "UTIL": (3, None)}


def test_routines_and_lines(found):
    got = {(r["package"], r["name"], r["mode"]): (r["type"], r["detail"], r["line_start"], r["line_end"]) for r in found.where("fact = 'routine'").collect()}
    assert got[("CORE", "TOTAL", "BODY")] == ("FUNCTION", "t_item%ROWTYPE", 3, 11)
    assert got[("CORE", "TOTAL", "SPEC")][2:] == (5, 5)
    assert got[("CORE", "HELPER", "BODY")][2:] == (12, 12) and ("CORE", "INNER_ONE", "BODY") not in got
    assert got[("__STANDALONE_SOLO__", "SOLO", "BODY")][0] == "FUNCTION"


def test_parameters(found):
    got = [(r["name"], r["mode"], r["type"], r["detail"]) for r in found.where("fact = 'parameter' and file_id = 1").orderBy("pos").collect()]
    assert got == [("P_ID", "IN", "NUMBER", None), ("P_DAY", "IN", "DATE", "SYSDATE"), ("X", "OUT", "VARCHAR2", None)]


def test_calls_and_references(found):
    calls = {(r["package"], r["unit"].split("@")[0], r["callee_package"], r["callee"]) for r in plsql.calls(found).collect()}
    assert calls == {("CORE", "TOTAL", "UTIL", "FMT"), ("CORE", "TOTAL", "CORE", "HELPER"), ("CORE", "RUN", "CORE", "HELPER"), ("__STANDALONE_SOLO__", "SOLO", "CORE", "RUN")}
    refs = {(r["package"], r["ref_package"], r["name"]) for r in plsql.package_refs(found).collect()}
    assert refs == {("CORE", "UTIL", "C_LIMIT")}


def test_tables_views_triggers(found):
    columns = [(r["name"], r["type"], r["mode"], r["detail"]) for r in found.where("fact = 'column'").orderBy("pos").collect()]
    assert columns == [("ID", "NUMBER(18)", "NOT NULL", None), ("EXIT", "VARCHAR2(10)", "NULL", "'x'"), ("AMOUNT", "NUMBER(10,2)", "NULL", None)]
    assert {r["name"] for r in found.where("fact = 'key'").collect()} == {"ID", "AMOUNT"}
    assert {r["name"] for r in found.where("fact = 'view_source'").collect()} == {"T_A", "APP.T_B"}
    t = found.where("fact = 'trigger'").first()
    assert (t["unit"], t["type"], t["mode"], t["detail"]) == ("T_A", "BEFORE", "ROW", "INSERT,UPDATE|NEW.id > 0")
    assert found.where("fact = 'constant'").count() == 2 and found.where("fact = 'sequence'").count() == 1


def test_entry_points():
    assert plsql.parse_entry("sub/dir/core.run__2") == {"folder": "sub/dir", "package": "CORE", "name": "run", "overload": "2"}
    with pytest.raises(ValueError):
        plsql.parse_entry("run")


def test_slices(spark):
    texts = spark.createDataFrame([(1, "a\nb\nc"), (2, None)], "f long, s string")
    ranges = spark.createDataFrame([(1, 2, 3), (1, 3, 9), (2, 1, 1)], "f long, a int, b int")
    got = plsql.slices(texts, ranges, file_id="f", text="s", first="a", last="b").collect()
    assert sorted(str(r["source"]) for r in got) == ["None", "None", "b\nc"]


def test_urls():
    assert files.parse_jdbc_url("jdbc:postgresql://h/db?sslmode=require") == {"kind": "postgresql", "host": "h", "port": 5432, "database": "db", "sslmode": "require"}
    assert files.parse_jdbc_url("jdbc:gaussdb://h:8000/db")["port"] == 8000
    with pytest.raises(ValueError):
        files.parse_jdbc_url("postgresql://h/db")


def test_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1|a\n2|b\n")
    assert files.external_table(spark, str(tmp_path / "x.csv"), "id int, name string", delimiter="|").count() == 2
    ledger = spark.createDataFrame([(1, "2024-01-05"), (2, "2024-05-05")], "id int, d string").withColumn("d", F.to_date("d"))
    files.write_partitioned(ledger, str(tmp_path / "ledger"), "d")
    part = files.read_partition(spark, str(tmp_path / "ledger"), "2024Q2")
    assert [r["id"] for r in part.collect()] == [2] and "PartitionFilters: [isnotnull(_quarter" in part._jdf.queryExecution().toString()
    for v in (1, 3):
        files.write_snapshot(spark.range(v), str(tmp_path / "snap"), v)
    assert files.as_of(spark, str(tmp_path / "snap"), 2).count() == 1 and files.versions_between(spark, str(tmp_path / "snap"), 1, 3).count() == 4
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.pkb").write_text("CREATE PACKAGE a IS END;")
    (tmp_path / "src" / "b.txt").write_text("no")
    assert files.source_tree(spark, str(tmp_path / "src")).count() == 1
    assert files.refresh(spark.range(3), str(tmp_path / "view")).count() == 3


def test_json_and_xml(spark):
    df = spark.createDataFrame([(1, '[{"a": 1}, {"a": 2}]'), (2, "broken"), (3, None), (4, "[]")], "id int, j string")
    assert [tuple(r) for r in json_table(df, "j", "a int", path="$[*]", ordinality="n").collect()] == [(1, 1, 1), (1, 2, 2)]
    xml = spark.createDataFrame([(1, "<r><i><a>1</a></i><i><a>x</a></i></r>"), (2, None)], "id int, x string")
    assert [tuple(r) for r in xml_table(xml, "x", "/r/i", {"a": ("int", "a")}).collect()] == [(1, 1), (1, None)]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:01", 1.0), (1, "2024-01-01 00:00:02", 2.0), (2, "2024-01-01 05:00:00", 4.0)], "k int, t string, v double").withColumn("t", F.to_timestamp("t"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"), rows.schema)
    got = []
    events.net_by_batch(stream, ["k"], "v", lambda df, n: got.extend(map(tuple, df.collect())), str(tmp_path / "state")).awaitTermination()
    assert sorted((k, float(net), n) for k, net, n in got) == [(1, 3.0, 2), (2, 4.0, 1)]
    events.run_to_table(events.tumbling(stream, ts="t", keys=["k"], value="v", width="1 hour", late="1 minute"), str(tmp_path / "out"), str(tmp_path / "state2"))
    assert [(r["k"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 2)]
    assert events.sessions(rows, ts="t", keys=["k"], gap="10 minutes").count() == 2


def test_xml_rows_keep_their_own_children(spark):
    rows = [(1, '<r><i k="7"><a>1</a><b><c>x</c></b></i><i></i><i><a>3</a><a>4</a></i></r>'), (2, None), (3, "<r"), (4, "<r></r>")]
    got = xml_table(spark.createDataFrame(rows, "id int, x string"), "x", "/r/i", {"a": ("int", "a"), "k": ("int", "@k"), "c": ("string", "b/c")}, ordinality="n")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, 7, "x"), (1, 2, None, None, None), (1, 3, 3, None, None)]
    deep = spark.createDataFrame([("<r><g><i>5</i><i>6</i></g><g><i>7</i></g></r>",)], "x string")
    assert [tuple(r) for r in xml_table(deep, "x", "/r/g/i", {"v": ("int", ".")}, ordinality="n").collect()] == [(1, 5), (2, 6), (3, 7)]


def test_json_nested_paths_and_errors(spark):
    rows = [(1, '{"items":[{"id":1,"kids":[{"n":"a"},{"n":"b"}]},{"kids":null}]}'), (2, '{"items":['), (3, None), (4, "{}"), (5, '{"items":[{"id":"x"},{"id":9}]}')]
    df = spark.createDataFrame(rows, "k int, j string")
    more = {"path": "$.items[*]", "ordinality": "pos", "nested": ("$.kids[*]", "n string"), "nested_ordinality": "kid", "defaults": {"id": 0}}
    assert sorted(map(tuple, json_table(df, "j", "id int", **more).collect()), key=str) == [(1, 1, 1, 1, "a"), (1, 1, 1, 2, "b"), (1, 2, 0, None, None), (5, 1, 0, None, None), (5, 2, 9, None, None)]
    with pytest.raises(Exception, match="broken JSON"):
        json_table(df, "j", "id int", path="$.items[*]", on_error="error").collect()


def test_dependencies_and_entries(spark, found):
    assert {tuple(r) for r in plsql.package_dependencies(found).collect()} == {("CORE", "UTIL", "both"), ("__STANDALONE_SOLO__", "CORE", "call")}
    assert plsql.resolve_entry(found, "x/core.total") == ("CORE", "TOTAL", 1)
    with pytest.raises(BizError, match="NO_ENTRY"):
        plsql.resolve_entry(found, "core.nothing")
    twice = "CREATE PACKAGE BODY p IS PROCEDURE a IS BEGIN NULL; END;\n PROCEDURE a(x NUMBER) IS BEGIN NULL; END; END;"
    again = plsql.facts(spark.createDataFrame([(1, twice)], "f long, s string"), file_id="f", text="s")
    with pytest.raises(BizError, match="AMBIGUOUS_ENTRY"):
        plsql.resolve_entry(again, "p.a")
    assert plsql.resolve_entry(again, "p.a__2") == ("P", "A", 2)
