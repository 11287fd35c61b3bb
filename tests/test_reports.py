"""Reports of checkers, coverage tools and builds; gates."""

from tamarack.operators.nested import xml_table
from tamarack.sources import reports


def test_checkers(spark):
    check = """<?xml version="1.0"?><checkstyle version="9.3"><file name="a/Foo.java"><error line="12" column="5" severity="error" message="m" source="com.x.checks.naming.MethodNameCheck"/>
      <error line="30" severity="warning" message="long" source="com.x.sizes.LineLengthCheck"/></file><file name="b"></file></checkstyle>"""
    got = reports.checkstyle(spark.createDataFrame([(1, check), (2, None), (3, "<checkstyle>")], "id int, xml string"), "xml").select("id", "file", "line", "severity", "rule", "category").collect()
    assert sorted(map(tuple, got)) == [(1, "a/Foo.java", 12, "major", "MethodName", "naming-convention"), (1, "a/Foo.java", 30, "minor", "LineLength", "code-format")]
    pmd = '<pmd version="6"><file name="F"><violation beginline="20" rule="EmptyCatchBlock" priority="2">Avoid</violation><violation beginline="55" rule="Unused" priority="4"> u </violation></file></pmd>'
    got = reports.pmd(spark.createDataFrame([(pmd,)], "xml string"), "xml").select("line", "severity", "category", "message").collect()
    assert [tuple(r) for r in got] == [(20, "major", "collection-exception", "Avoid"), (55, "info", "code-format", "u")]
    cpd = '<pmd-cpd><duplication lines="10" tokens="80"><file line="5" path="/a"/><file line="7" path="/b"/><codefragment>...</codefragment></duplication></pmd-cpd>'
    assert [tuple(r) for r in reports.cpd(spark.createDataFrame([(cpd,)], "xml string"), "xml").collect()] == [(10, 80, "/a", 5), (10, 80, "/b", 7)]


def test_coverage(spark):
    xml = '<report name="r"><package name="p"><sourcefile name="A"><line nr="20" mi="2" ci="0" mb="0" cb="0"/><line nr="21" mi="0" ci="3" mb="1" cb="1"/></sourcefile><sourcefile name="B"/></package></report>'
    got = reports.coverage(reports.jacoco(spark.createDataFrame([("x", xml)], "k string, xml string"), "xml"), "k").collect()
    assert [tuple(r) for r in got] == [("x", 0.5, 0.5)]


def test_logs(spark):
    log = "[INFO] Tests run: 4, Failures: 1, Errors: 0, Skipped: 1\n[INFO] Tests run: 2, Failures: 0, Errors: 1, Skipped: 0\nResults:\nTests run: 6, Failures: 1, Errors: 1, Skipped: 1\nBUILD SUCCESS"
    got = {r["id"]: (r["compiled"], r["tests"], r["passed"]) for r in reports.build_logs(spark.createDataFrame([(1, log), (2, None), (3, "BUILD FAILURE")], "id int, log string"), "log").collect()}
    assert got == {1: (True, 6, 3), 2: (False, 0, 0), 3: (False, 0, 0)}


def test_gates_pass_what_has_nothing_to_judge(spark):
    rows = [("a", 4, 5, 3, 69.0, True, 1, False, 6, 10), ("b", 0, 0, 0, None, None, None, None, 0, 0)]
    df = spark.createDataFrame(rows, "u string, completed int, total int, methods int, score double, all_passed boolean, must_fix int, compiled boolean, passed_tests int, total_tests int")
    got = {(r["u"], r["gate"]): r["passed"] for r in reports.gates(df, "u").collect()}
    assert [got["a", f"G{i}"] for i in range(1, 7)] == [True, False, False, False, False, False] and all(got["b", f"G{i}"] for i in range(1, 7))
    assert reports.gates(df.limit(0), "u").count() == 0


def test_rows_under_several_parents(spark):
    xml = '<r><g k="1"><i>5</i><i>6</i></g><g k="2"/><g><i>7</i></g></r>'
    got = xml_table(spark.createDataFrame([(xml,)], "x string"), "x", "/r/g/i", {"k": ("int", "../@k"), "v": ("int", ".")}).collect()
    assert [tuple(r) for r in got] == [(1, 5), (1, 6), (None, 7)]
    flat = xml_table(spark.createDataFrame([('<r k="9"><i>5</i></r>',)], "x string"), "x", "/r/i", {"k": ("int", "../@k"), "v": ("int", ".")}).collect()
    assert [tuple(r) for r in flat] == [(9, 5)]
