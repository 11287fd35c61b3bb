"""Translation of enterprise SQL: texts and results."""

import pytest

from tamarack.dialect import run, translate
from tamarack.operators.relational import BizError


def rows(spark, sql, **more):
    return sorted(map(tuple, run(spark, sql, **more).collect()), key=str)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 1, "c"), (4, 2, None)], "id int, up int, name string")


def test_dual_and_strings(spark):
    assert rows(spark, "SELECT 'it''s' || NULL || 'x' AS a, 1 ^= 2 AS b FROM DUAL") == [("it'sx", True)]


def test_null_order(spark, items):
    got = run(spark, "SELECT id FROM items ORDER BY name DESC, id FETCH FIRST 2 ROWS ONLY", items=items).collect()
    assert [r["id"] for r in got] == [4, 3]
    assert "NULLS LAST" in translate("SELECT a FROM t ORDER BY a") and translate("SELECT a FROM t ORDER BY a NULLS FIRST").count("NULLS") == 1


def test_hierarchy(spark, items):
    got = rows(spark, "SELECT id, LEVEL, SYS_CONNECT_BY_PATH(id, '/') AS path, CONNECT_BY_ISLEAF AS leaf FROM items WHERE id <> 3 START WITH up IS NULL CONNECT BY PRIOR id = up", items=items)
    assert got == [(1, 1, "/1", 0), (2, 2, "/1/2", 0), (4, 3, "/1/2/4", 1)]


def test_percent_and_offset(spark, items):
    assert rows(spark, "SELECT id FROM items ORDER BY id FETCH FIRST 30 PERCENT ROWS ONLY", items=items) == [(1,), (2,)]
    assert rows(spark, "SELECT id FROM items ORDER BY id OFFSET 1 ROWS FETCH NEXT 2 ROWS ONLY", items=items) == [(2,), (3,)]


def test_legacy_outer_join(spark, items):
    got = rows(spark, "SELECT a.id, b.name FROM items a, items b WHERE a.up = b.id (+) AND a.id > 1", items=items)
    assert got == [(2, "a"), (3, "a"), (4, "b")]


def test_all_over_nothing(spark, items):
    assert len(rows(spark, "SELECT id FROM items WHERE id > ALL (SELECT up FROM items WHERE up > 99)", items=items)) == 4


@pytest.mark.parametrize("sql", ["SELECT id FROM t WHERE ROWNUM <= 3 ORDER BY id", "SELECT MAX(x) KEEP (DENSE_RANK FIRST ORDER BY y) FROM t", "SELECT id FROM t CONNECT BY PRIOR a = b AND c = d"])
def test_what_has_no_translation_says_so(sql):
    with pytest.raises(NotImplementedError):
        translate(sql)


def test_clock_is_a_parameter():
    with pytest.raises(ValueError):
        translate("SELECT SYSDATE FROM DUAL")
    assert "date '2024-05-01'" in translate("SELECT SYSDATE FROM DUAL", as_of="2024-05-01")


def test_bound_parameters(spark, items):
    assert rows(spark, "SELECT id FROM items WHERE id >= :least", items=items, args={"least": 4}) == [(4,)]


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM t MODEL DIMENSION BY (a) MEASURES (b) RULES (b[1] = 2)",
        "MERGE INTO t USING s ON (t.a = s.a) WHEN MATCHED THEN UPDATE SET t.b = s.b",
        "INSERT ALL WHEN a > 1 THEN INTO x SELECT a FROM t",
        "INSERT FIRST WHEN a > 1 THEN INTO x SELECT a FROM t",
        "SELECT CURSOR(SELECT 1 FROM dual) FROM t",
        "SELECT CAST(MULTISET(SELECT a FROM s) AS tab) FROM t",
        "SELECT a MULTISET EXCEPT b FROM t",
        "SELECT seq.NEXTVAL FROM dual",
        "SELECT seq.CURRVAL FROM dual",
        "SELECT * FROM t, XMLTABLE('/a' PASSING t.x COLUMNS b PATH 'b') x",
        "SELECT * FROM t PIVOT XML (SUM(a) FOR b IN (ANY))",
        "SELECT * FROM t AS OF TIMESTAMP x",
        "SELECT * FROM t VERSIONS BETWEEN SCN 1 AND 2",
        "WITH r(a) AS (SELECT 1 FROM t) SEARCH DEPTH FIRST BY a SET o SELECT * FROM r",
        "WITH r(a) AS (SELECT 1 FROM t) CYCLE a SET c TO 'Y' DEFAULT 'N' SELECT * FROM r",
        "DELETE FROM t RETURNING a INTO b",
        "SELECT a BULK COLLECT INTO b FROM t",
        "SELECT a FROM t START WITH a = 1 CONNECT BY PRIOR a = b",
        "SELECT a FROM t CONNECT BY a = b",
        "SELECT a FROM t ORDER SIBLINGS BY a",
        "EXECUTE IMMEDIATE 'x'",
        "SELECT DBMS_RANDOM.VALUE FROM t",
        "SELECT a FROM t ORDER BY a FETCH FIRST 3 ROWS WITH TIES",
        "SELECT TO_NUMBER(a, '999') FROM t",
        "SELECT * FROM t, JSON_TABLE(t.j, '$[*]' COLUMNS (NESTED PATH '$.k[*]' COLUMNS (a NUMBER PATH '$.a'))) j",
        "SELECT * FROM t, JSON_TABLE(t.j, '$' ERROR ON ERROR COLUMNS (a NUMBER PATH '$.a')) j",
        "SELECT a FROM t WHERE x IS OF TYPE (y)",
        "WITH FUNCTION f(a NUMBER) RETURN NUMBER IS b NUMBER; BEGIN b := a; RETURN b; END; SELECT f(1) FROM dual",
    ],
)
def test_every_untranslated_construct_raises(sql):
    with pytest.raises(NotImplementedError):
        translate(sql)


def test_small_constructs(spark, items):
    one = lambda x: rows(spark, f"SELECT {x} AS a FROM DUAL")[0][0]
    assert one("TO_CHAR(5, 'FM000')") == "005" and one("TO_CHAR(0.5, 'FM990.00')") == "0.50" and one("NULL || NULL") is None
    assert one("DATE '2024-03-01' - DATE '2024-02-01'") == 29 and one("2 ** 3 MOD 5") == 3 and one("MOD(7, 0) || 'x'") == "7x"
    assert one("TO_NUMBER('q' DEFAULT 7 ON CONVERSION ERROR)") == 7 and one("TO_NUMBER(' 12 ')") == 12
    assert rows(spark, "SELECT LISTAGG(name, ',' ON OVERFLOW TRUNCATE '...' WITH COUNT) WITHIN GROUP (ORDER BY name) AS x FROM items", items=items) == [("a,b,c",)]
    assert rows(spark, "SELECT COUNT(*) AS n FROM items SAMPLE (100) SEED (3)", items=items) == [(4,)]


def test_hierarchies_by_the_operator(spark, items):
    loop = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id int, up int")
    got = rows(spark, "SELECT id, CONNECT_BY_ISLEAF AS leaf, CONNECT_BY_ISCYCLE AS cyc, PRIOR id AS above FROM g START WITH id = 1 CONNECT BY NOCYCLE PRIOR id = up", g=loop)
    assert got == [(1, 0, 0, None), (2, 0, 0, 1), (3, 1, 1, 2)]
    with pytest.raises(BizError):
        rows(spark, "SELECT id FROM g START WITH id = 1 CONNECT BY PRIOR id = up", g=loop)
    with pytest.raises(NotImplementedError):
        rows(spark, "SELECT id FROM g START WITH id = 1 CONNECT BY PRIOR id = up AND PRIOR up = id", g=loop)
    chain = spark.createDataFrame([(i, i - 1 or None) for i in range(1, 131)], "id int, up int")
    assert rows(spark, "SELECT MAX(n) AS n FROM (SELECT LEVEL AS n FROM c START WITH up IS NULL CONNECT BY PRIOR id = up)", c=chain) == [(130,)]
    got = run(spark, "SELECT id FROM items START WITH up IS NULL CONNECT BY PRIOR id = up AND id <> 4 ORDER SIBLINGS BY name", items=items).collect()
    assert [r["id"] for r in got] == [1, 2, 3]


def test_merge_text(spark):
    t = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, 30, None)], "k int, v int, w string")
    s = spark.createDataFrame([(1, 5), (3, 100), (9, 1)], "key int, n int")
    sql = "MERGE INTO t USING s x ON (t.k = x.key) WHEN MATCHED THEN UPDATE SET t.v = t.v + x.n, w = 'm' DELETE WHERE t.v > 100 WHEN NOT MATCHED THEN INSERT (k, v) VALUES (x.key, CASE WHEN x.n > 0 THEN 1 ELSE 2 END)"
    assert rows(spark, sql, t=t, s=s) == [(1, 15, "m"), (2, 20, "b"), (9, 1, None)]
    with pytest.raises(NotImplementedError):
        run(spark, "MERGE INTO t USING s x ON (t.k > x.key) WHEN MATCHED THEN UPDATE SET t.v = 1", t=t, s=s)


def test_is_conditions(spark):
    df = spark.createDataFrame([(1, '{"a": 1}', 1.0, [1, 2]), (2, "x", float("nan"), [1, 1]), (3, None, float("inf"), [])], "id int, j string, d double, a array<int>")
    ids = lambda cond: [x[0] for x in rows(spark, f"SELECT id FROM x WHERE {cond}", x=df)]
    assert ids("j IS JSON") == [1] and ids("j IS NOT JSON") == [2, 3] and ids("j IS NULL") == [3] and ids("j IS NOT NULL AND d IS NAN") == [2]
    assert ids("d IS INFINITE") == [3] and ids("a IS EMPTY") == [3] and ids("a IS NOT A SET") == [2]
