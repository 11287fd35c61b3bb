"""Relational operators and column functions: defined cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tamarack.functions import ora as o
from tamarack.operators import relational as r
from tamarack.operators.changes import returning, row_changes
from tamarack.operators.model import Rule, iterate, model, moving_average, trend
from tamarack.session import checkpoint_dir, cut


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_null_rules(spark):
    null = F.lit(None).cast("int")
    assert one(spark, o.greatest_n(F.lit(1), null), o.least_n(F.lit(1), F.lit(2)), o.decode(null, null, F.lit("n"), F.lit("x")), o.mod_o(F.lit(7), F.lit(0)), o.concat_o(F.lit("a"), F.lit(None).cast("string"))) == (None, 1, "n", 7, "a")
    assert one(spark, o.concat_o(F.lit(""), F.lit(None).cast("string")), o.ora_str(F.lit(""))) == (None, None)


def test_strings(spark):
    x = F.lit("abcabc")
    assert one(spark, o.substr_o(x, 0, 2), o.substr_o(x, -2), o.substr_o(x, -9), o.instr_o(x, "b", 1, 2), o.instr_o(x, "b", 1, 3)) == ("ab", "bc", None, 5, 0)


@pytest.mark.parametrize(("value", "mask", "want"), [(1234.5, "FM999,990.00", "1,234.50"), (0.5, "FM990.00", "0.50"), (0.5, "FM999.99", ".5"), (-7, "FM00000", "-00007"), (12, "999", "  12"), (12345, "FM999", "####"), (2.5, "FM990", "3")])
def test_number_masks(spark, value, mask, want):
    assert one(spark, o.to_char_number(F.lit(value), mask)) == (want,)


def test_dates(spark):
    d = lambda s: F.lit(s).cast("date")
    got = one(spark, o.add_months(d("2024-01-31"), 1), o.add_months(d("2024-02-29"), 1), o.add_months(d("2024-01-30"), 1), o.to_char_date(d("2024-03-05"), 'DD"."MM"."YYYY'), o.to_date(F.lit("x"), "YYYY-MM-DD"))
    assert got == (dt.date(2024, 2, 29), dt.date(2024, 3, 31), dt.date(2024, 2, 29), "05.03.2024", None)
    with pytest.raises(ValueError):
        o.date_mask("YYYY-FOO")


def test_merge(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (None, 30)], "k int, v int")
    s = spark.createDataFrame([(1, 1), (3, 3), (None, 9)], "k int, v int")
    got = r.merge_into(t, s, ["k"], update={"v": F.col("t.v") + F.col("s.v")})
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, 11), (2, 20), (None, 30), (3, 3), (None, 9)]))
    with pytest.raises(r.BizError):
        r.merge_into(t, s.union(s), ["k"])
    assert r.merge_into(t.limit(0), s.limit(0), ["k"]).count() == 0


def test_exactly_one(spark):
    assert r.exactly_one(spark.range(1))["id"] == 0
    for n in (0, 2):
        with pytest.raises(r.BizError):
            r.exactly_one(spark.range(n))


def test_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "x int")
    assert sorted(v[0] for v in r.with_ties(df, ["x"], 2).collect()) == [1, 2, 2]
    assert [v[0] for v in r.with_ties(df, ["x"], 1, descending=True).collect()] == [None]
    assert r.with_ties(df.limit(0), ["x"], 3).count() == 0


def test_sequence_has_no_gaps(spark):
    df = spark.range(1000).withColumn("k", F.hash("id"))
    got = r.next_values(df, "n", 10, "k", "id").orderBy("k", "id").select("n").collect()
    assert [x[0] for x in got] == list(range(10, 1010))
    assert r.next_values(df.limit(0), "n", 1, "id").count() == 0


def test_quantified_over_empty_and_null(spark):
    df, none, null = spark.range(3), spark.range(0).select("id"), spark.createDataFrame([(None,), (0,)], "x long")
    run = lambda op, kind, sub: [x[0] for x in r.quantified(df, F.col("id"), op, kind, sub).orderBy("id").collect()]
    assert run(">", "ALL", none) == [0, 1, 2] and run(">", "ANY", none) == [] and run(">", "ALL", null) == [] and run(">", "ANY", null) == [1, 2]
    assert run("<>", "ALL", null) == [] and run("=", "ANY", null) == [0] and run("<>", "ALL", none) == [0, 1, 2]


def test_keep_counts_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 1, 7), (1, None, 9), (None, 3, 1)], "k int, y int, x int")
    first = r.keep(df, ["k"], F.col("y"), {"s": F.sum("x")})
    last = r.keep(df, ["k"], F.col("y"), {"s": F.sum("x")}, last=True)
    assert {a["k"]: a["s"] for a in first.collect()} == {1: 12, None: 1} and {a["k"]: a["s"] for a in last.collect()} == {1: 9, None: 1}


def test_rejects_and_pivot(spark):
    good, bad = r.split_rejects(spark.createDataFrame([(1,), (-1,), (None,)], "x int"), {"sign": F.col("x") > 0})
    assert good.count() == 1 and bad.count() == 2
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (2, None, 4)], "k int, c string, v int")
    wide = r.dynamic_pivot(df, ["k"], "c", F.sum("v"), prefix="M_")
    assert wide.columns == ["k", "M_a", "M_b"]
    assert r.dynamic_pivot(df.limit(0), ["k"], "c", F.sum("v"), prefix="M_").columns == ["k", "M_NONE"]
    with pytest.raises(r.BizError):
        r.dynamic_pivot(df, ["k"], "c", F.sum("v"), most=1)


def test_submultiset(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, r.is_submultiset(a(1, 1), a(1, 2, 1)), r.is_submultiset(a(1, 1), a(1, 2)), r.is_submultiset(F.array().cast("array<int>"), a(1))) == (True, False, True)


def test_model_feeds_on_its_cells(spark):
    cells = spark.createDataFrame([("p", 8, 200.0), ("p", 9, 210.0), ("p", 10, 215.0), ("q", 10, None)], "p string, n int, q double")
    got = iterate(cells, ["p"], "n", "q", anchor=10, window=3, ahead=3, rule=moving_average(3)).orderBy("p", "n").collect()
    assert [(x["n"], x["q"]) for x in got if x["p"] == "p"] == [(11, 208.3333), (12, 211.1111), (13, 211.4815)] and [x["q"] for x in got if x["p"] == "q"] == [0.0] * 3
    up = iterate(cells, ["p"], "n", "q", anchor=10, window=4, ahead=1, rule=trend(3)).where("p = 'p'").first()
    assert up["q"] == round(215 + (215 - 0) / 3, 4)


def test_changes_to_null_are_none(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string"), spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "k int, v string")
    assert [tuple(x) for x in row_changes(old, new, ["k"], ["v"]).collect()] == [(1, "v", "a", "x")]


def test_cut_keeps_rows_and_settings(spark):
    before = spark.conf.get("spark.sql.constraintPropagation.enabled")
    df = cut(spark.range(5))
    assert df.count() == 5 and spark.conf.get("spark.sql.constraintPropagation.enabled") == before
    assert checkpoint_dir(spark) == checkpoint_dir(spark)


def test_ranks_over_a_whole_table(spark):
    df = spark.createDataFrame([(i, None if i % 11 == 0 else i % 7, i) for i in range(300)], "id int, v int, x long")
    got = r.ranked(df, "v", ["x"])
    df.createOrReplaceTempView("ranked_test")
    want = spark.sql("SELECT id, rank() OVER (ORDER BY v DESC NULLS FIRST) AS rank, dense_rank() OVER (ORDER BY v DESC NULLS FIRST) AS dense_rank, sum(x) OVER (ORDER BY v DESC NULLS FIRST) AS cum_x FROM ranked_test")
    assert sorted(map(tuple, got.select("id", "rank", "dense_rank", "cum_x").collect())) == sorted(map(tuple, want.collect()))
    assert r.ranked(df.limit(0), "v", ["x"]).count() == 0


@pytest.fixture
def many_tasks(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_running_sums_of_hot_keys(spark, many_tasks, hot):
    df = spark.range(3000).select(F.when(F.rand(5) < hot, F.lit(7)).when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.col("id") % 9).alias("k"), F.hash("id").alias("o"), "id", F.when(F.col("id") % 7 > 0, F.col("id")).alias("x"))
    df = cut(df)
    df.createOrReplaceTempView("running_test")
    want = spark.sql("SELECT id, sum(coalesce(x, 0)) OVER w AS s, row_number() OVER w AS n FROM running_test WINDOW w AS (PARTITION BY k ORDER BY o, id ROWS UNBOUNDED PRECEDING)")
    got = r.running(df, ["k"], ["o", "id"], {"s": "x"}, position="n")
    assert sorted(map(tuple, got.select("id", "s", "n").collect())) == sorted(map(tuple, want.collect()))
    assert r.running(df.limit(0), ["k"], ["o"], {"s": "x"}).count() == 0


def test_a_hot_key_is_more_than_one_task(spark, many_tasks):
    df = cut(spark.range(4000).select(F.lit(1).alias("k"), "id", F.lit(1).alias("x")).repartition(4))
    got = r.running(df, ["k"], ["id"], {"s": "x"})
    assert got.where("s != id + 1").isEmpty()
    placed = df.repartitionByRange("k", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(placed) > 1 and max(x["count"] for x in placed) < 4000


def test_fifo_of_a_hot_key(spark, many_tasks):
    lots = spark.range(1, 1001).select(F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("lot"), F.lit(2).cast("decimal(18,4)").alias("avail"))
    needs = spark.createDataFrame([(1, 701)], "k long, need int").select("k", F.col("need").cast("decimal(18,4)").alias("need"))
    got = r.fifo_take(lots, needs, ["k"], ["lot"], "avail", "need").collect()
    assert sum(x["take"] for x in got) == 701 and len(got) == 351 and max(x["lot"] for x in got) == [i for i in range(1, 1001) if i % 10][350]


def test_no_nested_loop_for_quantified(spark):
    df, q = spark.range(3), spark.range(2).select("id")
    for op, kind in (("<>", "ALL"), (">", "ALL"), ("<", "ANY"), ("=", "ANY")):
        assert "NestedLoop" not in r.quantified(df, F.col("id"), op, kind, q)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(NotImplementedError):
        r.quantified(df, F.col("id"), "=", "ALL", q)


def test_small_goes_by_bytes(spark):
    from tamarack.operators.bounded import small

    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    wide = cut(spark.range(3).select("id", F.repeat(F.lit("x"), 100_000).alias("t")))
    assert hinted(small(spark.range(3).toDF("a"), 500)) and not hinted(small(wide, 500)) and hinted(small(wide))


def test_model_rules_see_each_other(spark):
    cells = spark.createDataFrame([("p", 1, 1.0, None), ("p", 2, None, 5.0), ("q", 7, 2.0, 3.0), ("q", None, 9.0, 9.0)], "p string, n int, a double, b double")
    double = Rule("a", lambda i: F.array(F.lit(3), F.lit(4)), lambda i, cv, cell: cell("a", cv - 1) + 1, many=True)
    change = Rule("b", lambda i: F.lit(2), lambda i, cv, cell: cell("a", F.lit(3)) * 10, upsert=False)
    got = {(r["p"], r["n"]): (r["a"], r["b"]) for r in model(cells, ["p"], "n", ["a", "b"], [double, change], keep_nav=False).collect()}
    assert got == {("p", 1): (1.0, None), ("p", 2): (None, 10.0), ("p", 3): (1.0, None), ("p", 4): (2.0, None), ("q", 7): (2.0, 3.0), ("q", 3): (1.0, None), ("q", 4): (2.0, None)}
    kept = {(r["p"], r["n"]): r["a"] for r in model(cells, ["p"], "n", ["a"], [double]).collect()}
    assert kept["p", 3] is None and kept["p", 4] is None
    step = Rule("a", lambda i: i + 10, lambda i, cv, cell: i.cast("double"))
    made = model(cells, ["p"], "n", ["a"], [step], iterations=50, until=lambda i, cell: cell("a", i + 10) >= 2, between=(1, 2))
    assert sorted(r["n"] for r in made.where("p = 'p'").collect()) == [1, 2, 10, 11, 12]
    assert model(cells.limit(0), ["p"], "n", ["a"], [step]).count() == 0


def test_returning(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "n"), (3, None)], "k int, v string")
    assert sorted(map(tuple, returning(old, new, ["k"]).collect())) == [(2, "UPDATE", "x"), (4, "INSERT", "n")]
    assert sorted(map(tuple, returning(old, new.limit(0), ["k"]).collect())) == [(1, "DELETE", "a"), (2, "DELETE", "b"), (3, "DELETE", None)]


def test_the_error_of_an_approximate_count(spark):
    df = spark.range(50_000).select((F.col("id") % 20_000).alias("x"))
    assert abs(df.agg(F.approx_count_distinct("x", 0.02)).first()[0] - 20_000) < 0.06 * 20_000


def test_samples_hang_on_the_key_only(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 100).alias("block"))
    one = {x["id"] for x in r.sampled(df, ["id"], 10, 7).collect()}
    assert one == {x["id"] for x in r.sampled(df.repartition(7), ["id"], 10, 7).collect()} and abs(len(one) - 2000) < 200
    assert r.sampled(df, ["block"], 30, 1).groupBy("block").count().where("count != 200").isEmpty()
    assert r.sampled(df, ["id"], 0, 7).count() == 0 and r.sampled(df, ["id"], 100, 7).count() == 20_000


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master, _jsc = "spark://host:7077", spark.sparkContext._jsc

        def getConf(self):  # noqa: N802
            return spark.sparkContext.getConf()

    class Session:
        sparkContext, conf = Context(), spark.conf

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(RuntimeError):
            checkpoint_dir(Session())


def test_pivot_xml_escapes(spark):
    df = spark.createDataFrame([(1, "a<b"), (1, "a<b"), (1, None), (2, "c&d")], "k int, c string")
    got = {x["k"]: x["xml"] for x in r.pivot_xml(df, ["k"], "c", F.count("*"), name="n").collect()}
    assert got[2] == '<PivotSet><item><column name="C">c&amp;d</column><column name="N">1</column></item></PivotSet>' and "a&lt;b" in got[1] and got[1].count("<item>") == 2
    assert r.pivot_xml(df.limit(0), ["k"], "c", F.count("*"), name="n").count() == 0


def test_aggregates_over_keys(spark):
    df = spark.createDataFrame([(1, 2), (1, 4), (None, 7), (2, None)], "k int, x int")
    got = r.over_keys(df, ["k"], {"s": F.sum("x"), "n": F.count("*")}).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 2, 6, 2), (1, 4, 6, 2), (None, 7, 7, 1), (2, None, None, 1)], key=str)
    assert r.over_keys(df.limit(0), ["k"], {"s": F.sum("x")}).count() == 0
