"""Stock: issues with short items, moving averages over several blocks, transfers."""

import pytest
from pyspark.sql import functions as F

from tamarack.operators import inventory as i


@pytest.fixture(scope="module")
def lots(spark):
    rows = [(1, 1, "1", "10"), (1, 2, "2", "20"), (2, 3, "5", "1"), (None, 4, "5", "1"), (3, 5, None, "1")]
    return spark.createDataFrame(rows, "k long, lot long, q string, c string").selectExpr("k", "lot", "cast(q as decimal(18,4)) q", "cast(c as decimal(20,6)) c", "'x' stock")


def test_issue_before_and_after_and_short(spark, lots):
    needs = spark.createDataFrame([(1, 2), (2, 6), (3, 1), (9, 1)], "k long, need int").selectExpr("k", "cast(need as decimal(18,4)) need")
    done, short = i.issue(lots.drop("stock"), needs, ["k"], ["lot"], available="q", needed="need")
    got = sorted((r["lot"], float(r["take"]), float(r["lot_left"]), r["status"], float(r["qty_before"]), float(r["qty_after"])) for r in done.collect())
    assert got == [(1, 1.0, 0.0, "CONSUMED", 3.0, 2.0), (2, 1.0, 1.0, "AVAILABLE", 2.0, 1.0)]
    assert sorted((r["k"], float(r["stock"])) for r in short.collect()) == [(2, 5.0), (3, 0.0), (9, 0.0)]
    assert i.issue(lots.limit(0), needs.limit(0), ["k"], ["lot"], available="q", needed="need")[0].count() == 0


def test_moving_average_over_blocks(spark):
    rows = [(k, n, float(n % 7 + 1), float(n % 11)) for k in (1, None) for n in range(600 if k else 5)]
    df = spark.createDataFrame(rows, "k long, n long, q double, c double")
    got = {(r["k"], r["n"]): (r["qty_after"], r["avg_cost"]) for r in i.receive(df, ["k"], ["n"], quantity="q", cost="c").collect()}
    for k in (1, None):
        stock = avg = 0.0
        for _, n, q, c in [x for x in rows if x[0] == k]:
            avg = c if n == 0 else round((stock * avg + q * c) / (stock + q), 6)
            stock += q
            assert got[k, n][0] == stock and abs(got[k, n][1] - avg) < 2e-6
    assert len(got) == 605
    assert i.receive(df.limit(0), ["k"], ["n"], quantity="q", cost="c").count() == 0


def test_transfers_keep_the_total(spark):
    moves = spark.createDataFrame([(1, "a", "b", 3), (2, None, "b", 4)], "id int, f string, t string, q int")
    got = sorted((r["id"], str(r["place"]), r["q"]) for r in i.transfers(moves, quantity="q", from_place="f", to_place="t", place="place").collect())
    assert got == [(1, "a", -3), (1, "b", 3), (2, "None", -4), (2, "b", 4)]
    assert i.transfers(moves, quantity="q", from_place="f", to_place="t", place="place").agg(F.sum("q")).first()[0] == 0
