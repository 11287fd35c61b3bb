"""Periods and gaps against brute force over days, and the defined cases."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tamarack.operators.intervals import OPEN_END, periods_and_gaps

SCHEMA = "id long, e long, day_from date, day_to date, kind string, first_day string"
BASE = dt.date(2020, 1, 1).toordinal()
EPOCH = dt.date(1970, 1, 1).toordinal()


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = periods_and_gaps(df, entity=["e"], record_id="id", date_from="day_from", date_to="day_to").collect()
    return sorted((r["e"], r["kind"], r["first_day"], r["last_day"], r["n_records"]) for r in got)


def record(i, e, start, end):
    return (i, e, dt.date.fromordinal(BASE + start), None if end is None else dt.date.fromordinal(BASE + end))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 60), st.integers(-2, 15)), max_size=20))
def test_equals_brute_force(spark, data):
    rows = [record(i, e, s, s + n) for i, (e, s, n) in enumerate(data)]
    want = []
    for e in {r[1] for r in rows}:
        own = [(r[2].toordinal(), r[3].toordinal()) for r in rows if r[1] == e and r[2] <= r[3]]
        covered = sorted({x for a, b in own for x in range(a, b + 1)})
        runs = []
        for x in covered:
            if runs and runs[-1][1] == x - 1:
                runs[-1][1] = x
            else:
                runs.append([x, x])
        for a, b in runs:
            want.append((e, "period", a - EPOCH, b - EPOCH, sum(a <= s <= b for s, _ in own)))
        want += [(e, "gap", runs[k][1] + 1 - EPOCH, runs[k + 1][0] - 1 - EPOCH, 0) for k in range(len(runs) - 1)]
    assert run(spark, rows) == sorted(want)


def test_open_ends_and_wrong_records(spark):
    got = run(spark, [record(1, 1, 0, 3), record(2, 1, 10, None), record(3, 1, 6, 4), record(4, 1, 20, 25)])
    assert got == [(1, "gap", BASE + 4 - EPOCH, BASE + 9 - EPOCH, 0), (1, "period", BASE - EPOCH, BASE + 3 - EPOCH, 1), (1, "period", BASE + 10 - EPOCH, OPEN_END, 2)]


def test_repeats_count_once_and_nulls_are_left_out(spark):
    rows = [record(1, 1, 0, 3)] * 3 + [(None, 1, dt.date(2020, 1, 1), None), (2, None, dt.date(2020, 1, 1), None), (3, 1, None, dt.date(2020, 1, 1))]
    assert run(spark, rows) == [(1, "period", BASE - EPOCH, BASE + 3 - EPOCH, 1)]


def test_empty(spark):
    assert run(spark, []) == []
