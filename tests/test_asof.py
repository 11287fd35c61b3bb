"""The as-of join against brute force, and its defined cases."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tamarack.operators.asof import as_of_join

EVENTS = "event_id long, a long, b string, day date, valid_from string"
RULES = "rule_id long, a long, b string, valid_from date, valid_to date, known timestamp, day string"
HOW = {"event_id": "event_id", "keys": [("a", "a"), ("b", "b")], "event_date": "day", "rule_id": "rule_id", "valid_from": "valid_from", "valid_to": "valid_to", "known_from": "known"}
DAY = dt.date(2020, 1, 1)


def run(spark, events, rules):
    return {r["event_id"]: r["rule_id"] for r in as_of_join(spark.createDataFrame(events, EVENTS), spark.createDataFrame(rules, RULES), **HOW).collect()}


def brute(events, rules):
    out = {}
    for e in events:
        fit = [(r[3], r[0]) for r in rules if r[1] == e[1] and r[2] == e[2] and r[3] <= e[3] and (r[4] is None or r[4] >= e[3]) and r[5].date() <= e[3]]
        if fit:
            out[e[0]] = max(fit)[1]
    return out


days = st.one_of(st.integers(0, 40), st.integers(0, 5000), st.integers(-700_000, 2_900_000))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.integers(1, 2), days), min_size=1, max_size=25),
    st.lists(st.tuples(st.integers(1, 2), days, st.one_of(st.none(), st.integers(-3, 3000)), st.integers(0, 30)), min_size=1, max_size=25),
)
def test_equals_brute_force(spark, event_data, rule_data):
    date = lambda n: dt.date.fromordinal(max(1, min(DAY.toordinal() + n, dt.date.max.toordinal() - 40)))
    events = [(i, k, "x", date(n), None) for i, (k, n) in enumerate(event_data)]
    rules = []
    for i, (k, n, length, late) in enumerate(rule_data):
        start = date(n)
        end = None if length is None else dt.date.fromordinal(max(1, min(start.toordinal() + length, dt.date.max.toordinal())))
        rules.append((i, k, "x", start, end, dt.datetime.combine(dt.date.fromordinal(max(start.toordinal() - 15 + late, 1)), dt.time(13, 5)), None))
    assert run(spark, events, rules) == brute(events, rules)


def test_both_ends_belong_and_later_knowledge_does_not(spark):
    known = dt.datetime(2020, 1, 1, 23, 59)
    rules = [(1, 1, "x", DAY, dt.date(2020, 1, 10), known, None), (2, 1, "x", dt.date(2020, 1, 3), None, dt.datetime(2020, 1, 6), None)]
    events = [(i, 1, "x", dt.date(2020, 1, i), None) for i in range(1, 13)]
    assert run(spark, events, rules) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1} | {i: 2 for i in range(6, 13)}


def test_ties_go_to_the_highest_id_and_repeats_change_nothing(spark):
    rules = [(i, 1, "x", DAY, None, dt.datetime(2019, 1, 1), None) for i in (3, 9, 5, 9)]
    events = [(7, 1, "x", DAY, None)] * 3
    assert run(spark, events, rules) == {7: 9}
    assert as_of_join(spark.createDataFrame(events, EVENTS), spark.createDataFrame(rules, RULES), **HOW).count() == 1


def test_nulls_match_nothing(spark):
    known = dt.datetime(2019, 1, 1)
    good = (1, 1, "x", DAY, None, known, None)
    rules = [good, (None, 1, "x", DAY, None, known, None), (2, None, "x", DAY, None, known, None), (3, 1, "x", None, None, known, None), (4, 1, "x", DAY, None, None, None), (5, 1, "x", DAY, dt.date(2019, 1, 1), known, None)]
    events = [(1, 1, "x", DAY, None), (None, 1, "x", DAY, None), (3, None, "x", DAY, None), (4, 1, None, DAY, None), (5, 1, "x", None, None)]
    assert run(spark, events, rules) == {1: 1}


def test_empty_tables(spark):
    event, rule = (1, 1, "x", DAY, None), (1, 1, "x", DAY, None, dt.datetime(2019, 1, 1), None)
    assert run(spark, [], [rule]) == run(spark, [event], []) == run(spark, [], []) == {}


def test_a_hot_key_keeps_one_entry_for_each_node(spark):
    rules = [(i, 1, "x", dt.date.fromordinal(DAY.toordinal() + i % 50), dt.date.fromordinal(DAY.toordinal() + 100), dt.datetime(2019, 1, 1), None) for i in range(3000)]
    events = [(i, 1, "x", dt.date.fromordinal(DAY.toordinal() + i % 120), None) for i in range(2000)]
    assert run(spark, events, rules) == brute(events, rules)


def test_payload_comes_from_the_same_rule(spark):
    rules = spark.createDataFrame([(1, 1, "x", DAY, None, dt.datetime(2019, 1, 1), "old"), (2, 1, "x", dt.date(2020, 1, 2), None, dt.datetime(2019, 1, 1), "new")], RULES)
    got = as_of_join(spark.createDataFrame([(1, 1, "x", dt.date(2020, 5, 5), None)], EVENTS), rules, **HOW, payload=["day"])
    assert [tuple(r) for r in got.collect()] == [(1, 2, "new")]
