"""Mixtures: budgets, copies and shares against the definition, and the defined cases."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tamarack.llm.mixing import mix

DOCS = "id long, src string, n long, source string, copies int"


def run(spark, docs, targets):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS)
    goals = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    chosen, report = mix(df, goals, doc_id="id", source="src", size="n")
    return {r["id"]: (r["src"], r["size"], r["copies"]) for r in chosen.collect()}, {r["source"]: r for r in report.collect()}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(1, 50)), min_size=6, max_size=60), st.lists(st.integers(1, 9), min_size=3, max_size=3), st.lists(st.integers(1, 4), min_size=3, max_size=3))
def test_budgets_are_met(spark, data, shares, most):
    docs = [(i, s, n) for i, (s, n) in enumerate(data)]
    targets = [(s, x / sum(shares), m) for s, x, m in zip("abc", shares, most, strict=True)]
    chosen, report = run(spark, docs, targets)
    size = {s: sum(n for _, x, n in docs if x == s) for s in "abc"}
    whole = min(m * size[s] / x for s, x, m in targets if size[s])
    for s, x, m in targets:
        used = sum(n * c for src, n, c in chosen.values() if src == s)
        own = {c for src, _, c in chosen.values() if src == s}
        largest = max([n for _, src, n in docs if src == s], default=0)
        assert report[s]["used"] == used and all(c <= m for c in own) and (not own or max(own) - min(own) <= 1)
        if size[s]:
            assert abs(used - round(x * whole)) <= largest / 2 + 1


def test_small_source_is_repeated(spark):
    chosen, report = run(spark, [(1, "a", 10), (2, "b", 100), (3, "b", 100)], [("a", 0.5, 3), ("b", 0.5, 1)])
    assert chosen[1] == ("a", 10, 3) and report["a"]["used"] == 30 and report["a"]["copies_to"] == 3


def test_defined_cases(spark):
    docs = [(1, "a", 10), (1, "a", 10), (2, None, 5), (3, "other", 5), (None, "a", 5), (4, "a", None), (5, "a", 0), (6, "b", 10)]
    chosen, report = run(spark, docs, [("a", 0.5, 2), ("b", 0.5, 2), ("none", 0.2, 1), ("null", None, None), (None, 0.1, 1), ("a", 0.4, 1)])
    assert set(chosen) == {1, 6} and report["a"]["available"] == 10 and report["none"]["reached_share"] == 0.0 and report["null"]["budget"] == 0 and None not in report
    assert run(spark, [], [("a", 1.0, 1)])[0] == {} and run(spark, docs, []) == ({}, {})


def test_shares_of_a_large_corpus(spark):
    docs = [(i, "big" if i % 3 else "small", 1 + i % 7) for i in range(6000)]
    _, report = run(spark, docs, [("big", 0.3, 1), ("small", 0.7, 2)])
    assert all(abs(r["reached_share"] - r["target_share"]) < 0.001 for r in report.values())
