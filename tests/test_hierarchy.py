"""Paths and loops by pointer doubling against depth-first search, and the defined cases."""

import os

import pytest
from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st

from tamarack.operators import connect_by as c
from tamarack.operators import graph as g
from tamarack.operators.hierarchy import all_below, components, descendants, hierarchy
from tamarack.operators.relational import BizError
from tamarack.plans.problems import p3_descendants

DATA = "/root/testdata/sf0.001"


def run(spark, links):
    paths, loops = hierarchy(spark.createDataFrame([(a, b, 0, 1) for a, b in links], "up long, down long, item long, path long"), parent="up", child="down")
    return sorted(tuple(r["path"]) for r in paths.collect()), {r["item"]: r["root"] for r in loops.collect()}


def brute(links):
    links = {(a, b) for a, b in links if a is not None and b is not None}
    below = {}
    for a, b in links:
        below.setdefault(a, set()).add(b)
    roots = {a for a, _ in links} - {b for _, b in links}
    paths = []

    def walk(path):
        paths.append(tuple(path))
        for x in below.get(path[-1], ()):
            if x not in path:
                walk([*path, x])

    for r in roots:
        walk([r])

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in below.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    nodes = {x for link in links for x in link}
    far = {x: reach(x) for x in nodes}
    loops = {x: min(y for y in far[x] if x in far[y]) for x in nodes if x in far[x]}
    return sorted(paths), loops


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 9)), max_size=13))
def test_equals_depth_first_search(spark, links):
    assert run(spark, links) == brute(links)


def test_a_long_chain_takes_few_rounds(spark):
    links = [(i, i + 1) for i in range(70)]
    paths, loops = run(spark, links)
    assert paths == [tuple(range(n + 1)) for n in range(71)] and not loops


def test_loops_that_share_a_node_and_links_to_itself(spark):
    links = [(1, 2), (2, 3), (3, 2), (3, 4), (4, 3), (7, 7), (8, 9), (9, 8)]
    assert run(spark, links) == brute(links)


def test_nulls_repeats_and_empty(spark):
    assert run(spark, [(1, 2), (1, 2), (None, 3), (4, None)]) == ([(1,), (1, 2)], {})
    assert run(spark, []) == ([], {})


def test_descendants(spark):
    paths, _ = hierarchy(spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "up long, down long"), parent="up", child="down")
    assert sorted(tuple(r) for r in descendants(paths).collect()) == [(1, 2, 1), (1, 3, 1), (2, 3, 1)]


def below(links):
    near = {}
    for a, b in links:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
    out = set()
    for a in near:
        seen, front, n = {a}, {a}, 0
        while front := {y for x in front for y in near.get(x, ())} - seen:
            seen, n = seen | front, n + 1
            out |= {(a, x, n) for x in front}
    return out


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(1, 9)), st.integers(1, 9)), max_size=13))
@example([(8, 9), (9, 8), (9, 5)])
@example([(1, 2), (2, 3), (3, 2), (7, 7), (1, 2)])
@example([(i, i + 1) for i in range(21)] + [(20, 0), (3, 9)])
@example([])
def test_all_below_is_plain_reachability(spark, links):
    got = all_below(spark.createDataFrame([(a, b, 0) for a, b in links], "up long, down long, item long"), parent="up", child="down").collect()
    assert len(got) == len(below(links)) and {tuple(r) for r in got} == below(links)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_p3_descendants_is_plain_reachability(spark):
    headers = {}
    for r in spark.read.parquet(f"{DATA}/t_bom_header.parquet").collect():
        headers.setdefault(r["bom_id"], set()).add(r["item_id"])
    links = {(a, r["component_item_id"]) for r in spark.read.parquet(f"{DATA}/t_bom_line.parquet").collect() for a in headers.get(r["bom_id"], ())}
    got = p3_descendants(spark, DATA).collect()
    assert len(got) == len(below(links)) and {tuple(r) for r in got} == below(links)


def test_components(spark):
    got = components(spark.createDataFrame([(1, 2), (2, 3), (9, 8), (None, 4), (5, 5)], "a long, b long"), "a", "b")
    assert {r["node"]: r["label"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 5: 5}


def test_connect_by_levels_leaves_and_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (None, 4)], "up long, down long")
    start = spark.createDataFrame([(1,)], "id long")
    got = c.connect_by(edges, start, parent="up", child="down", root="id").orderBy("level").collect()
    assert [(r["item"], r["level"], r["is_leaf"]) for r in got] == [(1, 1, 0), (2, 2, 0), (3, 3, 1)]
    with pytest.raises(BizError):
        c.connect_by(edges, start, parent="up", child="down", root="id", nocycle=False)
    with pytest.raises(BizError):
        c.connect_by(edges, start, parent="up", child="down", root="id", max_level=2)
    assert c.connect_by(edges, start.limit(0), parent="up", child="down", root="id").count() == 0


def test_roll_up_rounds_at_each_node(spark):
    edges = spark.createDataFrame([(1, 2, 1 / 3), (2, 3, 1 / 3)], "p long, c long, q double")
    got = c.rolled_up(edges, spark.createDataFrame([(3, 1.0)], "i long, v double"), parent="p", child="c", quantity="q", item="i", value="v", digits=2)
    assert {r["item"]: r["value"] for r in got.collect()} == {3: 1.0, 2: 0.33, 1: 0.11}


def test_graph_layers_and_shards(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "n string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "x string, y string")
    got = {r["node"]: (r["component"], r["layer"]) for r in g.layers(nodes, edges, node="n", a="x", b="y").collect()}
    assert got == {"a": ("a", 1), "b": ("b", 0), "c": ("b", 0), "d": ("d", 0)}
    groups = spark.createDataFrame([(0, "a", 2), (0, "b", 2), (0, "c", 9), (0, "d", 1)], "l int, g string, n int")
    assert [(r["group"], r["shard"]) for r in g.shards(groups, layer="l", group="g", size="n", most=4).orderBy("group").collect()] == [("a", 0), ("b", 0), ("c", 1), ("d", 2)]
