"""Call-graph analytics: closure, components, layers, ownership and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.session import cut


def closure(edges: DataFrame, *, a: str, b: str) -> DataFrame:
    """a, b: all pairs with a path of at least one edge, by squaring: log2 of the longest path many rounds.

    For call graphs and the like; the result has up to nodes squared rows.
    """
    pairs = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().distinct())
    n = pairs.count()
    while True:
        far = pairs.select(F.col("a").alias("b"), F.col("b").alias("z")).join(pairs, "b").select("a", F.col("z").alias("b"))
        pairs = cut(pairs.unionByName(far).distinct())
        if (now := pairs.count()) == n:
            return pairs
        n = now


def reachable(edges: DataFrame, start: DataFrame, *, a: str, b: str, node: str) -> DataFrame:
    """node: everything that can be reached from the nodes of ``start``, these included; a frontier with visited nodes."""
    links = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().distinct())
    front = cut(start.select(F.col(node).alias("node")).dropna().distinct())
    seen = front
    while not front.isEmpty():
        front = cut(front.join(links, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = seen.unionByName(front)
    return seen


def lazy_closure(calls: DataFrame, refs: DataFrame, start: DataFrame, *, a: str, b: str, node: str) -> DataFrame:
    """node and how ('call' or 'ref'): packages that a scan from ``start`` has to read.

    Calls are followed transitively; packages that are only referred to come in too, without
    what they call; one that is referred to and later called counts as called.
    """
    called = cut(reachable(calls, start, a=a, b=b, node=node))
    links = refs.select(F.col(a).alias("node"), F.col(b).alias("ref")).dropna()
    only = links.join(called, "node", "left_semi").select(F.col("ref").alias("node")).distinct().join(called, "node", "left_anti")
    return called.select("node", F.lit("call").alias("how")).unionByName(only.select("node", F.lit("ref").alias("how")))


def strong_components(nodes: DataFrame, edges: DataFrame, *, node: str, a: str, b: str) -> DataFrame:
    """node and component (its smallest node): two nodes share one if each reaches the other.

    Nodes without a way in or out are trimmed off, then every node takes the smallest node that
    reaches it as its colour; what walks back to that node within its colour is its component.
    Components found are taken out and the rest is coloured anew. Every step is a join of the
    links with the nodes that changed; reachable pairs are never built. Links with a null end
    are left out, as are ends that are no node; null nodes too.
    """
    every = nodes.select(F.col(node).alias("node")).dropna().distinct()
    links = _trimmed(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct())
    found = None
    while not links.isEmpty():
        colour = _coloured(links)
        own = links.join(colour.select(F.col("node").alias("a"), F.col("colour").alias("ca")), "a").join(colour.select(F.col("node").alias("b"), F.col("colour").alias("cb")), "b")
        inside = cut(own.where("ca = cb").select("a", "b"))
        front = cut(colour.where("node = colour"))
        seen = front
        while not front.isEmpty():
            back = front.join(inside, F.col("node") == F.col("b")).select(F.col("a").alias("node"), "colour").distinct()
            front = cut(back.join(seen, "node", "left_anti"))
            seen = seen.unionByName(front)
        seen = cut(seen)
        found = seen if found is None else found.unionByName(seen)
        gone = seen.select("node")
        links = _trimmed(links.join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b")), "b", "left_anti"))
    if found is None:
        return every.withColumn("component", F.col("node"))
    return every.join(found, "node", "left").select("node", F.coalesce("colour", "node").alias("component"))


def _trimmed(links: DataFrame) -> DataFrame:
    """The links whose ends all have a way in and a way out, again and again."""
    links = cut(links)
    n = links.count()
    while n:
        links = cut(links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        now = links.count()
        if now == n:
            break
        n = now
    return links


def _coloured(links: DataFrame) -> DataFrame:
    """node and colour, the smallest node that reaches it or itself; only what changed in a round is led on."""
    colour = cut(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct().withColumn("colour", F.col("node")))
    front = colour
    while not front.isEmpty():
        offered = front.join(links, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("offer"))
        merged = cut(colour.join(offered, "node", "left").select("node", F.least("colour", "offer").alias("colour"), (F.col("offer") < F.col("colour")).alias("_new")))
        colour, front = merged.select("node", "colour"), merged.where("_new").select("node", "colour")
    return colour


def layers(nodes: DataFrame, edges: DataFrame, *, node: str, a: str, b: str) -> DataFrame:
    """node, component and layer: components that depend on nothing else are 0, others one above their highest dependency.

    An edge a, b says that a depends on b. Members of a component share a layer. A component is
    placed when all that it depends on is; a round joins only what the round before placed.
    """
    parts = cut(strong_components(nodes, edges, node=node, a=a, b=b))
    up = parts.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    down = parts.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    links = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).join(up, "a").join(down, "b").where("ca != cb").select("ca", "cb").distinct())
    state = cut(links.groupBy(F.col("ca").alias("c")).agg(F.count("*").alias("open")))
    front = cut(parts.select(F.col("component").alias("c")).distinct().join(state, "c", "left_anti"))
    level, n = front.withColumn("layer", F.lit(0)), 0
    while not front.isEmpty():
        n += 1
        met = links.join(front, F.col("cb") == F.col("c")).groupBy(F.col("ca").alias("c")).agg(F.count("*").alias("met"))
        state = cut(state.join(met, "c", "left").select("c", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open")))
        front = state.where("open = 0").select("c")
        state = state.where("open > 0")
        level = level.unionByName(front.withColumn("layer", F.lit(n)))
    return parts.join(level, F.col("component") == F.col("c")).select("node", "component", "layer")


def owners(units: DataFrame, calls: DataFrame, *, unit: str, kind: str, package: str, caller: str, callee: str) -> DataFrame:
    """unit and owner of each function: the nearest procedure of its package that calls it through functions, ties to the smallest name.

    Functions without such a procedure are left out.
    """
    functions = cut(units.where(F.col(kind) == "FUNCTION").select(F.col(unit).alias("f"), F.col(package).alias("fp")))
    procedures = units.where(F.col(kind) == "PROCEDURE").select(F.col(unit).alias("owner"), F.col(package).alias("pkg"))
    links = cut(calls.select(F.col(caller).alias("x"), F.col(callee).alias("y")).distinct())
    front = cut(procedures.join(links, F.col("owner") == F.col("x")).join(functions, F.col("y") == F.col("f")).where("fp = pkg").select("owner", "pkg", "f").distinct())
    seen, n = front.withColumn("dist", F.lit(1)), 1
    while not front.isEmpty():
        n += 1
        step = front.join(links, F.col("f") == F.col("x")).select("owner", "pkg", "y").join(functions, F.col("y") == F.col("f")).where("fp = pkg").select("owner", "pkg", "f").distinct()
        front = cut(step.join(seen.select("owner", "f"), ["owner", "f"], "left_anti").select("owner", "pkg", "f"))
        seen = seen.unionByName(front.withColumn("dist", F.lit(n)))
    return seen.groupBy(F.col("f").alias("unit")).agg(F.min(F.struct("dist", "owner")).alias("x")).select("unit", F.col("x.owner").alias("owner"))


def shards(groups: DataFrame, *, layer: str, group: str, size: str, most: int) -> DataFrame:
    """layer, group, shard: groups of a layer are packed in order, a shard closing when the next group would exceed ``most``; a larger group has a shard of its own.

    The packing of a layer is one after the other by its nature; a layer holds the groups of one
    call-graph level, of which there are thousands, not millions.
    """
    items = F.sort_array(F.collect_list(F.struct(F.col(group).alias("g"), F.col(size).cast("int").alias("n"))))
    zero = F.struct(F.array().cast("array<struct<g:string,s:int>>").alias("out"), F.lit(0).alias("shard"), F.lit(0).alias("used"))

    def step(acc, x):  # noqa: ANN001, ANN202
        full = (acc["used"] > 0) & (acc["used"] + x["n"] > most)
        shard = F.when(full, acc["shard"] + 1).otherwise(acc["shard"])
        used = F.when(full, x["n"]).otherwise(acc["used"] + x["n"])
        return F.struct(F.concat(acc["out"], F.array(F.struct(x["g"].cast("string").alias("g"), shard.alias("s")))).alias("out"), shard.alias("shard"), used.alias("used"))

    packed = groups.groupBy(F.col(layer).alias("layer")).agg(F.aggregate(items, zero, step)["out"].alias("o"))
    return packed.select("layer", F.inline("o")).select("layer", F.col("g").alias("group"), F.col("s").alias("shard"))


def ref_names(units: DataFrame, *, package: str, name: str, position: str) -> DataFrame:
    """Units with ref_name: the name, or name__1, name__2, ... in order where a package has it several times, whatever the case."""
    by = Window.partitionBy(package, F.upper(name))
    n = F.count("*").over(by)
    i = F.row_number().over(by.orderBy(position))
    return units.withColumn("ref_name", F.when(n > 1, F.concat(F.col(name), F.lit("__"), i.cast("string"))).otherwise(F.col(name)))
