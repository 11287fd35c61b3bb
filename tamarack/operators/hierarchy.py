"""Parent-child links to full hierarchies by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.operators.relational import BizError
from tamarack.session import cut

#: Doubling rounds: enough for paths of 2**40 links, far more than there can be rows.
_ROUNDS = 40


def _distinct_links(links: DataFrame, parent: str, child: str) -> DataFrame:
    return links.select(F.col(parent).alias("p"), F.col(child).alias("c")).dropna().distinct()


def hierarchy(links: DataFrame, *, parent: str, child: str) -> tuple[DataFrame, DataFrame]:
    """All paths from roots, and all items on loops.

    Returns (paths, cycles): paths has root, item, depth and path (array from root to item), one
    row for each simple path from a root, the root itself at depth 0; a root has links downwards
    and is nobody's child. cycles has item and root, the smallest item of those that it reaches
    and that reach it, one row for each item that can get back to itself.

    Pointer doubling: every node starts with segments to its parents. In each round a segment
    whose top is no root is joined with the segments that end at its top, which doubles its
    length and concatenates the paths. After k rounds all paths of up to 2**k links are resolved.
    A joined segment that would meet a node twice closes a loop: every simple loop of m nodes is
    met when segments of at most m nodes are first joined to m or more links, so that unresolved
    segments end at the latest after logarithmic rounds of the longest simple walk. Loops that
    share nodes are one strongly connected set; its smallest item comes from label propagation
    with pointer jumping. Each round is written to the checkpoint folder, and both sides of its
    join are plain shuffles, which adaptive execution can split where a node is hot.

    Nulls: links with a null end are left out. Repeated links count once. A link to itself is a
    loop and part of no path. Empty input gives two empty results; other columns are ignored.
    """
    pairs = cut(_distinct_links(links, parent, child))
    roots = pairs.select(F.col("p").alias("root")).distinct().join(pairs.select(F.col("c").alias("root")).distinct(), "root", "left_anti")
    start = (
        pairs.where("p != c")
        .join(roots, F.col("p") == F.col("root"), "left")
        .select(F.col("p").alias("top"), F.col("c").alias("bottom"), F.array("p", "c").alias("path"), F.col("root").isNotNull().alias("done"), F.lit(False).alias("loop"))
    )
    rounds = [cut(start)]
    done = [rounds[0].where("done")]
    open_ = rounds[0].where("not done")
    for _ in range(_ROUNDS):
        if open_.isEmpty():
            break
        upper = open_.unionByName(_union(done)).select(F.col("top").alias("t_top"), F.col("bottom").alias("top"), F.col("path").alias("t_path"), F.col("done").alias("t_done"))
        joined = open_.select("top", "bottom", "path").join(upper, "top").select(
            F.col("t_top").alias("top"),
            "bottom",
            F.concat("t_path", F.expr("slice(path, 2, size(path) - 1)")).alias("path"),
            F.col("t_done").alias("done"),
            F.arrays_overlap(F.expr("slice(t_path, 1, size(t_path) - 1)"), F.expr("slice(path, 2, size(path) - 1)")).alias("loop"),
        )
        rounds.append(cut(joined))
        done.append(rounds[-1].where("done and not loop"))
        open_ = rounds[-1].where("not done and not loop")
    else:
        raise BizError("TOO_DEEP", f"paths of more than 2**{_ROUNDS} links")
    paths = _union(done).select(F.col("top").alias("root"), F.col("bottom").alias("item"), (F.size("path") - 1).alias("depth"), "path")
    paths = paths.unionByName(roots.select("root", F.col("root").alias("item"), F.lit(0).alias("depth"), F.array("root").alias("path")))
    return paths, _loops(pairs, _union([r.where("loop").select("path") for r in rounds[1:]]) if len(rounds) > 1 else None)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _loops(pairs: DataFrame, walks: DataFrame | None) -> DataFrame:
    """item and root (its smallest companion) of all items on loops, from walks that meet a node twice."""
    near = pairs.where("p = c").select(F.col("p").alias("a"), F.col("c").alias("b"))
    if walks is not None:
        met = walks.select("path", F.posexplode("path").alias("i", "a")).select("path", "i", "a", F.expr("array_position(slice(path, i + 2, size(path)), a)").cast("int").alias("n")).where("n > 0")
        near = near.unionByName(met.select("a", F.explode(F.expr("slice(path, i + 1, n)")).alias("b")))
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return components(near, "a", "b").select(F.col("node").alias("item"), F.col("label").alias("root"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and label, the smallest node of its connected component, of undirected ``edges``.

    Min-label propagation with pointer jumping; each round is written to the checkpoint folder.
    Edges with a null end are left out, repeated edges and self loops change nothing, empty input
    gives an empty result.
    """
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    both = cut(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        step = (
            both.join(label, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("label").alias("label"))
            .join(label.select(F.col("node").alias("a"), F.col("label").alias("old")), "a")
            .select(F.col("a").alias("node"), F.least("label", "old").alias("near"), "old")
        )
        jumped = cut(
            step.join(label.select(F.col("node").alias("near"), F.col("label").alias("far")), "near").select("node", F.least("near", "far").alias("label"), "old")
        )
        label = jumped.select("node", "label")
        if jumped.where("label < old").isEmpty():
            return label


def descendants(paths: DataFrame) -> DataFrame:
    """item, descendant and the smallest number of links between them, for every item above another on a path."""
    above = paths.where("depth > 0").select(F.col("item").alias("descendant"), F.posexplode(F.expr("slice(path, 1, depth)")).alias("i", "item"), "depth")
    return above.groupBy("item", "descendant").agg(F.min(F.col("depth") - F.col("i")).alias("links"))


def all_below(links: DataFrame, *, parent: str, child: str) -> DataFrame:
    """item, descendant and the smallest number of links between them, for every item and whatever can be reached from it.

    From the links themselves, so that items on and below loops count whether or not a root
    reaches them. An item on a loop is not its own descendant.

    Doubling: after k rounds all pairs of up to 2**k links are known. A shortest way of more links
    passes an item at exactly 2**k, so only the pairs at that distance are led on, by one join with
    the known pairs; without such a pair nothing is left. Each round is written to the checkpoint
    folder, and both sides of its join are plain shuffles.

    Nulls: links with a null end are left out. Repeated links count once, links to itself not at
    all. Empty input gives an empty result; other columns are ignored.
    """
    pairs = _distinct_links(links, parent, child).where("p != c")
    rounds = [cut(pairs.select(F.col("p").alias("item"), F.col("c").alias("descendant"), F.lit(1).alias("links")))]
    for k in range(_ROUNDS):
        far = rounds[-1].where(F.col("links") == 2**k)
        if far.isEmpty():
            break
        known = _union(rounds)
        lower = known.select(F.col("item").alias("via"), F.col("descendant").alias("d"), F.col("links").alias("n"))
        led_on = far.join(lower, F.col("descendant") == F.col("via")).where("item != d").groupBy("item", F.col("d").alias("descendant")).agg(F.min(F.col("links") + F.col("n")).alias("links"))
        rounds.append(cut(led_on.join(known.select("item", "descendant"), ["item", "descendant"], "left_anti")))
    else:
        raise BizError("TOO_DEEP", f"ways of more than 2**{_ROUNDS} links")
    return _union(rounds)
