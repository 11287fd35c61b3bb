"""START WITH ... CONNECT BY over an edge table, level by level, and bottom-up roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.operators.relational import BizError, next_values
from tamarack.session import cut


def connect_by(
    edges: DataFrame,
    start: DataFrame,
    *,
    parent: str,
    child: str,
    root: str,
    nocycle: bool = True,
    max_level: int = 100,
    stop_level: int | None = None,
    keep_closing: bool = False,
    carry: dict[str, tuple[Column, Column]] | None = None,
) -> DataFrame:
    """Rows of a hierarchy below the items of ``start``.

    Returns root, item, level (1 for the roots), path (array of items from the root),
    is_leaf (CONNECT_BY_ISLEAF: 1 if nothing unvisited is below), is_cycle (CONNECT_BY_ISCYCLE:
    1 if an edge leads back to an item of the path) and the columns of ``carry``: for each a
    pair of its value at a root and the expression that makes a child's value from the parent's
    columns (prefixed ``up_``) and the edge's.

    One join with the edges for each level; levels are written to the checkpoint folder, so the
    lineage stays short. A path never enters an item that it holds: with ``nocycle`` the walk
    turns back there, else it raises. Deeper than ``max_level`` raises; with ``stop_level`` the
    walk ends there (LEVEL <= n). With ``keep_closing`` the rows that enter an item again come out
    too, with closes = 1, and are not led on (CYCLE ... SET). Edges with a null end join nothing; repeated edges give
    repeated rows, as in SQL; an empty start gives no row.
    """
    carry = carry or {}
    edges = cut(edges.where(F.col(parent).isNotNull() & F.col(child).isNotNull()))
    row = start.select(F.col(root).alias("root"), F.col(root).alias("item"), F.lit(1).alias("level"), F.array(F.col(root)).alias("path"), *[v.alias(c) for c, (v, _) in carry.items()])
    level = cut(row.where("item is not null").withColumn("_id", F.monotonically_increasing_id()))
    kinds = {c: level.schema[c].dataType for c in carry}
    found, links, closed = level, None, None
    for n in range(2, max_level + 2):
        if stop_level is not None and n > stop_level:
            break
        up = level.select("root", F.col("item").alias("_up"), F.col("path").alias("_path"), F.col("_id").alias("_of"), *[F.col(c).alias(f"up_{c}") for c in carry])
        down = up.join(edges, F.col("_up") == F.col(parent)).withColumn("_seen", F.array_contains("_path", F.col(child)))
        row = down.select(
            "root", F.col(child).alias("item"), F.lit(n).alias("level"), F.concat("_path", F.array(child)).alias("path"),
            *[e.cast(kinds[c]).alias(c) for c, (_, e) in carry.items()], "_of", "_seen",
        )
        row = cut(row.withColumn("_id", F.monotonically_increasing_id()))
        if not nocycle and not row.where("_seen").isEmpty():
            raise BizError("CYCLE", "the hierarchy holds a cycle")
        of = row.groupBy(F.lit(n - 1).alias("level"), F.col("_of").alias("_id")).agg(F.min(F.col("_seen").cast("int")).alias("is_leaf"), F.max(F.col("_seen").cast("int")).alias("is_cycle"))
        links = of if links is None else links.unionByName(of)
        if keep_closing:
            closing = row.where("_seen").drop("_of", "_seen")
            closed = closing if closed is None else closed.unionByName(closing)
        level = row.where("not _seen").drop("_of", "_seen")
        if level.isEmpty():
            break
        if n > max_level:
            raise BizError("TOO_DEEP", f"more than {max_level} levels")
        found = found.unionByName(level)
    if links is None:
        alone = found.drop("_id").withColumns({"is_leaf": F.lit(1), "is_cycle": F.lit(0)})
        return alone.withColumn("closes", F.lit(0)) if keep_closing else alone
    out = found.join(links, ["level", "_id"], "left").drop("_id").withColumns({"is_leaf": F.coalesce("is_leaf", F.lit(1)), "is_cycle": F.coalesce("is_cycle", F.lit(0))})
    if not keep_closing:
        return out
    return out.withColumn("closes", F.lit(0)).unionByName(closed.drop("_id").withColumns({"is_leaf": F.lit(1), "is_cycle": F.lit(0), "closes": F.lit(1)}))


def search_order(rows: DataFrame, *, path: str, level: str, name: str, breadth_first: bool = False) -> DataFrame:
    """SEARCH DEPTH|BREADTH FIRST BY ... SET name: numbers the rows of a walk from 1.

    ``path`` is the array of what siblings are ordered by, from the root on, and is unique.
    Depth first a row comes before what is below it; breadth first levels come one after the
    other. Numbered by range partitions, not in one task.
    """
    order = [level, path] if breadth_first else [path]
    return next_values(rows, name, 1, *order)


def sibling_order(path: Column, width: int = 19) -> Column:
    """A key by which ORDER SIBLINGS BY sorts: the path's items with leading zeros."""
    return F.array_join(F.transform(path, lambda x: F.lpad(x.cast("string"), width, "0")), "/")


def low_level_codes(edges: DataFrame, *, parent: str, child: str) -> DataFrame:
    """item and llc: the deepest level at which an item occurs below any top item; top items have 0.

    Items are taken off from the top: one gets its code when all its parents have theirs. One
    round for each level joins only the items of the round before; what is left lies on a loop
    or below one, has no deepest level and gets a null code.
    """
    links = cut(edges.select(F.col(parent).alias("p"), F.col(child).alias("c")).dropna().distinct())
    state = cut(links.groupBy(F.col("c").alias("item")).agg(F.count("*").alias("open")))
    front = cut(links.select(F.col("p").alias("item")).distinct().join(state, "item", "left_anti"))
    seen, n = front.withColumn("llc", F.lit(0)), 0
    while not front.isEmpty():
        n += 1
        met = front.join(links, F.col("item") == F.col("p")).groupBy(F.col("c").alias("item")).agg(F.count("*").alias("met"))
        state = cut(state.join(met, "item", "left").select("item", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open")))
        front = state.where("open = 0").select("item")
        state = state.where("open > 0")
        seen = seen.unionByName(front.withColumn("llc", F.lit(n)))
    return seen.unionByName(state.select("item", F.lit(None).cast("int").alias("llc")))


def rolled_up(edges: DataFrame, leaves: DataFrame, *, parent: str, child: str, quantity: str, item: str, value: str, per: str | None = None, digits: int = 6) -> DataFrame:
    """item and value of all nodes: a leaf has its own, another node the sum of its children's value times quantity, rounded at each node.

    With ``per`` the sum is divided by that column of the edges first (the output quantity that
    an edge's quantity is stated for, the same on all edges of a node; 0 and null count as 1).

    Bottom-up: a node is valued when all its children are. A round joins only the nodes valued
    in the round before and goes on until none is new, however deep the hierarchy is. Children
    without a value of their own count as 0, leaves without edges are left out; nodes on a loop
    or above one are never valued and left out.
    """
    base = F.coalesce(F.nullif(F.col(per).cast("double"), F.lit(0.0)), F.lit(1.0)) if per else F.lit(1.0)
    links = cut(edges.select(F.col(parent).alias("p"), F.col(child).alias("c"), F.col(quantity).cast("double").alias("q"), base.alias("base")).dropna(subset=["p", "c"]))
    state = cut(links.groupBy("p").agg(F.count("*").alias("open"), F.lit(0.0).alias("total"), F.max("base").alias("base")))
    own = leaves.select(F.col(item).alias("item"), F.col(value).cast("double").alias("value"))
    front = links.select(F.col("c").alias("item")).distinct().join(state.select(F.col("p").alias("item")), "item", "left_anti").join(own, "item", "left")
    front = cut(front.select("item", F.coalesce("value", F.lit(0.0)).alias("value")))
    known = front
    while not front.isEmpty():
        part = links.join(front, F.col("c") == F.col("item")).groupBy("p").agg(F.count("*").alias("met"), F.sum(F.coalesce(F.col("q") * F.col("value"), F.lit(0.0))).alias("part"))
        state = cut(state.join(part, "p", "left").select("p", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"), (F.col("total") + F.coalesce("part", F.lit(0.0))).alias("total"), "base"))
        front = state.where("open = 0").select(F.col("p").alias("item"), F.round(F.col("total") / F.col("base"), digits).alias("value"))
        state = state.where("open > 0")
        known = known.unionByName(front)
    return known
