"""Relational operators that Spark has no word for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.operators.bounded import small
from tamarack.session import cut


class BizError(Exception):
    """An error of the library with a code."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


def exactly_one(df: DataFrame):  # noqa: ANN201
    """SELECT INTO: the only row; NO_DATA_FOUND or TOO_MANY_ROWS otherwise. Reads two rows at most."""
    rows = df.take(2)
    if len(rows) != 1:
        raise BizError("TOO_MANY_ROWS" if rows else "NO_DATA_FOUND", f"{'more than one' if rows else 'no'} row")
    return rows[0]


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, whole, by a window that Spark limits to one row a key and task before the shuffle.

    Where a few columns suffice, max or min of a struct is cheaper (``join_latest_per_key``). ``order`` holds plain ascending or descending columns; the caller adds a unique last one.
    Rows with equal order are decided by the engine. A null key is a key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def keep(df: DataFrame, keys: Sequence[str], rank_by: Column, aggregates: dict[str, Column], *, last: bool = False) -> DataFrame:
    """agg(x) KEEP (DENSE_RANK FIRST|LAST ORDER BY rank_by): aggregates over the rows with the smallest or largest value.

    Two aggregates with map-side combine instead of a window: the extreme of each key, then the
    rows that hold it. Nulls sort last ascending, so LAST takes them where there are any.
    """
    top = F.max if last else F.min
    edge = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(top(rank_by).alias("_edge"), F.count(F.when(rank_by.isNull(), 1)).alias("_nulls"))
    if last:
        edge = edge.withColumn("_edge", F.when(F.col("_nulls") == 0, F.col("_edge")))
    match = rank_by.eqNullSafe(F.col("_edge"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(edge, match).groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def over_keys(df: DataFrame, keys: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates OVER (PARTITION BY keys): each row with its key's aggregates, which are combined before the shuffle and joined back.

    No partition is held in memory. A redundant key makes both sides shuffles of the join, which
    adaptive execution can split where a key is hot. A null key is a key.
    """
    twice = F.pmod(F.xxhash64(*keys), F.lit(2))
    agg = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(*[c.alias(n) for n, c in aggregates.items()])
    agg = agg.withColumn("_r", F.pmod(F.xxhash64(*[f"_{k}" for k in keys]), F.lit(2)))
    match = twice == F.col("_r")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(agg, match).drop("_r", *[f"_{k}" for k in keys])


def with_ties(df: DataFrame, order: Sequence[str | tuple[str, bool]], n: int, *, descending: bool = False) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES: the first n rows and all that equal the last of them; nulls sort as the largest.

    ``order`` holds columns, or pairs of a column and whether it descends. The bound is the last
    row of a limit of n; the table is filtered by it instead of ranked in one task.
    """
    by = [c if isinstance(c, tuple) else (c, descending) for c in order]
    sort = lambda down: [F.col(c).desc_nulls_first() if d != down else F.col(c).asc_nulls_last() for c, d in by]
    edge = df.select(*[c for c, _ in by]).orderBy(*sort(False)).limit(n).orderBy(*sort(True)).limit(1).select(*[F.col(c).alias(f"_e{i}") for i, (c, _) in enumerate(by)])
    inside = F.lit(True)
    for i, (c, down) in reversed(list(enumerate(by))):
        mine, bound = F.col(c), F.col(f"_e{i}")
        before = (mine > bound) | (mine.isNull() & bound.isNotNull()) if down else (mine < bound) | (mine.isNotNull() & bound.isNull())
        inside = F.coalesce(before, F.lit(False)) | (mine.eqNullSafe(bound) & inside)
    return df.join(F.broadcast(edge), inside, "left_semi")


def fetch_percent(df: DataFrame, percent: float, *order: Column | str) -> DataFrame:
    """FETCH FIRST p PERCENT ROWS ONLY: ceil(p% of the rows) in the given order, numbered by range partitions."""
    n = df.count()
    return next_values(df, "_n", 1, *order).where(F.col("_n") <= -int(-n * percent // 100)).drop("_n")


def densify(facts: DataFrame, keys: Sequence[str], calendar: DataFrame, on: Sequence[str]) -> DataFrame:
    """Partitioned outer join: every key of ``facts`` with every row of ``calendar``, facts where there are any.

    The calendar is broadcast if it is small; the product has keys x calendar rows, as the operator says.
    """
    dense = facts.select(*keys).distinct().join(small(calendar), how="cross")
    return dense.join(facts, [*keys, *on], "left")


def merge_into(target: DataFrame, source: DataFrame, keys: Sequence[str], *, update: dict[str, Column] | None = None, update_where: Column | None = None, delete_where: Column | None = None, insert_where: Column | None = None, insert: dict[str, Column] | None = None) -> DataFrame:
    """MERGE: the new snapshot of ``target``.

    Matched rows take ``update`` (expressions over t.* and s.*) where ``update_where`` holds and
    go where ``delete_where`` holds after the update; rows of ``source`` without match are
    inserted where ``insert_where`` holds, with the values of ``insert`` (default: columns of the same name). A source that has a key twice raises, as the result
    would not be defined. Keys match by equality: a null key never matches.

    A left join of the target and an anti join of the source, so that a small source is
    broadcast and the target is not shuffled for it.
    """
    if not source.groupBy(*keys).count().where("count > 1").dropna(subset=list(keys)).isEmpty():
        raise BizError("UNSTABLE_ROWS", "a key occurs twice in the source")
    t, s = target.alias("t"), source.withColumn("_s", F.lit(True)).alias("s")
    on = None
    for k in keys:
        same = F.col(f"t.{k}") == F.col(f"s.{k}")
        on = same if on is None else on & same
    both = F.col("s._s").isNotNull()
    hit = both & (F.coalesce(update_where, F.lit(False)) if update_where is not None else F.lit(True))
    kinds = {c: target.schema[c].dataType for c in target.columns}
    values = {c: F.when(hit, (update or {})[c]).otherwise(F.col(f"t.{c}")) if c in (update or {}) else F.col(f"t.{c}") for c in target.columns}
    kept = t.join(s, on, "left").select(*[v.cast(kinds[c]).alias(c) for c, v in values.items()], hit.alias("_hit"))
    if delete_where is not None:
        kept = kept.where(~(F.col("_hit") & F.coalesce(delete_where, F.lit(False))))
    matched = target.select(*keys).alias("t").join(source.select(*keys).alias("s"), on, "left_semi")
    new = source.join(matched.distinct(), list(keys), "left_anti").alias("s")
    if insert_where is not None:
        new = new.where(F.coalesce(insert_where, F.lit(False)))
    given = {c: F.col(f"s.{c}") for c in source.columns} if insert is None else insert
    added = new.select(*[given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in target.columns])
    return kept.drop("_hit").unionByName(added)


def split_rejects(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every rule, and the others with the name of the first rule they break (a null result breaks it)."""
    reason = F.coalesce(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    judged = rows.withColumn("reject_reason", reason)
    return judged.where("reject_reason is null").drop("reject_reason"), judged.where("reject_reason is not null")


def next_values(df: DataFrame, name: str, first: int, *order: Column | str) -> DataFrame:
    """Sequence numbers without gaps in the order of ``order`` (unique), from ``first`` on: ROW_NUMBER() OVER (ORDER BY ...).

    Range-partitioned by the order: each task numbers its own rows, and the starts come from the
    counts of the partitions, of which there are as many as tasks; no global window. These
    counts, one row a task, are broadcast.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = placed.groupBy("_p").count()
    starts = counts.withColumn("_s", F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return placed.join(F.broadcast(starts.select("_p", "_s")), "_p").withColumn(name, (rank + F.coalesce("_s", F.lit(0)) + F.lit(first - 1)).cast("long")).drop("_p", "_s")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str], *, position: str | None = None) -> DataFrame:
    """Running sums within each key in the order of ``order`` (unique): SUM(x) OVER (PARTITION BY keys ORDER BY order).

    Adds the columns of ``sums`` (new name to summed column) and with ``position`` the row
    number. A key that holds a third of all rows is not one task: rows are range-partitioned by
    keys and order, each task runs over its own rows, and what earlier tasks hold of a key comes
    from one row for each task's first and last key, at most two a task, which are broadcast.
    A null key is a key, null values count as 0, an empty table gives none.
    """
    placed = cut(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))
    key = F.struct(*[F.col(k) for k in keys])
    ends = placed.groupBy("_p").agg(F.min(key).alias("_a"), F.max(key).alias("_b")).select(F.col("_p").alias("_ep"), F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_k"))
    parts = placed.join(F.broadcast(ends), (F.col("_p") == F.col("_ep")) & key.eqNullSafe(F.col("_k")), "left_semi")
    names = {f"_sum{i}": c for i, c in enumerate(sums.values())}
    parts = parts.groupBy("_p", key.alias("_k")).agg(F.count("*").alias("_n"), *[F.sum(c).alias(n) for n, c in names.items()])
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(F.col("_p").alias("_ep"), "_k", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_c{c}") for c in ["_n", *names]])
    own = Window.partitionBy("_p", *keys).orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(carry), (F.col("_p") == F.col("_ep")) & key.eqNullSafe(F.col("_k")), "left")
    added = {new: F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(upto), F.lit(0)) + F.coalesce(f"_c{n}", F.lit(0)) for (n, c), new in zip(names.items(), sums)}
    if position:
        added[position] = (F.row_number().over(own) + F.coalesce("_c_n", F.lit(0))).cast("long")
    return out.withColumns(added).drop("_p", "_ep", "_k", *[f"_c{c}" for c in ["_n", *names]])


def ranked(df: DataFrame, column: str, sums: Sequence[str] = (), *, descending: bool = True) -> DataFrame:
    """RANK, DENSE_RANK and running sums (ties share them) over the whole table: adds rank, dense_rank and cum_<name>.

    Rows are reduced to one for each value before they are ordered, so that a value that a third
    of all rows have costs one row; values are range-partitioned, each task runs over its own,
    and what lies before it comes from one row a partition. A null value ranks first descending,
    last ascending.
    """
    order = F.col("_v").desc_nulls_first() if descending else F.col("_v").asc_nulls_last()
    values = df.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{c}") for c in sums])
    placed = cut(values.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    parts = placed.groupBy("_p").agg(F.sum("_n").alias("_pn"), F.count("*").alias("_pd"), *[F.sum(f"_{c}").alias(f"_p{c}") for c in sums])
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_p", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_s{c}") for c in ["_pn", "_pd", *[f"_p{x}" for x in sums]]])
    own = Window.partitionBy("_p").orderBy(order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(parts), "_p").select(
        "_v", (F.sum("_n").over(upto) - F.col("_n") + F.col("_s_pn") + 1).alias("rank"), (F.row_number().over(own) + F.col("_s_pd")).cast("long").alias("dense_rank"),
        *[(F.sum(f"_{c}").over(upto) + F.col(f"_s_p{c}")).alias(f"cum_{c}") for c in sums],
    )
    return df.join(out, F.col(column).eqNullSafe(F.col("_v"))).drop("_v")


def sampled(df: DataFrame, keys: Sequence[str], percent: float, seed: int) -> DataFrame:
    """SAMPLE (percent) SEED (seed): the rows whose keys hash below the bound; rows with equal keys come or go together (SAMPLE BLOCK).

    The choice hangs on keys and seed alone: it is the same on every run, partitioning and retry.
    Null keys hash as empty text. 0 percent gives none, 100 all.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    place = F.conv(F.substring(F.md5(F.concat(text, F.lit(f"#{seed}"))), 1, 8), 16, 10).cast("long")
    return df.where(place < F.lit(percent / 100 * 2**32))


def multiset(kind: str, a: DataFrame, b: DataFrame, *, distinct: bool = False) -> DataFrame:
    """MULTISET EXCEPT, INTERSECT or UNION [ALL|DISTINCT]: bags unless ``distinct``."""
    bag = {"except": DataFrame.exceptAll, "intersect": DataFrame.intersectAll, "union": DataFrame.unionByName}[kind]
    if not distinct:
        return bag(a, b)
    return {"except": DataFrame.subtract, "intersect": DataFrame.intersect, "union": lambda x, y: x.unionByName(y).distinct()}[kind](a, b)


def is_submultiset(inner: Column, outer: Column) -> Column:
    """SUBMULTISET OF for arrays: every element of ``inner`` occurs in ``outer`` at least as often."""
    times = lambda a, x: F.size(F.filter(a, lambda y: y.eqNullSafe(x)))
    return F.forall(F.array_distinct(inner), lambda x: times(inner, x) <= times(outer, x))


def quantified(df: DataFrame, value: Column, op: str, kind: str, subquery: DataFrame) -> DataFrame:
    """Rows for which ``value op ANY|ALL (subquery of one column)`` holds.

    Comparisons reduce to the smallest and largest value and the presence of nulls, scalar
    subqueries of one row; equality to a semi or anti join.
    """
    (c,) = subquery.columns
    q = subquery.select(F.col(c).alias("_q"))
    if (op, kind) == ("=", "ANY"):
        return df.join(q, value == F.col("_q"), "left_semi")
    count, known = q.agg(F.count("*")).scalar(), q.agg(F.count("_q")).scalar()
    if (op, kind) == ("<>", "ALL"):
        return df.join(q.dropna(), value == F.col("_q"), "left_anti").where((count == 0) | ((count == known) & value.isNotNull()))
    if (op, kind) not in {(x, y) for x in ("<", "<=", ">", ">=") for y in ("ANY", "ALL")}:
        raise NotImplementedError(f"{op} {kind}")
    edge = q.agg((F.max if (op in {">", ">="}) == (kind == "ALL") else F.min)("_q")).scalar()
    holds = {"<": value < edge, "<=": value <= edge, ">": value > edge, ">=": value >= edge}[op]
    return df.where((holds & (count == known)) | (count == 0) if kind == "ALL" else holds)


def dynamic_pivot(df: DataFrame, keys: Sequence[str], column: str, value: Column, *, prefix: str = "", none: str = "NONE", most: int = 10_000) -> DataFrame:
    """PIVOT over the values found in ``column``: a first pass reads them (at most ``most``, more raise)."""
    values = sorted(r[0] for r in df.select(column).distinct().dropna().limit(most + 1).collect())
    if len(values) > most:
        raise BizError("PIVOT_TOO_WIDE", f"more than {most} columns")
    if not values:
        return df.groupBy(*keys).agg(F.lit(0).alias(f"{prefix}{none}"))
    out = df.groupBy(*keys).pivot(column, values).agg(value)
    return out.select(*keys, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def pivot_xml(df: DataFrame, keys: Sequence[str], column: str, value: Column, *, name: str) -> DataFrame:
    """PIVOT XML: keys and xml, a PivotSet with one item for each value of ``column`` that the key has, in order.

    No list of values is read first. Signs that XML reserves are escaped; a null value is an empty
    column.
    """
    escaped = F.replace(F.replace(F.replace(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = df.groupBy(*keys, column).agg(value.cast("string").alias("_v"))
    item = F.concat(F.lit(f'<item><column name="{column.upper()}">'), escaped, F.lit(f'</column><column name="{name.upper()}">'), F.coalesce("_v", F.lit("")), F.lit("</column></item>"))
    items = F.transform(F.sort_array(F.collect_list(F.struct(F.col(column).alias("c"), item.alias("x")))), lambda r: r["x"])
    return cells.groupBy(*keys).agg(F.concat(F.lit("<PivotSet>"), F.array_join(items, ""), F.lit("</PivotSet>")).alias("xml"))


def hypothetical(df: DataFrame, keys: Sequence[str], column: str, value: float) -> DataFrame:
    """RANK, DENSE_RANK, PERCENT_RANK and CUME_DIST of a value WITHIN GROUP (ORDER BY column), as plain aggregates."""
    x, v = F.col(column), F.lit(value)
    below, n = F.count(F.when(x < v, 1)), F.count("*")
    return df.groupBy(*keys).agg(
        (below + 1).alias("rank"), (F.count_distinct(F.when(x < v, x)) + 1).alias("dense_rank"), (below / n).alias("percent_rank"), ((F.count(F.when(x <= v, 1)) + 1) / (n + 1)).alias("cume_dist")
    )


def fifo_take(lots: DataFrame, needs: DataFrame, keys: Sequence[str], order: Sequence[str], available: str, needed: str) -> DataFrame:
    """FIFO issue without a cursor: what each lot gives to its key's need.

    take = greatest(0, least(available, need - what earlier lots hold)). Lots that give nothing
    are left out. Returns the lots with cum_available and take. ``order`` is unique within a
    key; sums run by ``running``, so that a hot key is not one task. Lots with a null key take
    nothing, a null quantity counts as 0.
    """
    cum = running(lots, keys, order, {"cum_available": available})
    have = F.coalesce(F.col(available), F.lit(0))
    take = F.greatest(F.lit(0).cast("decimal(18,4)"), F.least(have, F.col(needed) - (F.col("cum_available") - have)))
    return cum.join(needs, list(keys)).withColumn("take", take).where("take > 0")
