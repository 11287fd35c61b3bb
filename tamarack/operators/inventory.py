"""Stock as new state: receipts with a moving average, issues first in first out, transfers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.operators.relational import fifo_take, running
from tamarack.session import cut

#: Receipts of a key that one fold takes at a time.
_BLOCK = 256


def issue(lots: DataFrame, needs: DataFrame, keys: Sequence[str], order: Sequence[str], *, available: str, needed: str) -> tuple[DataFrame, DataFrame]:
    """(issued, short): what each lot gives to its key's need, and the needs that stock does not cover, which issue nothing.

    issued holds keys, order and quantity of the lots that give, with the need, take, lot_left, status (CONSUMED or AVAILABLE),
    qty_before and qty_after (stock of the key around this issue). short holds keys,
    need and stock. Other columns are ignored. ``needs`` has one row a key; ``order`` is unique within a key. Hot keys are split
    (``running``). Lots with a null key give nothing; null quantities count as 0.
    """
    names = list(keys)
    have = F.coalesce(F.col(available), F.lit(0))
    stock = lots.groupBy(*names).agg(F.sum(have).alias("_stock"))
    asked = needs.select(*names, needed).join(stock, names, "left").withColumn("_stock", F.coalesce("_stock", F.lit(0).cast("decimal(18,4)")))
    took = fifo_take(lots.select(*names, *order, available), asked.where(F.col(needed) <= F.col("_stock")), names, order, available, needed)
    before = F.col("_stock") - (F.col("cum_available") - have)
    issued = took.withColumns({"lot_left": have - F.col("take"), "status": F.when(have == F.col("take"), "CONSUMED").otherwise("AVAILABLE"), "qty_before": before, "qty_after": before - F.col("take")})
    return issued.drop("_stock", "cum_available"), asked.where(F.col(needed) > F.col("_stock")).withColumnRenamed("_stock", "stock")


def transfers(moves: DataFrame, *, quantity: str, from_place: str, to_place: str, place: str) -> DataFrame:
    """Each transfer as two ledger rows: out of ``from_place`` with the quantity negative, into ``to_place``; other columns stay."""
    kind = moves.schema[quantity].dataType
    legs = F.array(F.struct(F.col(from_place).alias("p"), (-F.col(quantity)).cast(kind).alias("q")), F.struct(F.col(to_place).alias("p"), F.col(quantity).alias("q")))
    others = [c for c in moves.columns if c not in {quantity, from_place, to_place}]
    return moves.select(*others, F.explode(legs).alias("_l")).select(*others, F.col("_l.p").alias(place), F.col("_l.q").alias(quantity))


def receive(receipts: DataFrame, keys: Sequence[str], order: Sequence[str], *, quantity: str, cost: str, digits: int = 6) -> DataFrame:
    """Receipts with qty_after and avg_cost, the moving average cost after each: (q * avg + quantity * cost) / (q + quantity), rounded at each.

    The rounding makes each step depend on the one before, so that a key's receipts are folded in
    order. They are folded in blocks of at most 256: a round folds the next block of every key
    from the state that the round before left, so that no more than a block is ever held, however
    many receipts a key has. A key's first receipt sets the cost. ``order`` is unique within a
    key; null quantities and costs count as 0; where nothing is in stock the average stays. Null
    keys are keys of their own.
    """
    names = list(keys)
    key = F.struct(*[F.col(k) for k in names]).alias("_k")
    q, c = F.coalesce(F.col(quantity).cast("double"), F.lit(0.0)), F.coalesce(F.col(cost).cast("double"), F.lit(0.0))
    placed = cut(running(receipts, names, order, {"qty_after": quantity}, position="_n").withColumn("_block", F.expr(f"cast((_n - 1) div {_BLOCK} as int)")))
    rows = placed.select(key, "_n", "_block", q.alias("q"), c.alias("c"))
    last = rows.agg(F.max("_block")).first()[0]
    state, folded = None, None
    for block in range(0 if last is None else last + 1):
        items = rows.where(F.col("_block") == block).groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("_n", "q", "c"))).alias("_r"))
        if state is None:
            items = items.select("_k", "_r", F.lit(0.0).alias("_q"), F.lit(0.0).alias("_a"))
        else:
            items = items.alias("i").join(state.alias("s"), F.col("i._k").eqNullSafe(F.col("s._k"))).select("i._k", "_r", "_q", "_a")
        zero = F.struct(F.col("_q").alias("q"), F.col("_a").alias("a"), F.array().cast("array<struct<n:bigint,a:double>>").alias("out"))

        def step(acc, r):  # noqa: ANN001, ANN202
            total = acc["q"] + r["q"]
            mixed = F.round((acc["q"] * acc["a"] + r["q"] * r["c"]) / total, digits)
            a = F.when(r["_n"] == 1, r["c"]).when(total > 0, mixed).otherwise(acc["a"])
            return F.struct(total.alias("q"), a.alias("a"), F.concat(acc["out"], F.array(F.struct(r["_n"].alias("n"), a.alias("a")))).alias("out"))

        done = cut(items.select("_k", F.aggregate("_r", zero, step).alias("_f")))
        state = done.select("_k", F.col("_f.q").alias("_q"), F.col("_f.a").alias("_a"))
        part = done.select("_k", F.inline("_f.out").alias("_pn", "avg_cost"))
        folded = part if folded is None else folded.unionByName(part)
    if folded is None:
        return placed.drop("_n", "_block").withColumn("avg_cost", F.lit(None).cast("double"))
    return placed.withColumn("_k", key).alias("p").join(folded.alias("f"), F.col("p._k").eqNullSafe(F.col("f._k")) & (F.col("_n") == F.col("_pn"))).drop("_k", "_n", "_pn", "_block")
