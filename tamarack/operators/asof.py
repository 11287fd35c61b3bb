"""Attributes as known at event time: an interval join over dyadic time nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of the time axis: 2**_BITS days, of which every date of the years 1 to 9999 is one.
_BITS = 23
#: Days from the first day of the axis to 1970-01-01. 2050-01-01 is its middle, so that an interval of our times without an end
#: is cut into few nodes: those up to the middle, and the second half as one.
_SHIFT = (1 << 22) - 29_220


def day_number(date: Column) -> Column:
    """Non-negative day number of a date or timestamp."""
    return F.unix_date(date.cast("date")) + F.lit(_SHIFT)


#: Whether the cover of the days [_lo, _hi) has a node at height k right of its lower bound, or left of its upper one, and their places.
_LEFT = "shiftright(_lo + shiftleft(1, k) - 1, k)"
_RIGHT = "shiftright(_hi, k) - 1"
_HAS_LEFT = f"({_LEFT} <= {_RIGHT} and ({_LEFT} & 1) = 1)"
_HAS_RIGHT = f"({_LEFT} <= {_RIGHT} and ({_RIGHT} & 1) = 0)"


def _cover() -> Column:
    """The canonical dyadic nodes of the days [_lo, _hi), numbered as in a binary heap: the root is 1, the leaves follow 2**_BITS."""
    first = f"shiftleft(1, {_BITS} - k)"
    return F.expr(f"flatten(transform(sequence(0, {_BITS}), k -> filter(array(if({_HAS_LEFT}, {first} + {_LEFT}, null), if({_HAS_RIGHT}, {first} + {_RIGHT}, null)), n -> n is not null)))")


def _levels() -> Column:
    """The levels (0: the root) of these nodes, as bits."""
    return F.expr(f"aggregate(sequence(0, {_BITS}), 0, (m, k) -> m | if({_HAS_LEFT} or {_HAS_RIGHT}, shiftleft(1, {_BITS} - k), 0))")


def as_of_join(
    events: DataFrame,
    rules: DataFrame,
    *,
    event_id: str,
    keys: Sequence[tuple[str, str]],
    event_date: str,
    rule_id: str,
    valid_from: str,
    valid_to: str,
    known_from: str | None = None,
    payload: Sequence[str] = (),
) -> DataFrame:
    """For each event the rule that was valid and already known on the event's date.

    ``keys`` pairs event and rule columns. A rule is usable from the later of ``valid_from`` and
    the date of ``known_from`` through ``valid_to`` (that day included; null: open). Of several
    the one with the latest ``valid_from``, then the highest ``rule_id`` wins. Returns
    ``event_id``, ``rule_id`` and ``payload``, one row for each event that has a rule.

    Each usable interval is cut into canonical dyadic nodes of the time axis, and an event
    equi-joins all nodes that enclose its day, one for each level at which its key has any (a bit
    mask by key). Rules with the same interval, then rules on the same node are reduced to the
    winner before they meet events: a key holds at most one row for each node of the calendar,
    however many rules it has, and an event meets at most one rule a level. Both joins of events
    are plain shuffles on both sides, which adaptive execution can split where a key is hot.

    Nulls: events with a null id, key or date and rules with a null key, id, ``valid_from`` or
    ``known_from`` match nothing. Repeated events or rules change nothing. Rules that end before
    they start are never valid. Empty inputs give an empty result; other columns are ignored.
    """
    rule_keys = [F.col(r).alias(f"_k{i}") for i, (_, r) in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    start = day_number(F.col(valid_from))
    lo = F.when(F.col(known_from).isNotNull(), F.greatest(start, day_number(F.col(known_from)))) if known_from else start
    hi = F.when(F.col(valid_to).isNull(), F.lit(1 << _BITS)).otherwise(day_number(F.col(valid_to)) + 1)
    best = F.struct(start.alias("since"), F.col(rule_id).alias("rule"), *[F.col(c).alias(f"p{i}") for i, c in enumerate(payload)])
    usable = (
        rules.where(F.col(rule_id).isNotNull() & F.col(valid_from).isNotNull())
        .select(*rule_keys, lo.alias("_lo"), hi.alias("_hi"), best.alias("_best"))
        .where(F.col("_lo") < F.col("_hi"))
        .dropna(subset=names)
    )
    covers = usable.groupBy(*names, "_lo", "_hi").agg(F.max("_best").alias("_best")).repartition(*names)
    nodes = covers.select(*names, "_best", F.explode(_cover()).alias("node")).groupBy(*names, "node").agg(F.max("_best").alias("_best"))
    # A redundant key makes the join with events a shuffle of its own.
    twice = F.pmod(F.xxhash64(*names), F.lit(2)).alias("_r")
    levels = usable.groupBy(*names).agg(F.bit_or(_levels()).alias("_mask")).select(*names, twice, "_mask")
    asked = (
        events.where(F.col(event_id).isNotNull() & F.col(event_date).isNotNull())
        .select(F.col(event_id).alias("_event"), *[F.col(e).alias(f"_k{i}") for i, (e, _) in enumerate(keys)], day_number(F.col(event_date)).alias("_day"))
        .dropna(subset=names)
        .select("*", twice)
        .join(levels, [*names, "_r"])
    )
    enclosing = F.expr(f"transform(filter(sequence(0, {_BITS}), d -> (shiftright(_mask, d) & 1) = 1), d -> shiftleft(1, d) + shiftright(_day, {_BITS} - d))")
    found = asked.select("_event", *names, F.explode(enclosing).alias("node")).join(nodes, [*names, "node"]).groupBy("_event").agg(F.max("_best").alias("_best"))
    return found.select(
        F.col("_event").alias(event_id), F.col("_best.rule").alias(rule_id), *[F.col(f"_best.p{i}").alias(c) for i, c in enumerate(payload)]
    )
