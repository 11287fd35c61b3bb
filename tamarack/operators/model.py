"""MODEL: spreadsheet recurrences over a dimension, by partition."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iterate(cells: DataFrame, partition: Sequence[str], dimension: str, measure: str, *, anchor: int, window: int, ahead: int, rule: Callable[[Callable[[int], Column]], Column], digits: int = 4) -> DataFrame:
    """MODEL PARTITION BY (partition) DIMENSION BY (dimension) MEASURES (measure) RULES ITERATE (ahead).

    Each iteration makes the cell at anchor + 1, anchor + 2, ...; ``rule`` gets a function that
    returns the cell so many steps before the new one (1 to ``window``), made cells included.
    Missing and null cells are 0. Returns the partition, dimension and measure (rounded) of the
    new cells.

    The last ``window`` cells are an array of fixed length, made by sums with map-side combine,
    and the recurrence is a fold over 1..ahead: one aggregate, no loop of jobs, no Python.
    """
    at = F.col(dimension) - F.lit(anchor - window)
    base = cells.groupBy(*partition).agg(*[F.sum(F.when(at == i, F.coalesce(F.col(measure).cast("double"), F.lit(0.0))).otherwise(0.0)).alias(f"_c{i}") for i in range(1, window + 1)])
    start = F.array(*[F.col(f"_c{i}") for i in range(1, window + 1)])
    made = F.aggregate(F.sequence(F.lit(1), F.lit(ahead)), start, lambda acc, _: F.concat(acc, F.array(rule(lambda back: F.element_at(acc, -F.lit(back))))))
    out = base.select(*partition, F.posexplode(F.slice(made, window + 1, ahead)).alias("_i", "_v"))
    return out.select(*partition, (F.col("_i") + F.lit(anchor + 1)).cast("int").alias(dimension), F.round("_v", digits).alias(measure))


def moving_average(window: int) -> Callable[[Callable[[int], Column]], Column]:
    """The mean of the last ``window`` cells, at least 0."""

    def rule(cell: Callable[[int], Column]) -> Column:
        total = cell(1)
        for i in range(2, window + 1):
            total = total + cell(i)
        return F.greatest(total / F.lit(float(window)), F.lit(0.0))

    return rule


def trend(window: int) -> Callable[[Callable[[int], Column]], Column]:
    """The last cell and its mean change over ``window`` steps, at least 0; needs ``window`` + 1 cells."""
    return lambda cell: F.greatest(cell(1) + (cell(1) - cell(window + 1)) / F.lit(float(window)), F.lit(0.0))


class Rule:
    """A rule of ``model``: ``measure`` of the cells at ``targets`` becomes ``value``.

    ``targets`` gets the iteration (from 0) and returns one place, or an array of places, which
    are made in order (FOR n FROM a TO b). ``value`` gets the iteration, the place (CV()) and a
    function cell(measure, place), which gives null where there is none, and returns a double.
    With ``upsert`` off only cells that are there are changed (UPDATE).
    """

    def __init__(self, measure: str, targets: Callable[[Column], Column], value: Callable, *, many: bool = False, upsert: bool = True) -> None:
        self.measure, self.targets, self.value, self.many, self.upsert = measure, targets, value, many, upsert


def model(
    cells: DataFrame,
    partition: Sequence[str],
    dimension: str,
    measures: Sequence[str],
    rules: Sequence[Rule],
    *,
    iterations: int = 1,
    until: Callable[[Column, Callable], Column] | None = None,
    keep_nav: bool = True,
    between: tuple[int, int] | None = None,
) -> DataFrame:
    """MODEL PARTITION BY DIMENSION BY MEASURES RULES [UPSERT|UPDATE] [ITERATE (n) [UNTIL (condition)]].

    Returns partition, dimension and measures of all cells, old and made. Rules run one after the
    other, each sees what the ones before made, in every iteration; ``until`` is looked at after
    an iteration. Without ``keep_nav`` missing and null cells count as 0 (IGNORE NAV).

    A partition's cells are one map a measure, folded by its rules: no loop of jobs, no Python. A
    partition is a row, so that rules that need only some cells should say ``between`` which
    places; then nothing else is read into the map or returned. A place that occurs twice in a
    partition raises, as MODEL does. Null places are left out; a partition without any other is there, but has no cells.
    """
    place = F.col(dimension).cast("long")
    wanted = place.isNotNull() & place.between(*between) if between else place.isNotNull()
    cell_ = F.struct(place.alias("n"), *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(measures)])
    rows = cells.groupBy(*partition).agg(F.sort_array(F.collect_list(F.when(wanted, cell_))).alias("_cells"))
    names = [f"m{i}" for i in range(len(measures))]
    places = F.col("_cells")["n"]
    start = F.struct(*[F.map_from_arrays(places, F.col("_cells")[n]).alias(n) for n in names], F.lit(False).alias("done"))

    def cell_of(state: Column) -> Callable:
        def cell(measure: str, at: Column) -> Column:
            found = F.try_element_at(state[names[list(measures).index(measure)]], at.cast("long"))
            return found if keep_nav else F.coalesce(found, F.lit(0.0))

        return cell

    def put(state: Column, rule: Rule, step: Column, at: Column) -> Column:
        own = names[list(measures).index(rule.measure)]
        at = at.cast("long")
        there = F.map_contains_key(state[own], at)
        value = rule.value(step, at, cell_of(state)).cast("double")
        changed = F.map_concat(F.map_filter(state[own], lambda k, v: k != at), F.map_from_arrays(F.array(at), F.array(value)))
        made = {n: F.when(there, changed).otherwise(state[n]) if n == own and not rule.upsert else changed if n == own else state[n] for n in names}
        if rule.upsert:
            empty = F.map_from_arrays(F.array(at), F.array(F.lit(None).cast("double")))
            for n in names:
                if n != own:
                    made[n] = F.when(F.map_contains_key(state[n], at), state[n]).otherwise(F.map_concat(state[n], empty))
        return F.struct(*[made[n].alias(n) for n in names], state["done"].alias("done"))

    def into(rule: Rule, step: Column) -> Callable[[Column, Column], Column]:
        return lambda acc, at: put(acc, rule, step, at)

    def iteration(state: Column, step: Column) -> Column:
        out = state
        for rule in rules:
            to = rule.targets(step)
            to = to.cast("array<bigint>") if rule.many else F.array(to.cast("long"))
            out = F.aggregate(to, out, into(rule, step))
        done = until(step, cell_of(out)) if until else F.lit(False)
        return F.when(state["done"], state).otherwise(F.struct(*[out[n].alias(n) for n in names], F.coalesce(done, F.lit(False)).alias("done")))

    folded = rows.select(*partition, F.aggregate(F.sequence(F.lit(0), F.lit(iterations - 1)), start, iteration).alias("_s"))
    made = folded.select(*partition, "_s", F.explode(F.map_keys(F.col("_s")["m0"])).alias("_n"))
    return made.select(*partition, F.col("_n").alias(dimension), *[F.col("_s")[n][F.col("_n")].alias(m) for n, m in zip(names, measures, strict=True)])
