"""Continuous periods and gaps of overlapping, nested and gapped intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: 9999-12-31 as days since 1970-01-01, the end of an open interval.
OPEN_END = 2_932_896


def periods_and_gaps(records: DataFrame, *, entity: Sequence[str], record_id: str, date_from: str, date_to: str) -> DataFrame:
    """Covered periods and the holes between them, by entity.

    Returns ``entity``, kind ('period' or 'gap'), first_day and last_day (both included, as
    days since 1970-01-01) and n_records (of a gap 0).

    Sweep line: every record is +1 on its first day and -1 after its last; the events are summed
    by entity and day before they are shuffled, and the prefix sum over an entity's days is the
    number of open records. Periods that touch without an uncovered day are one. A window sees
    at most one row for each day of the calendar, however many records an entity has.

    Both ends belong to a record; a null end is 9999-12-31. Records that end before they start
    and records with a null id, entity or start are left out. Rows with the same id count once.
    Empty input gives an empty result; other columns are ignored.
    """
    keys = [f"_e{i}" for i in range(len(entity))]
    once = (
        records.select(
            *[F.col(c).alias(k) for c, k in zip(entity, keys, strict=True)],
            F.col(record_id).alias("_id"),
            F.unix_date(F.col(date_from).cast("date")).alias("_from"),
            F.coalesce(F.unix_date(F.col(date_to).cast("date")), F.lit(OPEN_END)).alias("_to"),
        )
        .dropna(subset=[*keys, "_id", "_from"])
        .where("_from <= _to")
        .distinct()
    )
    change = (
        once.select(*keys, F.explode(F.array(F.struct(F.col("_from").alias("day"), F.lit(1).alias("change")), F.struct((F.col("_to") + 1).alias("day"), F.lit(-1).alias("change")))).alias("_c"))
        .groupBy(*keys, F.col("_c.day").alias("day"))
        .agg(F.sum("_c.change").alias("change"), F.sum((F.col("_c.change") == 1).cast("long")).alias("starts"))
    )
    days = Window.partitionBy(*keys).orderBy("day")
    so_far = days.rowsBetween(Window.unboundedPreceding, 0)
    open_ = change.withColumn("open", F.sum("change").over(so_far)).withColumn("begun", F.sum("starts").over(so_far))
    # Only the days on which the count leaves or reaches zero matter from here on: they alternate.
    edge = (
        open_.withColumn("before", F.col("open") - F.col("change"))
        .where("(before = 0) != (open = 0)")
        .withColumn("next_day", F.lead("day").over(days))
        .withColumn("next_begun", F.lead("begun").over(days))
    )
    rows = F.when(
        F.col("open") > 0,
        F.struct(F.lit("period").alias("kind"), F.col("day").alias("first_day"), (F.col("next_day") - 1).alias("last_day"), (F.col("next_begun") - F.col("begun") + F.col("starts")).alias("n_records")),
    ).otherwise(F.struct(F.lit("gap").alias("kind"), F.col("day").alias("first_day"), (F.col("next_day") - 1).alias("last_day"), F.lit(0).cast("long").alias("n_records")))
    return edge.where("next_day is not null").select(*[F.col(k).alias(c) for c, k in zip(entity, keys, strict=True)], rows.alias("_r")).select(*entity, "_r.*")
