"""Changes between snapshots: what triggers and audit logs see."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], watched: Sequence[str]) -> DataFrame:
    """A row trigger with OLD and NEW: one row for each key and watched column whose value changed.

    Returns the keys, column, old_value and new_value (as text). As in a WHEN (old <> new)
    condition, a change from or to null is none. Keys of one side only give no row.
    """
    pairs = new.select(*keys, *[F.col(c).alias(f"n_{c}") for c in watched]).join(old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in watched]), list(keys))
    changes = F.array(*[F.when(F.col(f"o_{c}") != F.col(f"n_{c}"), F.struct(F.lit(c).alias("column"), F.col(f"o_{c}").cast("string").alias("old_value"), F.col(f"n_{c}").cast("string").alias("new_value"))) for c in watched])
    return pairs.select(*keys, F.inline(F.filter(changes, lambda x: x.isNotNull())))


def net_changes(rows: DataFrame, statement: Sequence[str], keys: Sequence[str], signed: str) -> DataFrame:
    """A compound trigger: one row for each statement and key with the net quantity and the number of rows; nets of 0 stay."""
    return rows.groupBy(*statement, *keys).agg(F.sum(F.col(signed).cast("decimal(18,4)")).alias("net"), F.count("*").alias("n_rows"))


def split_before(rows: DataFrame, column: str, day: str) -> tuple[DataFrame, DataFrame]:
    """Rows to keep and rows to archive (before ``day``), these with archive_month as yyyyMM to partition a write by. Null dates are kept."""
    old = F.coalesce(F.col(column) < F.lit(day).cast("date"), F.lit(False))
    return rows.where(~old), rows.where(old).withColumn("archive_month", F.date_format(column, "yyyyMM"))


def returning(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RETURNING INTO of an insert, update or delete: the rows that it touched, with action, and the new values (of deleted rows the old).

    Rows are compared by ``keys``, which are unique; a row whose values are all equal was not
    touched. Null keys match nothing: they count as inserted and deleted.
    """
    others = [c for c in new.columns if c not in keys]
    before = old.select(*keys, F.struct(*[F.col(c) for c in others]).alias("_old"))
    joined = new.select(*keys, F.struct(*[F.col(c) for c in others]).alias("_new")).join(before, list(keys), "full")
    action = F.when(F.col("_old").isNull(), "INSERT").when(F.col("_new").isNull(), "DELETE").when(~F.col("_old").eqNullSafe(F.col("_new")), "UPDATE")
    return joined.select(*keys, action.alias("action"), F.coalesce("_new", "_old").alias("_v")).where("action is not null").select(*keys, "action", "_v.*")
