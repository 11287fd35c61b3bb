"""Joins against tables that may be small: broadcast only after their size in bytes has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 32 << 20
#: How far an estimate may be wrong.
_MARGIN = 16
#: Rows that a measurement reads at most.
_ROWS = 200_000


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` bytes, else as it is (a shuffled join).

    The optimizer's estimate decides without a job where it is far below (files may be packed
    and texts longer than it assumes); else the rows are measured, by one pass that stops early.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) * _MARGIN <= most:
        return F.broadcast(df)
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, total = df.limit(_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= _ROWS and total <= most else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that takes far longer than a shuffle.

    A table of fewer files than cores is dealt out again; any other stays as it is read, and so
    does what comes out of a shuffle.
    """
    execution = df._jdf.queryExecution()
    if "Exchange" in execution.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if execution.toRdd().getNumPartitions() < cores else df
