"""Session helpers: table access and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_OWN_CHECKPOINTS: list[tempfile.TemporaryDirectory] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Only where neither that setting nor an
    earlier call has given one, and the session runs in one process (local runs, tests), a
    temporary folder is made; on a cluster, where executors would not share it, that raises.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        _OWN_CHECKPOINTS.append(tempfile.TemporaryDirectory(prefix="tamarack-checkpoint-"))
        named = _OWN_CHECKPOINTS[-1].name
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder; its lineage ends there.

    Constraints that the optimizer would carry over from the plan end too: over the rounds of a
    loop that builds paths they grow exponentially.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    name = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(name, before)
