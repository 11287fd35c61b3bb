"""What packages keep as state elsewhere: an immutable context, typed parameters, errors and their log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import singledispatch
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tamarack.operators.relational import BizError

LOG_SCHEMA = "error_code string, error_level string, module_name string, procedure_name string, error_msg string, biz_key string, operator string, occurred_at timestamp"
#: Longest message that the log keeps.
_MESSAGE = 2000
#: Number of an error without a number of its own.
_OTHER = -20999


@dataclass(frozen=True)
class EngineContext:
    """The business date, operator, parameters, error numbers and flags that a run is made under."""

    as_of: dt.date
    operator: str = "system"
    params: Mapping[str, str] = field(default_factory=dict)
    numbers: Mapping[str, int] = field(default_factory=dict)
    flags: Mapping[str, bool] = field(default_factory=dict)

    def text(self, key: str, default: str | None = None) -> str | None:
        return self.params.get(key, default)

    def number(self, key: str, default: float | None = None) -> float | None:
        """The parameter as a number; the default where it is missing or no number."""
        try:
            return float(self.params[key])
        except (KeyError, ValueError):
            return default

    def day(self, key: str, default: dt.date | None = None) -> dt.date | None:
        """The parameter as a date (YYYY-MM-DD); the default where it is missing or no date."""
        try:
            return dt.date.fromisoformat(self.params[key])
        except (KeyError, ValueError):
            return default

    def error_number(self, error: BizError) -> int:
        return self.numbers.get(error.code, _OTHER)

    def on(self, flag: str, then: Callable[[], Any], otherwise: Callable[[], Any] = lambda: None) -> Any:  # noqa: ANN401
        """Conditional compilation: one of two branches by a flag."""
        return (then if self.flags.get(flag, False) else otherwise)()


def document_number(prefix: str, day: Column, sequence: Column) -> Column:
    """Prefix, day as YYYYMMDD and the last six digits of a sequence number."""
    return F.concat(F.lit(prefix), F.date_format(day, "yyyyMMdd"), F.lpad((sequence % 1_000_000).cast("string"), 6, "0"))


def log_rows(spark: SparkSession, context: EngineContext, errors: list[tuple[BizError, str, str, str | None]], at: dt.datetime) -> DataFrame:
    """Log rows of errors with module, procedure and business key, to be appended apart from the data (an autonomous transaction)."""
    return spark.createDataFrame([(e.code, "ERROR", module, procedure, str(e)[:_MESSAGE], key, context.operator, at) for e, module, procedure, key in errors], LOG_SCHEMA)


def logged(rejects: DataFrame, context: EngineContext, *, code: Column, message: Column, key: Column, module: str, procedure: str, at: dt.datetime) -> DataFrame:
    """Log rows of rejected rows, as many as there are, in the columns of LOG_SCHEMA; messages are cut as in ``log_rows``."""
    return rejects.select(
        code.alias("error_code"), F.lit("ERROR").alias("error_level"), F.lit(module).alias("module_name"), F.lit(procedure).alias("procedure_name"),
        F.substring(message, 1, _MESSAGE).alias("error_msg"), key.alias("biz_key"), F.lit(context.operator).alias("operator"), F.lit(at).cast("timestamp").alias("occurred_at"),
    )


def counted(df: DataFrame, name: str = "rowcount") -> tuple[DataFrame, Observation]:
    """SQL%ROWCOUNT: the frame, and what counts its rows while it is written."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def checked(df: DataFrame, predicate: Column, name: str) -> DataFrame:
    """WITH CHECK OPTION: rows that break the view's predicate raise when they are written."""
    return df.where(F.when(F.coalesce(predicate, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"a row breaks the check of {name}")).cast("boolean")))


def view_writer(columns: Mapping[str, str]) -> Callable[[DataFrame], DataFrame]:
    """INSTEAD OF: turns rows of a view into rows of its base table; ``columns`` maps view to base columns."""
    return lambda rows: rows.select(*[F.col(v).alias(b) for v, b in columns.items()])


@singledispatch
def to_text(value: Any) -> str:  # noqa: ANN401
    """One name for several types: how a value is written."""
    return str(value)


@to_text.register
def _(value: dt.date) -> str:
    return value.strftime("%Y-%m-%d")


@to_text.register
def _(value: float) -> str:
    return f"{value:,.2f}"
