"""Enterprise SQL text to Spark SQL text."""

from tamarack.dialect.translate import run, translate

__all__ = ["run", "translate"]
