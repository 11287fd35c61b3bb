"""tamarack: a PySpark-native engine for enterprise-SQL analytics and data preparation."""

__version__ = "0.1.0"
