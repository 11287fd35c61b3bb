"""Column functions with enterprise-SQL semantics."""
