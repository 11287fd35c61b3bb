"""Readers and writers: external tables, snapshots, partitioned ledgers, source trees, database connections."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def external_table(spark: SparkSession, path: str, schema: str | StructType, *, kind: str = "csv", delimiter: str = ",", header: bool = False, skip_bad: bool = True) -> DataFrame:
    """An external table: files with a declared schema, delimited, parquet, orc or json.

    Fields that don't fit the schema are null; with ``skip_bad`` rows that can't be read at all
    are left out (REJECT LIMIT UNLIMITED), else the first one raises when it is read.
    """
    reader = spark.read.schema(schema)
    if kind == "csv":
        reader = reader.options(sep=delimiter, header=header, mode="DROPMALFORMED" if skip_bad else "FAILFAST")
    return reader.format(kind).load(path)


def write_partitioned(df: DataFrame, path: str, column: str, *, by: str = "quarter") -> None:
    """A ledger written by quarter or month of a date column, so that readers prune by partition."""
    part = F.concat(F.year(column), F.lit("Q"), F.quarter(column)) if by == "quarter" else F.date_format(column, "yyyyMM")
    df.withColumn(f"_{by}", part).repartition(f"_{by}").write.mode("overwrite").partitionBy(f"_{by}").parquet(path)


def read_partition(spark: SparkSession, path: str, value: str, *, by: str = "quarter") -> DataFrame:
    """A partition-extended table name: one partition of such a ledger; only its files are read."""
    return spark.read.parquet(path).where(F.col(f"_{by}") == value).drop(f"_{by}")


def publish(df: DataFrame, path: str) -> None:
    """Writes ``df`` as parquet in the place of ``path``: aside first, then by renaming.

    A write that fails, or is lost with an executor, leaves the old files as they are; ``df`` may
    itself read them.
    """
    spark, aside = df.sparkSession, f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    hadoop = spark._jvm.org.apache.hadoop.fs
    new, old = hadoop.Path(aside), hadoop.Path(path)
    system = old.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(old, True)
    if not system.rename(new, old):
        raise OSError(f"{aside} could not be renamed to {path}")


def write_snapshot(df: DataFrame, path: str, version: int) -> None:
    """A version of a table beside its other versions, published whole or not at all."""
    df.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).mkdirs(df.sparkSession._jvm.org.apache.hadoop.fs.Path(path))
    publish(df, f"{path}/_snapshot={version}")


def as_of(spark: SparkSession, path: str, version: int) -> DataFrame:
    """AS OF: the table as of a version, the latest one not after it."""
    versions = spark.read.parquet(path).select("_snapshot").where(F.col("_snapshot") <= version).agg(F.max("_snapshot")).first()[0]
    df = spark.read.parquet(path)
    return df.where(F.col("_snapshot") == F.lit(versions)).drop("_snapshot")


def versions_between(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """VERSIONS BETWEEN: the rows of all versions of a range, with _snapshot."""
    return spark.read.parquet(path).where(F.col("_snapshot").between(first, last))


def refresh(df: DataFrame, path: str) -> DataFrame:
    """CREATE TABLE AS SELECT, or the refresh of a materialized view: the stored result."""
    publish(df, path)
    return df.sparkSession.read.parquet(path)


def source_tree(spark: SparkSession, path: str) -> DataFrame:
    """Source files (.sql, .pks, .pkb, .pls) below a folder, whole: file_path, source_text."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{sql,pks,pkb,pls}").text(path)
    return files.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("source_text"))


_URL = re.compile(r"^jdbc:(postgresql|opengauss|gaussdb)://([^:/?]+)(?::(\d+))?/([^?]+)(?:\?(.*))?$", re.I)


def parse_jdbc_url(url: str) -> dict[str, str | int]:
    """kind, host, port (5432 by default), database and the parameters of a database URL; other URLs raise ValueError."""
    found = _URL.match(url.strip())
    if not found:
        raise ValueError(f"not a database URL: {url}")
    kind, host, port, database, rest = found.groups()
    pairs = dict(p.split("=", 1) for p in (rest or "").split("&") if "=" in p)
    return {"kind": kind.lower(), "host": host, "port": int(port or 5432), "database": database} | pairs


def database_table(spark: SparkSession, url: str, name: str, *, key: str | None = None, parts: int = 16, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """A table behind a database link, read in ``parts`` ranges of ``key`` at once if its bounds are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def catalog(spark: SparkSession, url: str, *, schema_like: str = "%", table_like: str = "%", **options: str) -> DataFrame:
    """Columns of a database's tables and views from its information schema: table_schema, table_name, column_name, data_type, is_nullable, position."""
    quote = lambda x: x.replace("'", "''")
    query = (
        "SELECT table_schema, table_name, column_name, data_type, is_nullable, ordinal_position AS position FROM information_schema.columns "
        f"WHERE table_schema LIKE '{quote(schema_like)}' AND table_name LIKE '{quote(table_like)}'"
    )
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()
