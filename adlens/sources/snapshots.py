"""Versioned tables: write a version, then name it in the pointer table.

Readers follow the pointer, so they never see a half-written version.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTER = "version string, format string"


def publish(df: DataFrame, table: str, version: str, fmt: str = "parquet") -> str:
    """Write ``table/version`` and, only after that succeeded, point to it."""
    target = f"{table}/{version}"
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(target)
    pointer = df.sparkSession.createDataFrame([(version, fmt)], POINTER).coalesce(1)
    pointer.write.mode("append").json(f"{table}/pointers")
    return target


def _newest(spark: SparkSession, table: str, before: str | None = None):
    try:
        pointers = spark.read.schema(POINTER).json(f"{table}/pointers")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if before is not None:
        pointers = pointers.where(F.col("version") < before)
    return pointers.agg(F.max_by(F.struct("version", "format"), "version").alias("p")).first().p


def current_version(spark: SparkSession, table: str, before: str | None = None) -> str | None:
    """Folder of the greatest published version (smaller than ``before`` if given)."""
    newest = _newest(spark, table, before)
    return f"{table}/{newest.version}" if newest else None


def read_current(spark: SparkSession, table: str, schema: T.StructType | None = None) -> DataFrame:
    """The published version in the format it was written in; texts only where CSV is read without a schema."""
    newest = _newest(spark, table)
    if newest is None:
        raise FileNotFoundError(f"no published version in {table}")
    reader = spark.read.format(newest.format or "parquet")
    if newest.format == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(f"{table}/{newest.version}")
