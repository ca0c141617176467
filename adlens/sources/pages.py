"""Stored page copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens import fixed_values as fv


def page_file_name(path: str) -> str:
    return path.strip("/").replace("/", "__") + ".md"


def read_cached_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One row per readable page copy; copies of 1000 bytes or less are not usable."""
    docs = spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").text(folder)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "")
    path = F.replace(F.url_decode(name), F.lit("__"), F.lit("/"))
    return docs.where(F.col("_metadata.file_size") > fv.CACHED_PAGE_MIN_BYTES).select(
        path.alias("path"),
        F.col("value").alias("text"),
        F.concat(F.lit(fv.READER_PAGE), path).alias("reader_url"),
    )
