"""Reading and writing listing files: JSON lines, CSV, Parquet."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens import fixed_values as fv
from adlens.schemas import LISTING, RAW_LISTING, conform

POSITION = "_position"


def _file_order(paths: list[str]) -> Column:
    """Rank of the input path a row came from, so that files keep the order they were named in."""
    bare = r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?"
    name = F.concat(F.regexp_replace(F.col("_metadata.file_path"), bare, ""), F.lit("/"))
    order = F.lit(len(paths))
    for i, path in reversed(list(enumerate(paths))):
        named = re.sub(bare, "", path) if re.match(bare, path) else os.path.abspath(path)
        # a whole path, or a whole folder of it
        order = F.when(F.startswith(name, F.lit(named.rstrip("/") + "/")), F.lit(i)).otherwise(order)
    return order


def _position(paths: list[str]) -> Column:
    """Place of a row in the input: file, block, then row within its task.

    Rows of one file block are read in order by one task, so the row number inside the
    task orders them; a repeated task reads the same blocks again.
    """
    return F.struct(
        _file_order(paths).alias("file"),
        F.col("_metadata.file_path").alias("name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_jsonl(spark: SparkSession, paths: str | list[str], normalized: bool = False) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, a broken line is an error."""
    names = [paths] if isinstance(paths, str) else list(paths)
    schema = LISTING if normalized else RAW_LISTING
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(names)
    return rows.withColumn(POSITION, _position(names))


def holds_normalized(spark: SparkSession, paths: str | list[str]) -> bool:
    """Whether the first row of the input already has a listing key."""
    names = [paths] if isinstance(paths, str) else list(paths)
    for name in names:
        first = spark.read.text(name).where(F.trim("value") != "").head(1)
        if first:
            return '"source_listing_key"' in first[0].value
    return False


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All JSON lines files of a folder; empty files hold no rows."""
    rows = spark.read.schema(RAW_LISTING).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").json(folder)
    return rows.withColumn(POSITION, _position([folder]))


def read_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Exported listings; columns are matched by the header, missing ones become NULL."""
    names = [paths] if isinstance(paths, str) else list(paths)
    # every path has a header of its own; files of one folder must agree
    tables = [_read_csv(spark, name, names) for name in names]
    return reduce(DataFrame.unionByName, tables)


def _read_csv(spark: SparkSession, name: str, names: list[str]) -> DataFrame:
    options = {"header": True, "enforceSchema": False, "multiLine": True, "quote": '"', "escape": '"', "mode": "FAILFAST"}
    # the header decides which columns exist; it is the only line read here
    header = spark.read.options(**options).csv(name).columns
    as_text = spark.read.options(**options).schema(", ".join(f"`{c}` string" for c in header)).csv(name)
    typed = as_text.select(
        *[
            # pandas writes whole numbers of a column with gaps as 2015.0
            (F.col(f.name).try_cast("double").cast("bigint") if f.dataType.typeName() == "long" else F.col(f.name).cast(f.dataType)).alias(f.name)
            if f.name in header
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in LISTING.fields
        ],
        _position(names).alias(POSITION),
    )
    return typed


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """Raw rows are appended, normalised rows overwrite (``mode="overwrite"``)."""
    df.drop(POSITION).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    conform(df, LISTING).write.mode(mode).option("header", True).option("escape", '"').option(
        "encoding", "UTF-8"
    ).csv(path)


def write_listings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Primary form: Parquet by source, so that scans of one source prune the rest."""
    df.drop(POSITION).write.mode(mode).partitionBy("source").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def lookup_tables(spark: SparkSession, folder: str, listed: list[str] | None = None) -> list[tuple[str, DataFrame]]:
    """Tables to look a listing up in, in order of precedence.

    Named paths come in the given order; otherwise all JSON lines files of the folder come
    before all CSV files, each sorted by name. Paths that do not exist are skipped.
    """
    from adlens.operators.normalize import normalize

    site = fv.SITE_WITH_DETAIL_PAGES
    candidates = listed or [f"{folder}/{site}*.jsonl", f"{folder}/{site}*.csv"]
    tables = []
    for path in candidates:
        try:
            if path.endswith(".jsonl"):
                rows = read_jsonl(spark, path).where(F.col("source") == site)
                rows = normalize(rows, keep=[POSITION]).drop("raw")
            elif path.endswith(".csv"):
                rows = read_csv(spark, path)
            else:
                continue
        except AnalysisException:
            continue
        tables.append((path, rows))
    return tables
