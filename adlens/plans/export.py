"""Raw files to the model-ready table, with its report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adlens.operators import dedupe
from adlens.operators.normalize import as_listings, is_normalized, normalize
from adlens.schemas import LISTING_COLUMNS
from adlens.sources import listings as files
from adlens.sources.snapshots import publish


def prepare_listings(rows: DataFrame, position: str = files.POSITION, fuzzy: bool = False) -> tuple[DataFrame, DataFrame]:
    """Listings and their one-row report; already normalised input passes unchanged."""
    if is_normalized(rows):
        listings = as_listings(rows)
        return listings, dedupe.report_without_dedupe(listings)
    kept = dedupe.deduplicate(normalize(rows, keep=[position]), position, fuzzy)
    return kept.select(*LISTING_COLUMNS), dedupe.dedupe_report(kept)


def export(spark: SparkSession, inputs: list[str], output: str, report: str | None = None, fuzzy: bool = False) -> None:
    """Read raw files, normalise, de-duplicate, write CSV and Parquet and the report.

    The kept rows are written once; the report is computed from what was written.
    """
    rows = files.read_jsonl(spark, inputs, normalized=files.holds_normalized(spark, inputs))
    if is_normalized(rows):
        listings, summary = prepare_listings(rows)
        files.write_csv(listings, output)
    else:
        kept = dedupe.deduplicate(normalize(rows, keep=[files.POSITION]), files.POSITION, fuzzy)
        stored = f"{output}.parquet"
        kept.drop(files.POSITION, dedupe.FIRST_SEEN).write.mode("overwrite").partitionBy("source").parquet(stored)
        back = spark.read.parquet(stored)
        files.write_csv(back, output)
        summary = dedupe.dedupe_report(back)
    if report:
        files.write_report(summary, report)


def refresh_comparables(spark: SparkSession, inputs: list[str], table: str, stamp: str) -> str:
    """New version of the comparison pool; the current one changes only after success."""
    rows = files.read_jsonl(spark, inputs)
    kept, _ = prepare_listings(rows, fuzzy=True)
    return publish(kept, table, f"snapshot={stamp}")
