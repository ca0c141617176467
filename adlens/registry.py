"""Names of all sample jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from adlens.plans import sample_jobs, sample_models, sample_pages, sample_streams

# the wide row-local steps compile to methods that are too large to be optimised at run time
RUNTIME_SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.codegen.hugeMethodLimit": "8000"}


def _prepared(job: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        for key, value in RUNTIME_SETTINGS.items():
            spark.conf.set(key, value)
        return job(spark, folder)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    jobs = [*sample_jobs.JOBS, *sample_pages.JOBS, *sample_streams.JOBS, *sample_models.JOBS]
    return {job.__name__: _prepared(job) for job in jobs}
