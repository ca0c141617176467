"""Training table: target filter, range cleaning, quantile trim, derived features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens import fixed_values as fv
from adlens.functions.text import null_if_empty
from adlens.operators.quantiles import exact_quantiles

TARGET = "price_eur"


def with_target(listings: DataFrame) -> DataFrame:
    return listings.where(F.col(TARGET).isNotNull())


def plausible(current_year: int) -> Column:
    """Inclusive ranges; mileage, power and displacement may be missing, year may not."""
    c = F.col
    return (
        c(TARGET).between(*fv.PRICE_RANGE)
        & F.coalesce(c("year"), F.lit(0)).between(fv.FIRST_YEAR, current_year)
        & F.coalesce(c("mileage_km"), F.lit(0)).between(*fv.MILEAGE_RANGE)
        & (c("power_hp").isNull() | c("power_hp").between(*fv.POWER_RANGE))
        & (c("engine_capacity_cm3").isNull() | c("engine_capacity_cm3").between(*fv.ENGINE_RANGE))
    )


def trim_extremes(listings: DataFrame, probs: tuple[float, float] = fv.PRICE_TRIM) -> DataFrame:
    """Rows whose price lies between two quantiles, both included.

    The two bounds come to the driver, so that the filter reaches the scan as constants.
    Give a stored table: the bounds take two passes over its price column.
    """
    bounds = exact_quantiles(listings, [], TARGET, list(probs), "bounds").first()
    if bounds is None:
        return listings.where(F.lit(False))
    low, high = bounds.bounds
    return listings.where(F.col(TARGET).between(low, high))


def clean(listings: DataFrame, current_year: int) -> DataFrame:
    return trim_extremes(listings.where(plausible(current_year)))


def derived_features(current_year: int, empty_year_is_missing: bool = False) -> dict[str, Column]:
    """Derived columns. Scoring treats a zero year as missing, training does not."""
    c = F.col
    year = F.nullif(c("year"), F.lit(0).cast("bigint")) if empty_year_is_missing else c("year")
    age = F.greatest(F.lit(current_year) - year, F.lit(0)).cast("bigint")
    age = F.when(year.isNotNull(), age)
    litres = F.nullif(c("engine_capacity_cm3").cast("double") / 1000.0, F.lit(0.0))
    return {
        "make_model": null_if_empty(
            F.trim(F.concat_ws(" ", null_if_empty(F.trim(c("make"))), null_if_empty(F.trim(c("model")))))
        ),
        "vehicle_age": age,
        "mileage_per_year": F.try_divide(c("mileage_km").cast("double"), age.cast("double")),
        "hp_per_liter": F.try_divide(c("power_hp").cast("double"), litres),
    }


def enrich(listings: DataFrame, current_year: int) -> DataFrame:
    return listings.withColumns(derived_features(current_year))


def scoring_features(listings: DataFrame, current_year: int, selected: list[str], keep: list[str]) -> DataFrame:
    """The selected features of rows to be scored, with the columns in ``keep``."""
    full = listings.withColumns(derived_features(current_year, empty_year_is_missing=True))
    return full.select(*keep, *[f for f in selected if f not in keep])


def training_frame(listings: DataFrame, current_year: int) -> DataFrame:
    return enrich(clean(with_target(listings), current_year), current_year)


def features_with_values(frame: DataFrame, candidates: list[str]) -> list[str]:
    """Candidate columns that hold at least one value: one pass, one row to the driver."""
    present = [c for c in candidates if c in frame.columns]
    counts = frame.agg(*[F.count(c).alias(c) for c in present]).first()
    return [c for c in present if counts[c] > 0]


def cleaning_summary(frame: DataFrame) -> DataFrame:
    return frame.agg(
        F.min(TARGET).alias("price_min"),
        F.max(TARGET).alias("price_max"),
        F.min("year").alias("year_min"),
        F.max("year").alias("year_max"),
    )
