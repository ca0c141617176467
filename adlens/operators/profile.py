"""Profiles of a listing table: counts, medians, coverage, histograms, correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.operators.cleaning import TARGET
from adlens.operators.quantiles import exact_median

CORRELATED = ["year", "mileage_km", "power_hp", "engine_capacity_cm3", TARGET]


def correlation_matrix(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pairwise correlations, each over the rows where both values are present; one pass."""
    names = columns or CORRELATED
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    wide = frame.agg(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("left_column"),
                    F.lit(b).alias("right_column"),
                    (F.corr(a, b) if a != b else F.when(F.count(a) > 0, F.lit(1.0))).alias("correlation"),
                )
                for a, b in pairs
            ]
        ).alias("cells")
    )
    upper = wide.select(F.inline("cells"))
    lower = upper.where("left_column <> right_column").select(
        F.col("right_column").alias("left_column"), F.col("left_column").alias("right_column"), "correlation"
    )
    return upper.unionByName(lower)


def histogram(frame: DataFrame, column: str = TARGET, bins: int = 30) -> DataFrame:
    """Equal-width bins between the smallest and the largest value; the last bin is closed."""
    spread = frame.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).first()
    lo, hi = F.lit(spread.lo).cast("double"), F.lit(spread.hi).cast("double")
    width = (hi - lo) / bins
    place = F.floor((F.col(column).cast("double") - lo) / width)
    number = F.when(hi > lo, F.least(place, F.lit(bins - 1).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    counted = frame.where(F.col(column).isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(
        "bin", (lo + F.col("bin") * width).alias("bin_start"), (lo + (F.col("bin") + 1) * width).alias("bin_end"), "rows"
    )


def rows_by(frame: DataFrame, column: str) -> DataFrame:
    return frame.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def top_values(frame: DataFrame, column: str, limit: int) -> DataFrame:
    """The most frequent values; ties go to the smaller value."""
    counted = rows_by(frame.where(F.col(column).isNotNull()), column)
    return counted.orderBy(F.desc("rows"), column).limit(limit)


def median_by(frame: DataFrame, group: str, column: str = TARGET) -> DataFrame:
    """Exact median per group with the number of values."""
    found = exact_median(frame.where(F.col(group).isNotNull()), [group], column, f"median_{column}")
    return found.withColumnRenamed("n", "rows")


def distinct_pairs(frame: DataFrame) -> DataFrame:
    """Exact numbers of makes and of make-and-model pairs, by two grouped counts."""
    pairs = frame.where(F.col("make").isNotNull()).groupBy("make", "model").agg(F.lit(1).alias("one"))
    per_make = pairs.groupBy("make").agg(F.count("model").alias("models"))
    return per_make.agg(
        F.count(F.lit(1)).alias("distinct_makes"),
        F.coalesce(F.sum("models"), F.lit(0)).alias("distinct_models"),
    )


def approximate_distinct(frame: DataFrame, columns: list[str]) -> DataFrame:
    return frame.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])


def coverage(frame: DataFrame, columns: list[str], by: str = "source") -> DataFrame:
    """How many rows per group carry each column."""
    return frame.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"with_{c}") for c in columns]
    )


def scatter_counts(frame: DataFrame, mileage_step: int = 25000, price_step: int = 5000) -> DataFrame:
    """Price against mileage by fuel, as counts on a grid: every row is in, the plot stays small."""
    c = F.col
    return (
        frame.where(c("mileage_km").isNotNull() & c(TARGET).isNotNull())
        .select(
            "fuel_type",
            (F.floor(c("mileage_km") / mileage_step) * mileage_step).cast("bigint").alias("mileage_from"),
            (F.floor(c(TARGET) / price_step) * price_step).cast("bigint").alias("price_from"),
        )
        .groupBy("fuel_type", "mileage_from", "price_from")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def scatter_points(frame: DataFrame, share: float, seed: int) -> DataFrame:
    """A seeded sample of points for a plot; sampling is the feature here."""
    points = frame.select("mileage_km", TARGET, "fuel_type")
    return points.sample(withReplacement=False, fraction=share, seed=seed)
