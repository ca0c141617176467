"""Combining model estimates, verdicts and hold-out metrics: row-local or one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens import fixed_values as fv
from adlens.functions.enums import ensemble_method
from adlens.functions.text import bind
from adlens.operators.quantiles import bin_number, quantile_edges
from adlens.schemas import ESTIMATE

VOTING = fv.VOTING_MODEL


def middle(values: Column) -> Column:
    """Median of an array of numbers."""

    def read(ordered: Column) -> Column:
        n = F.size(ordered)
        low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
        high = F.get(ordered, F.floor(n / 2).cast("int"))
        return F.when(n > 0, (low + high) / 2.0)

    return bind(F.array_sort(values), read)


def median_deviation(values: Column) -> Column:
    return bind(values, lambda v: bind(middle(v), lambda center: middle(F.transform(v, lambda x: F.abs(x - center)))))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def estimate(fields: dict[str, Column]) -> Column:
    """One element of the estimates array; fields not given are NULL."""
    return F.struct(
        *[
            fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in ESTIMATE.fields
        ]
    )


def sort_estimates(estimates: Column) -> Column:
    """By RMSE, models without one last."""
    keyed = F.transform(
        estimates, lambda e: F.struct(F.coalesce(e["rmse"], F.lit(float("inf"))).alias("k"), e["model"].alias("m"), e.alias("e"))
    )
    return F.transform(
        F.array_sort(keyed, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)),
        lambda x: x["e"],
    )


def combine_estimates(df: DataFrame, method: str | None = None, estimates: str = "model_estimates") -> DataFrame:
    """Adds ``predicted_price_eur`` and the weights inside the estimates array.

    Weight is 1/MAE, else 1/RMSE, else 1; with agreement it shrinks with the distance to
    the median estimate. The voting model is shown but never weighted, since it already
    contains the others.
    """
    agreement = ensemble_method(method) == "inverse_mae_with_agreement"
    column = F.col(estimates)

    def counts(e: Column) -> Column:
        return (e["model"] != VOTING) & F.coalesce(e["predicted_price_eur"] > 0, F.lit(False))

    def skill(e: Column) -> Column:
        return (
            F.when(e["mae"] > 0, F.lit(1.0) / e["mae"])
            .when(e["rmse"] > 0, F.lit(1.0) / e["rmse"])
            .otherwise(F.lit(1.0))
        )

    def closeness(e: Column, around: Column) -> Column:
        if not agreement:
            return F.lit(1.0)
        return F.exp(-F.abs(e["predicted_price_eur"] - around["center"]) / around["scale"])

    def center_and_scale(prices: Column) -> Column:
        return bind(
            F.struct(middle(prices).alias("center"), median_deviation(prices).alias("spread")),
            lambda s: F.struct(
                s["center"].alias("center"),
                F.greatest(s["spread"] * 2.5, s["center"] * 0.15, F.lit(1.0)).alias("scale"),
            ),
        )

    def weigh(e: Column, around: Column) -> Column:
        """The estimate with its raw weight; NULL weight if it does not count."""
        near = closeness(e, around)
        return F.struct(
            e.alias("e"),
            F.when(counts(e), near).alias("near"),
            F.when(counts(e), skill(e) * near).alias("weight"),
        )

    def annotate(w: Column, total: Column) -> Column:
        e = w["e"]
        voting = e["model"] == VOTING
        fields = {f.name: e[f.name] for f in ESTIMATE.fields}
        fields["ensemble_weight"] = F.when(total > 0, w["weight"] / total)
        fields["agreement_weight"] = w["near"] if agreement else F.lit(None)
        fields["excluded_from_weighted_average"] = F.when(voting, F.lit(True))
        fields["exclusion_reason"] = F.when(voting, F.lit("prevents_double_counting"))
        return estimate(fields)

    def settle(weighed: Column) -> Column:
        """Final price and annotated estimates out of all weighed estimates."""
        used = F.filter(weighed, lambda w: w["weight"].isNotNull())
        sums = F.struct(
            F.size(used).alias("n"),
            _total(F.transform(used, lambda w: w["weight"])).alias("weight"),
            _total(F.transform(used, lambda w: w["weight"] * w["e"]["predicted_price_eur"])).alias("worth"),
            _total(F.transform(used, lambda w: w["e"]["predicted_price_eur"])).alias("plain"),
            F.get(
                F.filter(F.transform(weighed, lambda w: w["e"]["predicted_price_eur"]), lambda p: p.isNotNull()), F.lit(0)
            ).alias("first"),
        )
        return bind(
            sums,
            lambda t: F.struct(
                F.when(t["n"] <= 0, F.coalesce(t["first"], F.lit(0.0)))
                .when(t["weight"] > 0, t["worth"] / t["weight"])
                .otherwise(t["plain"] / t["n"])
                .alias("price"),
                F.transform(weighed, lambda w: annotate(w, t["weight"])).alias("estimates"),
            ),
        )

    prices = F.transform(F.filter(column, counts), lambda e: e["predicted_price_eur"])
    result = bind(
        bind(prices, center_and_scale),
        lambda around: bind(F.transform(column, lambda e: weigh(e, around)), settle),
    )
    return df.withColumn("_combined", result).withColumns(
        {
            "predicted_price_eur": F.coalesce("_combined.price", F.lit(0.0)),
            estimates: F.col("_combined.estimates"),
        }
    ).drop("_combined")


def verdict(actual: Column, predicted: Column, threshold_percent: float = fv.VERDICT_THRESHOLD) -> Column:
    share = threshold_percent / 100.0
    return (
        F.when(actual.isNull() | predicted.isNull() | (predicted <= 0), "unknown")
        .when(actual < predicted * F.lit(1.0 - share), "too_low_suspicious")
        .when(actual > predicted * F.lit(1.0 + share), "too_high")
        .otherwise("fair")
    )


def deltas(actual: Column, predicted: Column) -> tuple[Column, Column]:
    gap = actual - predicted
    return gap, F.when(predicted > 0, gap / predicted * 100.0)


def verdict_by_label(df: DataFrame, label: str = "market_price_label") -> DataFrame:
    """Verdicts against the label a site shows, as one row per label."""
    verdicts = ["too_low_suspicious", "fair", "too_high", "unknown"]
    return df.groupBy(label).agg(
        *[F.count_if(F.col("verdict") == v).alias(v) for v in verdicts], F.count(F.lit(1)).alias("rows")
    )


# --- hold-out evaluation -----------------------------------------------------------------

ACTUAL, PREDICTED = "actual_price_eur", "predicted_price_eur"


def with_errors(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("abs_error_eur", F.abs(F.col(ACTUAL) - F.col(PREDICTED)))


def holdout_metrics(predictions: DataFrame) -> DataFrame:
    """RMSE, MAE and R2 per model in one aggregation."""
    error = F.col(ACTUAL) - F.col(PREDICTED)
    squares = F.sum(error * error)
    return predictions.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.lit(1.0) - F.try_divide(squares, F.var_pop(ACTUAL) * F.count(F.lit(1)))).alias("r2"),
    )


def cross_validation_rmse(scored: DataFrame, fold: str = "fold") -> DataFrame:
    """Mean over folds of the RMSE within each fold, in the unit the models were fitted in."""
    error = F.col("actual") - F.col("predicted")
    per_fold = scored.groupBy("model", fold).agg(F.sqrt(F.avg(error * error)).alias("fold_rmse"))
    return per_fold.groupBy("model").agg(F.avg("fold_rmse").alias("cv_rmse"))


def best_model(metrics: DataFrame) -> DataFrame:
    """Model with the smallest RMSE; ties go to the one listed first (``position``)."""
    by = F.struct("rmse", "position") if "position" in metrics.columns else F.struct("rmse", "model")
    return metrics.agg(F.min_by("model", by).alias("best_model"), F.min("rmse").alias("best_rmse"))


def rank_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.asc_nulls_last("rmse"), "model")


def worst_first(predictions: DataFrame) -> DataFrame:
    return with_errors(predictions).orderBy(F.desc("abs_error_eur"))


def residual_profile(predictions: DataFrame, bands: int = fv.TARGET_BINS) -> DataFrame:
    """Spread of actual minus predicted, per model and equal-frequency price band."""
    edges = quantile_edges(predictions, ACTUAL, bands)
    band = bin_number(F.col(ACTUAL), F.array(*[F.lit(e) for e in edges]).cast("array<double>"))
    rows = predictions.withColumns(
        {"price_band": band.cast("bigint"), "residual": F.col(ACTUAL) - F.col(PREDICTED)}
    )
    return rows.groupBy("model", "price_band").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("residual").alias("mean_residual"),
        F.stddev_pop("residual").alias("sd_residual"),
        F.min("residual").alias("min_residual"),
        F.max("residual").alias("max_residual"),
    )
