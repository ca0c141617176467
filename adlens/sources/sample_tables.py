"""Listings derived from the sample star schema, so that every operator runs on whole tables.

One order line is one collected ad. Copies of an ad share order and line number, which
gives the de-duplication real work. The same expressions are stated as SQL in ``oracles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSITION = "pos"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer files than that; else unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def spread_parts(df: DataFrame) -> DataFrame:
    """Like :func:`spread` for rows that are moved anyway: a large file is read in splits, and they will do."""
    return spread(df) if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism else df


def raw_listings(spark: SparkSession, folder: str, coarse: bool = False) -> DataFrame:
    """Raw ads with a total input order; ``coarse`` gives near copies with equal fuzzy keys."""
    t = lambda name: table(spark, folder, name)
    joined = (
        spread_parts(t("lineitem"))
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    c = F.col
    listing_id = F.concat_ws("-", c("l_orderkey").cast("string"), c("l_linenumber").cast("string"))
    if coarse:
        mileage = (F.floor(c("l_quantity") / 10) * 50000).cast("bigint")
        price = (F.floor(c("l_extendedprice") / 5000) * 5000).cast("double")
        seller = F.lit(None).cast("string")
    else:
        mileage = F.when(c("l_linenumber") != 6, F.floor(c("l_quantity") * 5000).cast("bigint"))
        price = c("l_extendedprice") * F.lit(2.6) - F.lit(2000.0)
        seller = c("s_name")
    return joined.select(
        F.concat(F.lit("src_"), (c("l_orderkey") % 3).cast("string")).alias("source"),
        listing_id.alias("listing_id"),
        F.concat(F.lit("https://ads.example/"), listing_id, F.lit("/?ref="), c("l_suppkey").cast("string")).alias("url"),
        F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("title"),
        c("p_brand").alias("make"),
        c("p_type").alias("model"),
        c("p_name").alias("version"),
        price.alias("price_value"),
        F.when(c("l_tax") == 0, F.lit("RON")).otherwise(F.lit("EUR")).alias("currency"),
        c("l_returnflag").alias("price_indicator"),
        seller.alias("seller_name"),
        c("n_name").alias("location_city"),
        c("r_name").alias("location_region"),
        F.year("o_orderdate").cast("bigint").alias("year"),
        F.date_format("o_orderdate", "MM/yyyy").alias("first_registration"),
        mileage.alias("mileage_km"),
        c("o_orderpriority").alias("fuel_type"),
        c("l_linestatus").alias("transmission"),
        (c("p_size") * 12).cast("bigint").alias("power_hp"),
        F.when(c("l_linenumber") != 5, F.floor((c("p_retailprice") - 900) * 100).cast("bigint")).alias(
            "engine_capacity_cm3"
        ),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("scraped_at"),
        F.struct(
            c("l_shipdate"), c("l_partkey"), c("l_suppkey"), c("l_extendedprice"), c("l_quantity"), c("l_discount")
        ).alias(POSITION),
    )
