"""Raw ads to normalised listings: column expressions only, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens import fixed_values as fv
from adlens.functions import enums, keys, numbers
from adlens.functions.text import dashed, filled, first_filled, squeeze, title_case, undo_mojibake
from adlens.schemas import LISTING, LISTING_COLUMNS, RAW_LISTING, SITE_PAYLOAD, conform

_CLEANED = ["title", "make", "model", "version", "listing_id", "first_registration", "currency", "seller_name",
            "location_city", "location_region", "price_indicator", "seller_type", "scraped_at"]
_STATED = ["make", "model", "version", "year", "mileage", "fuel_type", "gearbox", "body_type",
           "engine_power", "engine_capacity"]


def normalize(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Listing columns plus ``raw`` for every raw ad; ``keep`` names columns to carry along.

    A value stated in the site payload beats the collected column. Make and model are
    read out of the title only where one of them is missing. The work is laid out in
    steps, so that no clean-up expression is evaluated twice for a row.
    """
    extra = keep or []
    c = F.col
    base = raw.select(
        *[
            (c(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in RAW_LISTING.fields
        ],
        *extra,
    )
    from_site = c("source") == fv.SITE_WITH_PARAMETERS
    payload = base.withColumn("_site", F.when(from_site, F.from_json("raw", SITE_PAYLOAD)))
    stated = F.struct(*[keys.site_value(c("source"), c("_site"), k).alias(k) for k in _STATED])
    read = payload.withColumns(
        {
            "_stated": F.when(from_site, stated),
            "_price": F.coalesce(F.when(from_site, keys.site_price(c("source"), c("_site"))), c("price_value")),
            "source": first_filled(c("source"), F.lit("unknown")),
        }
    )
    cleaned = read.withColumns(
        {n: squeeze(c(n)) for n in _CLEANED}
        | {
            "_fuel": squeeze(first_filled(c("_stated.fuel_type"), c("fuel_type"))),
            "_gear": squeeze(first_filled(c("_stated.gearbox"), c("transmission"))),
            "_body": squeeze(first_filled(c("_stated.body_type"), c("body_type"))),
        }
    )
    named = cleaned.withColumns(
        {n: F.coalesce(filled(c(n)), filled(c(f"_stated.{n}"))) for n in ("make", "model", "version")}
        | {"title": F.coalesce("title", F.lit("")), "url": F.coalesce("url", F.lit(""))}
    )
    incomplete = c("make").isNull() | c("model").isNull()
    # the title is clean here, so one pattern gives all three parts
    pattern = enums.title_pattern()
    parts = F.struct(
        *[F.regexp_extract("title", pattern, i + 1).alias(n) for i, n in enumerate(("make", "model", "version"))]
    )
    guessed = named.withColumn("_guess", F.when(incomplete, parts))
    repaired = guessed.withColumns(
        {n: F.coalesce(c(n), filled(c(f"_guess.{n}"))) for n in ("make", "model", "version")}
        | {f"_{n}": undo_mojibake(c(n)) for n in ("seller_name", "location_city", "location_region")}
        | {n: undo_mojibake(c(n)) for n in ("price_indicator", "seller_type", "_fuel", "_gear", "_body")}
    ).withColumns({n: undo_mojibake(c(n)) for n in ("make", "model")})
    slugged = repaired.withColumns(
        {f"_{n}_key": dashed(c(n)) for n in ("make", "model")}
        | {f"_{n}_key": dashed(c(f"_{n}")) for n in ("seller_name", "location_city")}
        | {n: dashed(c(n)) for n in ("price_indicator", "seller_type", "_fuel", "_gear", "_body")}
    )

    def counted(key: str, column: str) -> Column:
        return F.coalesce(numbers.zero_as_null(numbers.integer_in(c(f"_stated.{key}"))), c(column))

    registered = numbers.year_of_registration(c("first_registration"))
    typed = slugged.select(
        "source",
        "listing_id",
        "url",
        "title",
        enums.make_of_slug(c("_make_key"), c("make")).alias("make"),
        "model",
        "version",
        F.coalesce(
            numbers.zero_as_null(numbers.integer_in(c("_stated.year"))), numbers.zero_as_null(c("year")), registered
        ).alias("year"),
        numbers.month_of_registration(c("first_registration")).alias("first_registration_month"),
        registered.alias("first_registration_year"),
        counted("mileage", "mileage_km").alias("mileage_km"),
        F.when(F.upper("currency") == "EUR", c("_price")).alias("price_eur"),
        c("_price").alias("original_price_value"),
        c("currency").alias("original_currency"),
        enums.enum_of_slug(c("price_indicator"), fv.PRICE_LABEL_MAP).alias("market_price_label"),
        enums.enum_of_slug(c("_fuel"), fv.FUEL_MAP).alias("fuel_type"),
        enums.enum_of_slug(c("_gear"), fv.TRANSMISSION_MAP).alias("transmission"),
        enums.enum_of_slug(c("_body"), fv.BODY_TYPE_MAP).alias("body_type"),
        counted("engine_power", "power_hp").alias("power_hp"),
        counted("engine_capacity", "engine_capacity_cm3").alias("engine_capacity_cm3"),
        enums.enum_of_slug(c("seller_type"), fv.SELLER_TYPE_MAP).alias("seller_type"),
        "seller_name",
        title_case(filled(c("_location_city"))).alias("location_city"),
        title_case(filled(c("_location_region"))).alias("location_region"),
        "scraped_at",
        "raw", "_make_key", "_model_key", "_seller_name_key", "_location_city_key",
        *extra,
    )
    has_raw = ~F.trim("raw").isin("", "{}", "null")
    near_key = keys.fuzzy_key_of_slugs(
        c("_make_key"), c("_model_key"), c("year"), c("mileage_km"), c("price_eur"),
        filled(c("_seller_name_key")), filled(c("_location_city_key")),
    )
    keyed = typed.withColumns(
        {
            "source_listing_key": keys.source_key(c("source"), filled(c("listing_id")), c("url")),
            "completeness_score": keys.completeness(
                [c(x) for x in ("make", "model", "version", "fuel_type", "transmission", "body_type",
                                "seller_type", "location_city")],
                [c(x) for x in ("year", "mileage_km", "price_eur", "power_hp", "engine_capacity_cm3")],
                has_raw,
            ),
            "dedupe_fuzzy_key": F.when(c("make").isNotNull() & c("model").isNotNull(), near_key),
        }
    ).withColumn("dedupe_exact_key", c("source_listing_key"))
    return keyed.select(*LISTING_COLUMNS, "raw", *extra)


def is_normalized(df: DataFrame) -> bool:
    """Input that already carries the listing key bypasses normalisation and de-duplication."""
    return "source_listing_key" in df.columns


def as_listings(df: DataFrame) -> DataFrame:
    """Back-fill missing columns and fix the column order of already normalised rows."""
    return conform(df, LISTING)
