"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _record(**fields: T.DataType | str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t] if isinstance(t, str) else t) for n, t in fields.items()])


def _texts(*names: str) -> T.StructType:
    return _record(**{n: "string" for n in names})


def _columns(listing: str) -> T.StructType:
    """Flat schema out of 'name type, name type, ...'."""
    return _record(**dict(column.split() for column in listing.split(",")))


# a collected ad before normalisation; ``raw`` keeps the site's own JSON as text
RAW_LISTING = _columns(
    "source string, listing_id string, url string, title string, make string, model string, "
    "version string, price_value double, currency string, price_indicator string, "
    "seller_name string, seller_type string, location_city string, location_region string, "
    "year bigint, first_registration string, mileage_km bigint, fuel_type string, "
    "transmission string, power_hp bigint, engine_capacity_cm3 bigint, body_type string, "
    "description string, scraped_at string, raw string"
)

# a normalised ad, in the column order of the exported table
LISTING = _columns(
    "source string, source_listing_key string, listing_id string, url string, title string, "
    "make string, model string, version string, year bigint, first_registration_month bigint, "
    "first_registration_year bigint, mileage_km bigint, price_eur double, "
    "original_price_value double, original_currency string, market_price_label string, "
    "fuel_type string, transmission string, body_type string, power_hp bigint, "
    "engine_capacity_cm3 bigint, seller_type string, seller_name string, location_city string, "
    "location_region string, scraped_at string, completeness_score bigint, "
    "dedupe_exact_key string, dedupe_fuzzy_key string"
)
LISTING_COLUMNS = LISTING.fieldNames()

_PARAMETER_LIST = T.ArrayType(_texts("key", "displayValue", "value"))
_PARAMETER_DICT = T.MapType(T.StringType(), _record(values=T.ArrayType(_texts("label", "value"))))
_AMOUNT = _texts("value", "currencyCode")

# the parts of the site payload that normalisation reads
SITE_PAYLOAD = _record(
    parameters=_PARAMETER_LIST,
    parametersDict=_PARAMETER_DICT,
    price=_record(amount=_AMOUNT, value="string", currency="string"),
)

IMAGE_PAYLOAD = _record(
    image_url="string",
    previewImage="string",
    api_item=_record(previewImage=_texts("src")),
    images=_record(photos=T.ArrayType(_texts("url", "id"))),
)

SEARCH_NODE = _record(
    id="string", url="string", title="string", shortDescription="string",
    parameters=_PARAMETER_LIST,
    price=_record(amount=_AMOUNT),
    location=_record(city=_texts("name"), region=_texts("name")),
    sellerLink=_texts("name"),
    seller=_texts("__typename"),
    priceEvaluation=_texts("indicator"),
)

ADVERT = _record(
    id="string", url="string", title="string", description="string",
    seller=_record(name="string", type="string", location=_texts("city", "region")),
    parametersDict=_PARAMETER_DICT,
    price=_texts("value", "currency"),
)

API_ITEM = _record(
    id="string", type="string", title="string", subTitle="string", make="string", model="string",
    relativeUrl="string", category="string",
    attr=_texts("fr", "yc", "ml", "ft", "tr", "pw", "cc", "c", "loc"),
    price=_texts("grossAmount", "gross", "grossCurrency"),
    priceRating=_texts("ratingLabel", "rating"),
    contactInfo=_texts("name", "sellerType", "typeLocalized", "location"),
    previewImage=_texts("src", "srcSet"),
)

ESTIMATE = _columns(
    "model string, predicted_price_eur double, rmse double, mae double, r2 double, "
    "cv_rmse double, is_best_model boolean, ensemble_weight double, agreement_weight double, "
    "excluded_from_weighted_average boolean, exclusion_reason string, weighting string"
).add("excluded_models", T.ArrayType(T.StringType()))

SIMILAR = _columns(
    "title string, url string, price_eur double, year bigint, mileage_km bigint, "
    "fuel_type string, transmission string, power_hp bigint, engine_capacity_cm3 bigint, "
    "location_city string, seller_type string, similarity_score double, match_quality string"
).add("match_reasons", T.ArrayType(T.StringType()))

HISTORY = _columns(
    "id string, user_id bigint, source string, url string, title string, image_url string, "
    "actual_price_eur double, predicted_price_eur double, verdict string, model_name string, "
    "delta_percent double, prediction_json string, created_at string"
)

# the stored report, as far as the history reads it back
REPORT_SUMMARY = (
    _columns(
        "source string, url string, title string, image_url string, actual_price_eur double, "
        "predicted_price_eur double, verdict string, model_name string, delta_percent double, "
        "threshold_percent double"
    )
    .add("similar_listings", T.ArrayType(SIMILAR))
    .add("model_estimates", T.ArrayType(ESTIMATE))
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to ``schema``: its order and types, NULL for columns that are missing."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
