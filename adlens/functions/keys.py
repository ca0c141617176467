"""Identity keys, completeness and site payload lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adlens import fixed_values as fv
from adlens.functions.numbers import decimal_in
from adlens.functions.text import first_filled, null_if_empty, slug
from adlens.functions.urls import url_key


def source_key(source: Column, listing_id: Column, url: Column) -> Column:
    """``source:id``, or ``source:url key`` where there is no id (a cleaned id, NULL if empty)."""
    tail = F.coalesce(listing_id, url_key(F.coalesce(url, F.lit(""))))
    return F.concat(source, F.lit(":"), tail)


def fuzzy_key_of_slugs(
    make: Column, model: Column, year: Column, mileage: Column, price: Column, seller: Column, city: Column
) -> Column:
    """Key for near copies out of slugs; NULL if a number is missing or zero, or the place is."""
    place = F.coalesce(seller, city)
    usable = (
        F.coalesce(year != 0, F.lit(False))
        & F.coalesce(mileage != 0, F.lit(False))
        & F.coalesce(price != 0, F.lit(False))
        & place.isNotNull()
    )
    return F.when(
        usable,
        F.concat_ws(
            "|",
            F.coalesce(make, F.lit("")),
            F.coalesce(model, F.lit("")),
            year.cast("string"),
            mileage.cast("string"),
            F.bround(price).cast("bigint").cast("string"),
            place,
        ),
    )


def fuzzy_key(
    make: Column, model: Column, year: Column, mileage: Column, price: Column, seller: Column, city: Column
) -> Column:
    """Key for near copies; NULL if any part is missing, empty or zero."""
    named = null_if_empty(make).isNotNull() & null_if_empty(model).isNotNull()
    return F.when(
        named, fuzzy_key_of_slugs(slug(make), slug(model), year, mileage, price, slug(seller), slug(city))
    )


def completeness(texts: list[Column], numbers: list[Column], has_raw: Column) -> Column:
    """How many of the fields carry a value; empty text and zero count as missing."""
    present = [F.coalesce(c != "", F.lit(False)) for c in texts]
    present += [F.coalesce(c != 0, F.lit(False)) for c in numbers]
    present.append(F.coalesce(has_raw, F.lit(False)))
    return sum((flag.cast("bigint") for flag in present[1:]), present[0].cast("bigint"))


def synthetic_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 over the joined parts; NULL counts as empty."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha1(F.concat_ws("|", *texts).cast("binary")), 1, 16)


def parameter_value(item: Column) -> Column:
    return first_filled(item["displayValue"], item["value"])


def dict_value(parameters: Column, key: str, label_first: bool = True) -> Column:
    """First value of an entry of the parameter dictionary."""
    head = F.get(F.try_element_at(parameters, F.lit(key))["values"], F.lit(0))
    order = (head["label"], head["value"]) if label_first else (head["value"], head["label"])
    return first_filled(*order)


def site_value(source: Column, payload: Column, key: str) -> Column:
    """Value a site states itself: the first matching list item, else the dictionary entry.

    A matching list item decides even if it is empty. Only one site has such lists.
    """
    hits = F.filter(payload["parameters"], lambda item: item["key"] == key)
    listed = F.coalesce(F.size(hits) > 0, F.lit(False))
    value = F.when(listed, parameter_value(F.get(hits, F.lit(0)))).otherwise(
        dict_value(payload["parametersDict"], key)
    )
    return F.when(source == fv.SITE_WITH_PARAMETERS, value)


def site_price(source: Column, payload: Column) -> Column:
    price = payload["price"]
    value = F.coalesce(decimal_in(price["amount"]["value"]), decimal_in(price["value"]))
    return F.when(source == fv.SITE_WITH_PARAMETERS, value)


def primary_image(payload: Column) -> Column:
    """Address of the leading picture out of a parsed payload (``IMAGE_PAYLOAD``)."""

    def filled(c: Column) -> Column:
        return F.when(F.trim(c) != "", c)

    photos = F.transform(
        payload["images"]["photos"], lambda p: filled(first_filled(p["url"], p["id"]))
    )
    plain_preview = F.when(~payload["previewImage"].startswith("{"), payload["previewImage"])
    return F.coalesce(
        filled(payload["image_url"]),
        filled(plain_preview),
        filled(payload["api_item"]["previewImage"]["src"]),
        F.get(F.filter(photos, lambda p: p.isNotNull()), F.lit(0)),
    )
