"""Canonical values: enum maps, makes, and make/model/version out of titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adlens import fixed_values as fv
from adlens.functions.text import (
    bind,
    filled,
    first_filled,
    lookup,
    match_in,
    repair,
    slug,
    slug_of_literal,
    squeeze,
    title_case,
)


def enum_of_slug(key: Column, mapping: dict[str, str | None]) -> Column:
    """Mapped value of a slug; unmapped slugs pass through, empty or mapped to nothing is NULL."""
    silent = ["", *[k for k, v in mapping.items() if v is None]]
    known = {k: v for k, v in mapping.items() if v is not None}
    return F.when(~key.isin(silent), F.coalesce(lookup(known, key), key))


def canonical_enum(c: Column, mapping: dict[str, str | None]) -> Column:
    return bind(slug(c.cast("string")), lambda key: enum_of_slug(key, mapping))


def make_of_slug(key: Column, otherwise: Column) -> Column:
    """Known spelling of a make by its slug, else the given text."""
    spellings: dict[str, str] = {}
    for make in fv.KNOWN_MAKES:
        spellings.setdefault(slug_of_literal(make), make)
    return F.coalesce(lookup(spellings, key), otherwise)


def canonical_make(c: Column) -> Column:
    """Known spelling of a make, compared by slug, else the repaired text."""
    return bind(repair(c), lambda text: make_of_slug(slug(text), text))


_MODEL = r"((?i:seria|series) \S+|\S+)"


def model_and_version(rest: Column) -> Column:
    """Struct(model, version): one token, or two after ``Seria``/``Series``; then the remainder."""
    pattern = rf"^{_MODEL}(?: (.*))?$"
    return bind(
        squeeze(rest),
        lambda t: F.struct(
            match_in(t, pattern, 1).alias("model"), match_in(t, pattern, 2).alias("version")
        ),
    )


def title_pattern() -> str:
    """Make, model and version of a cleaned title: the longest known make, else one token."""
    longest_first = sorted(fv.KNOWN_MAKES, key=len, reverse=True)
    known = "|".join(m.replace("-", r"\-") for m in longest_first)
    return rf"^((?iu:{known})(?= |$)|\S+)(?: {_MODEL})?(?: (.*))?$"


def make_model_version(title: Column) -> Column:
    """Struct(make, model, version) out of a title; parts that are not there are NULL."""
    by_lower = {m.lower(): m for m in fv.KNOWN_MAKES}
    pattern = title_pattern()
    return bind(
        squeeze(title),
        lambda t: F.struct(
            bind(
                match_in(t, pattern, 1), lambda m: F.coalesce(lookup(by_lower, F.lower(m)), m)
            ).alias("make"),
            match_in(t, pattern, 2).alias("model"),
            match_in(t, pattern, 3).alias("version"),
        ),
    )


def first_tokens(title: Column) -> Column:
    """Struct(make, model, version) by position: first, second and remaining tokens."""
    pattern = r"^(\S+)(?: (\S+))?(?: (.*))?$"
    return bind(
        squeeze(title),
        lambda t: F.struct(
            match_in(t, pattern, 1).alias("make"),
            match_in(t, pattern, 2).alias("model"),
            match_in(t, pattern, 3).alias("version"),
        ),
    )


def first_tokens_of_clean(title: Column) -> Column:
    """:func:`first_tokens` of a squeezed title, without patterns."""
    make = F.substring_index(title, " ", 1)
    rest = F.substring(title, F.length(make) + 2, F.length(title))
    model = F.substring_index(rest, " ", 1)
    version = F.substring(rest, F.length(model) + 2, F.length(rest))
    return F.struct(*[filled(part).alias(n) for part, n in ((make, "make"), (model, "model"), (version, "version"))])


def make_of_path(path: Column) -> Column:
    brand = F.get(F.split(path, "/"), F.lit(0))
    return bind(
        brand,
        lambda b: F.coalesce(lookup(fv.READER_BRANDS, b), title_case(F.replace(b, F.lit("-"), F.lit(" ")))),
    )


def model_of_path(path: Column) -> Column:
    part = F.replace(F.get(F.split(path, "/"), F.lit(1)), F.lit("-"), F.lit(" "))
    return bind(title_case(part), lambda m: F.coalesce(lookup(fv.READER_MODEL_SPELLINGS, m), m))


def reader_fuel(c: Column) -> Column:
    """Fuel out of at most three words: hybrids first, then the map of the first word."""
    words = F.lower(F.array_join(F.slice(F.split(squeeze(c), " "), 1, 3), " "))

    def fuel(text: Column) -> Column:
        token = F.substring_index(text, " ", 1)
        hybrid = text.startswith("hybrid") | F.contains(text, F.lit("benzin/elektro"))
        known = F.coalesce(lookup(fv.READER_FUEL_MAP, token), token)
        return F.when(text != "", F.when(hybrid, F.lit("hybrid")).otherwise(known))

    return bind(words, fuel)


def canonical_site(c: Column) -> Column:
    """Site code of a user-given name; NULL if unknown."""
    return lookup(fv.SITE_ALIASES, F.translate(F.lower(c), "-.", ""))


def ensemble_method(name: str | None) -> str:
    """Checked name of a combination method."""
    wanted = (name or fv.DEFAULT_ENSEMBLE_METHOD).strip().casefold().replace("-", "_")
    if wanted not in fv.ENSEMBLE_METHODS:
        raise ValueError(f"unknown combination method: {name}")
    return wanted


def ensemble_method_column(c: Column) -> Column:
    """Column form: NULL where the name is unknown."""
    wanted = F.replace(F.lower(F.trim(first_filled(c, F.lit(fv.DEFAULT_ENSEMBLE_METHOD)))), F.lit("-"), F.lit("_"))
    return F.when(wanted.isin(fv.ENSEMBLE_METHODS), wanted)
