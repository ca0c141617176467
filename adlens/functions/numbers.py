"""Numbers, registration dates and technical values read out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adlens import fixed_values as fv
from adlens.functions.text import bind, match_in, match_or_null, plain_blanks, squeeze


def zero_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0).cast("bigint"))


def integer_in(c: Column) -> Column:
    """First integer in a text; dots or blanks may group thousands."""
    plain = plain_blanks(c)
    return F.translate(match_or_null(plain, f"({fv.GROUPED_INTEGER})"), ". ", "").try_cast("bigint")


def digits_in(c: Column) -> Column:
    """First run of digits, taking dots, commas and blanks as grouping only."""
    run = match_or_null(plain_blanks(c), r"(\d[\d.,\s]*)")
    return F.regexp_replace(run, r"\D", "").try_cast("bigint")


def decimal_in(c: Column) -> Column:
    """First unsigned decimal of a text in European or English notation."""

    def read(t: Column) -> Column:
        commas = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))
        dots = F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))
        no_dots = F.replace(t, F.lit("."), F.lit(""))
        decimals = F.length(F.substring_index(t, ",", -1))
        after_dot = F.length(F.substring_index(t, ".", -1))
        english = (
            F.when((commas > 0) & (dots > 0), F.translate(no_dots, ",", "."))
            .when((commas == 1) & decimals.isin(1, 2), F.translate(t, ",", "."))
            .when(commas > 0, F.replace(t, F.lit(","), F.lit("")))
            .when((dots > 1) | ((dots == 1) & (after_dot == 3)), no_dots)
            .otherwise(t)
        )
        return match_in(english, f"({fv.PLAIN_DECIMAL})").try_cast("double")

    return bind(F.replace(plain_blanks(c), F.lit(" "), F.lit("")), read)


def month_of_registration(c: Column) -> Column:
    return match_or_null(c, fv.REGISTRATION, 1).try_cast("bigint")


def year_of_registration(c: Column) -> Column:
    return match_or_null(c, fv.REGISTRATION, 2).try_cast("bigint")


def four_digit_year(c: Column) -> Column:
    return match_or_null(c, r"(\d{4})").try_cast("bigint")


def within(c: Column, bounds: tuple[float, float]) -> Column:
    return F.when(c.between(*bounds), c)


def _kw_as_hp(kw: Column) -> Column:
    return F.bround(kw * F.lit(fv.KW_TO_HP)).cast("bigint")


def power_hp(c: Column) -> Column:
    """Power in hp; the first notation that matches decides, even out of range."""

    def read(t: Column) -> Column:
        # an empty text costs an exception in the cast, NULL does not
        found = lambda pattern: match_in(t, pattern).try_cast("bigint")
        return (
            F.when(t.rlike(fv.POWER_IN_BRACKETS), found(fv.POWER_IN_BRACKETS))
            .when(t.rlike(fv.POWER_EXPLICIT), found(fv.POWER_EXPLICIT))
            .when(t.rlike(fv.POWER_KW), _kw_as_hp(found(fv.POWER_KW)))
            .otherwise(found(r"^(\d{2,3})$"))
        )

    return bind(bind(squeeze(c), read), lambda v: within(v, fv.POWER_RANGE))


def power_with_source(c: Column) -> Column:
    """Power and how it was found; an out-of-range hit falls through to the next notation."""
    explicit = bind(
        match_in(c, fv.POWER_EXPLICIT).try_cast("bigint"), lambda v: within(v, fv.POWER_RANGE)
    )
    kw = bind(
        _kw_as_hp(match_in(c, fv.POWER_KW).try_cast("bigint")), lambda v: within(v, fv.POWER_RANGE)
    )
    return bind(
        F.struct(explicit.alias("a"), kw.alias("b")),
        lambda f: F.struct(
            F.coalesce(f["a"], f["b"]).alias("value"),
            F.when(f["a"].isNotNull(), F.lit("explicit_hp"))
            .when(f["b"].isNotNull(), F.lit("kw_to_hp"))
            .alias("found_by"),
        ),
    )


def _displacements(c: Column) -> Column:
    """Displacements like ``2.0 TDI`` in order, without litres per 100 km and loose ``d``; NULL without any decimal."""
    pattern = (
        r"(?is)(?<![A-Za-z0-9])([0-6])[\.,](\d)\s*[- ]?\s*"
        rf"({fv.ENGINE_LABELS})(?=(.{{0,12}}))"
    )
    found = F.arrays_zip(
        *[
            F.regexp_extract_all(c, F.lit(pattern), F.lit(group)).alias(name)
            for group, name in enumerate(["litre", "tenth", "label", "tail"], start=1)
        ]
    )

    def usable(hit: Column) -> Column:
        label = F.lower(hit["label"])
        consumption = label.startswith("l") & hit["tail"].rlike(fv.PER_100_KM)
        loose_d = (label == "d") & (hit["tenth"] != "0")
        return ~consumption & ~loose_d

    read = F.transform(
        F.filter(found, usable),
        lambda hit: hit["litre"].cast("bigint") * 1000 + hit["tenth"].cast("bigint") * 100,
    )
    return F.when(c.rlike(r"[0-6][.,]\d"), read)


def engine_cm3(c: Column) -> Column:
    """Displacement in cm3; the first notation that matches decides, even out of range."""
    explicit = match_in(c, fv.CAPACITY_EXPLICIT).try_cast("bigint")
    value = F.when(c.rlike(fv.CAPACITY_EXPLICIT), explicit).otherwise(F.get(_displacements(c), F.lit(0)))
    return bind(value, lambda v: within(v, fv.ENGINE_RANGE))


def engine_with_source(c: Column) -> Column:
    """Displacement and how it was found; out-of-range hits fall through."""
    explicit = bind(
        match_in(c, fv.CAPACITY_EXPLICIT).try_cast("bigint"), lambda v: within(v, fv.ENGINE_RANGE)
    )
    litres = F.get(F.filter(_displacements(c), lambda v: v.between(*fv.ENGINE_RANGE)), F.lit(0))
    return bind(
        F.struct(explicit.alias("a"), litres.alias("b")),
        lambda f: F.struct(
            F.coalesce(f["a"], f["b"]).alias("value"),
            F.when(f["a"].isNotNull(), F.lit("explicit_capacity"))
            .when(f["b"].isNotNull(), F.lit("title_displacement"))
            .alias("found_by"),
        ),
    )


def close_to(a: Column, b: Column, tolerance: float) -> Column:
    return F.coalesce(F.abs(a.cast("double") - b.cast("double")) <= F.lit(float(tolerance)), F.lit(False))


def rounded_int(c: Column) -> Column:
    """Nearest integer, halves to the even neighbour."""
    return F.bround(c.cast("double")).cast("bigint")
