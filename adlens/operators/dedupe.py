"""Exact and fuzzy de-duplication that keeps the best record.

Both steps are grouped aggregations, so copies of a hot key are reduced to one row per
map task before the shuffle; no task ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.functions.text import null_if_empty
from adlens.operators.packed import PACKED, pack, unpack

MEMBERS, SURVIVORS, FIRST_SEEN = "_members", "_survivors", "_first_seen"


def collected_at(c: Column) -> Column:
    """Time stamp of an ISO text; NULL (which sorts first) if it cannot be read."""
    iso = c.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$")
    return F.when(iso, F.unix_micros(c.try_cast("timestamp")))


def _rank(position: Column) -> Column:
    """Greatest is best: completeness, then newest, then the later row."""
    return F.struct(F.col("completeness_score"), collected_at(F.col("scraped_at")), position)


def exact_key() -> Column:
    """What copies of a listing share."""
    return F.coalesce(null_if_empty(F.col("dedupe_exact_key")), F.col("source_listing_key"))


def _sorted_by_hash(key: Column) -> list[Column]:
    """Grouping by a key whose texts begin alike: the sort tells most of them apart by a number before them."""
    return [F.xxhash64(key).alias("_hash"), key.alias("_key")]


def keep_best_exact(listings: DataFrame, position: str, columns: list[str] | None = None) -> DataFrame:
    """Best row per exact key; ``position`` orders the input and must have no ties.

    Adds the number of copies and the position at which the key was first seen. With
    ``columns`` only these travel.
    """
    names = columns or listings.columns
    best = pack(listings, names).groupBy(*_sorted_by_hash(exact_key())).agg(
        F.max_by(PACKED, _rank(F.col(position))).alias("_best"),
        F.min(position).alias(FIRST_SEEN),
        F.count(F.lit(1)).alias(MEMBERS),
    )
    return unpack(
        best, "_best", listings.schema, names, [FIRST_SEEN, MEMBERS, F.lit(1).cast("bigint").alias(SURVIVORS)]
    )


# what decides between near copies
_COMPARED = ["source_listing_key", "dedupe_fuzzy_key", "completeness_score", "scraped_at"]


def keep_best_fuzzy(exact: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Best row per fuzzy key among exact survivors; rows without a fuzzy key all stay.

    Such rows get their own exact key as a stand-in, so they spread over all tasks. With
    ``columns`` only these travel.
    """
    carried = columns or [c for c in exact.columns if c not in (MEMBERS, SURVIVORS)]
    fuzzy = null_if_empty(F.col("dedupe_fuzzy_key"))
    key = F.coalesce(F.concat(F.lit("f|"), fuzzy), F.concat(F.lit("e|"), F.col("source_listing_key")))
    best = pack(exact, carried).groupBy(*_sorted_by_hash(key)).agg(
        F.max_by(PACKED, _rank(F.col(FIRST_SEEN))).alias("_best"),
        F.sum(MEMBERS).alias(MEMBERS),
        F.sum(SURVIVORS).alias(SURVIVORS),
    )
    return unpack(best, "_best", exact.schema, carried, [MEMBERS, SURVIVORS])


def deduplicate(listings: DataFrame, position: str, fuzzy: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Best rows with all their columns, or only ``columns``."""
    if not fuzzy:
        return keep_best_exact(listings, position, columns)
    compared = columns and list(dict.fromkeys([*columns, *_COMPARED]))
    return keep_best_fuzzy(keep_best_exact(listings, position, compared), columns)


def dedupe_report(kept: DataFrame) -> DataFrame:
    """One-row report out of the de-duplicated rows alone: no second pass over the input."""
    total = F.coalesce(F.sum(MEMBERS), F.lit(0))
    exact = F.coalesce(F.sum(SURVIVORS), F.lit(0))

    def missing(column: str) -> Column:
        return F.count_if(F.col(column).isNull())

    return kept.agg(
        total.alias("loaded_rows"),
        total.alias("normalized_rows"),
        F.count(F.lit(1)).alias("kept_rows"),
        (total - exact).alias("exact_duplicates_removed"),
        (exact - F.count(F.lit(1))).alias("fuzzy_duplicates_removed"),
        missing("price_eur").alias("rows_missing_price"),
        missing("year").alias("rows_missing_year"),
        missing("mileage_km").alias("rows_missing_mileage"),
    )


def report_without_dedupe(listings: DataFrame) -> DataFrame:
    """Report for input that was already normalised."""
    one = listings.withColumns({MEMBERS: F.lit(1).cast("bigint"), SURVIVORS: F.lit(1).cast("bigint")})
    return dedupe_report(one)


def distinct_rows(*frames: DataFrame) -> DataFrame:
    """Union by name without repeated rows."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged.distinct()


def keep_first(rows: DataFrame, key: Column, position: Column) -> DataFrame:
    """First row per key in input order."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    firsts = rows.groupBy(key.alias("_key")).agg(F.min_by(row, position).alias("_first"))
    return firsts.select("_first.*")


def listing_or_url() -> Column:
    """Key of a run: the listing id, else the URL."""
    return F.coalesce(null_if_empty(F.col("listing_id")), F.col("url"))
