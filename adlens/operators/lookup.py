"""Finding stored listings by URL or id, with fallbacks in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.functions.text import null_if_empty
from adlens.functions.urls import url_key

BY_URL, BY_ID = 0, 1


def _first_per_key(table: DataFrame, key: Column, place: Column, shown: Column) -> DataFrame:
    """One row per key, the earliest; copies of a hot key are reduced before the shuffle.

    The place travels once, in front of what is shown. A row without a place is never the earliest.
    """
    return (
        table.where(key.isNotNull() & place.isNotNull())
        .groupBy(key.alias("_key"))
        .agg(F.min(F.struct(place.alias("place"), shown.alias("shown"))).alias("_hit"))
    )


def _matched(requests: DataFrame, pool: DataFrame, place: Column, shown: Column) -> DataFrame:
    """Requests with the earliest row that has their URL (``_u``) and their id (``_i``): place and what is shown."""
    by_url = _first_per_key(pool, url_key(F.coalesce(F.col("url"), F.lit(""))), place, shown)
    by_id = _first_per_key(pool, null_if_empty(F.col("listing_id").cast("string")), place, shown)
    asked = requests.withColumns(
        {
            "_url_key": url_key(F.col("url")),
            "_id_key": null_if_empty(F.col("wanted_id").cast("string")),
        }
    )
    return asked.join(
        by_url.select(F.col("_key").alias("_url_key"), F.col("_hit").alias("_u")), "_url_key", "left"
    ).join(by_id.select(F.col("_key").alias("_id_key"), F.col("_hit").alias("_i")), "_id_key", "left")


def _of_source(table: DataFrame, source: str | None) -> DataFrame:
    return table if source is None else table.where(F.lower("source") == source.lower())


def find_listings(
    requests: DataFrame, table: DataFrame, position: str, source: str | None = None, prefer: str = "url",
    columns: list[str] | None = None,
) -> DataFrame:
    """Left join of requests (url, wanted_id) with the listing each one means.

    ``prefer="url"``: a URL match beats an id match, as in a table scan that collects URL
    matches first. ``prefer="position"``: whichever row comes first in the table. Two
    equality joins against unique keys; an OR condition would compare everything.
    An empty URL fits the first row without one; a NULL URL and an empty or NULL id fit none.
    ``columns`` names the columns of the listing that are wanted, all if not given; only these travel.
    """
    shown = F.struct(*[F.col(c) for c in columns or table.columns])
    joined = _matched(requests, _of_source(table, source), F.col(position), shown)
    use_url = F.col("_u").isNotNull()
    if prefer != "url":
        use_url = use_url & (F.col("_i").isNull() | (F.col("_u.place") <= F.col("_i.place")))
    hit = F.when(use_url, F.col("_u.shown")).otherwise(F.col("_i.shown"))
    matched_by = F.when(use_url, F.lit("url")).when(F.col("_i").isNotNull(), F.lit("id"))
    return joined.select(*requests.columns, hit.alias("listing"), matched_by.alias("matched_by"))


def resolve(
    requests: DataFrame, tables: list[tuple[str, DataFrame]], position: str, source: str | None = None, prefer: str = "url",
    columns: list[str] | None = None,
) -> DataFrame:
    """First hit over several tables in order; adds ``listing`` (JSON) and ``found_in`` (NULL: unresolved).

    The table decides before the kind of match: an id in the first table beats a URL in the second.
    The number of the table leads the position, so that two joins do for any number of tables.
    ``columns`` names the columns of the listing that are wanted, all if not given.
    """
    pool = None
    for number, (_, table) in enumerate(tables):
        # a row without a position is never the earliest
        rows = _of_source(table, source).where(F.col(position).isNotNull()).select(
            "url", F.col("listing_id").cast("string").alias("listing_id"),
            F.struct(F.lit(number).alias("table"), F.col(position).alias("position")).alias("_place"),
            F.to_json(F.struct(*[F.col(c) for c in columns or table.columns])).alias("_shown"),
        )
        pool = rows if pool is None else pool.unionByName(rows)
    joined = _matched(requests, pool, F.col("_place"), F.col("_shown"))
    url, by_id = F.col("_u.place"), F.col("_i.place")
    first = url["table"] <= by_id["table"] if prefer == "url" else url <= by_id
    use_url = F.col("_u").isNotNull() & (F.col("_i").isNull() | first)
    hit = F.when(use_url, F.col("_u")).otherwise(F.col("_i"))
    names = F.array(*[F.lit(name) for name, _ in tables])
    return joined.select(
        *requests.columns, hit["shown"].alias("listing"), F.get(names, hit["place"]["table"]).alias("found_in")
    )


def unresolved(resolved: DataFrame) -> DataFrame:
    """Requests that no table could answer."""
    return resolved.where(F.col("found_in").isNull()).drop("listing", "found_in")


def estimates_with_metrics(estimates: DataFrame, metrics: DataFrame, column: str = "model_estimates") -> DataFrame:
    """The metrics of its model (one row per model) beside every entry of the array ``column``.

    Each entry is a struct with a ``model``; a model without metrics gets NULLs. The metrics
    are a handful of rows and travel as one map, so no listing is moved.
    """
    names = [c for c in metrics.columns if c != "model"]
    by_model = metrics.where(F.col("model").isNotNull()).agg(
        F.map_from_entries(F.collect_list(F.struct("model", F.struct(*names)))).alias("_metrics")
    )
    fields = estimates.schema[column].dataType.elementType.fieldNames()

    def with_metrics(e: Column) -> Column:
        known = F.try_element_at(F.col("_metrics"), e["model"])
        return F.struct(*[e[f].alias(f) for f in fields], *[known[n].alias(n) for n in names])

    joined = estimates.crossJoin(F.broadcast(by_model))
    return joined.withColumn(column, F.transform(column, with_metrics)).drop("_metrics")
