"""URL keys, site classification, page frontiers and absolute addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adlens import fixed_values as fv
from adlens.functions.text import bind, first_filled, match_or_null, null_if_empty, squeeze


def url_key(url: Column) -> Column:
    """URL without its query and trailing slashes; case and fragment are kept."""
    return bind(F.rtrim(F.substring_index(url, "?", 1), F.lit("/")), squeeze)


def _query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _web(url: Column) -> Column:
    return url.rlike(r"^(?i)https?://")


def set_query_param(url: Column, key: str, value: Column) -> Column:
    """URL with one query parameter set; repeated names keep their last value."""
    pairs = F.transform(
        F.filter(F.split(_query(url), "&"), lambda p: p != ""),
        lambda p: F.struct(
            F.url_decode(F.substring_index(p, "=", 1)).alias("k"),
            F.when(F.contains(p, F.lit("=")), F.url_decode(F.regexp_replace(p, "^[^=]*=", "")))
            .otherwise(F.lit(""))
            .alias("v"),
        ),
    )
    pairs = F.concat(pairs, F.array(F.struct(F.lit(key).alias("k"), value.cast("string").alias("v"))))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))

    def encode(c: Column) -> Column:
        return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    rendered = F.transform(
        names,
        lambda n: F.concat(
            encode(n), F.lit("="), encode(F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"])
        ),
    )
    return F.concat(
        F.regexp_extract(url, r"^([^?#]*)", 1),
        F.lit("?"),
        F.array_join(rendered, "&"),
        F.regexp_extract(url, r"(#.*)$", 1),
    )


def set_page_number(url: Column, page: Column) -> Column:
    """URL with ``pageNumber`` replaced where present, else appended."""
    number = page.cast("string")
    return (
        F.when(
            F.contains(url, F.lit("pageNumber=")),
            F.regexp_replace(url, F.lit(r"pageNumber=\d+"), F.concat(F.lit("pageNumber="), number)),
        )
        .when(F.contains(url, F.lit("?")), F.concat(url, F.lit("&pageNumber="), number))
        .otherwise(F.concat(url, F.lit("?pageNumber="), number))
    )


def page_url(url: Column, page: Column, style: str) -> Column:
    """Address of result page ``page``; the first page is the URL itself."""
    later = set_query_param(url, "page", page) if style == "page" else set_page_number(url, page)
    return F.when(page == 1, url).otherwise(later)


def listing_id_in(url: Column) -> Column:
    """Numeric ``id=`` parameter, else the file name of an ad page, else any 6+ digits."""
    given = match_or_null(_query(url), r"(?:^|&)id=([^&]+)")
    path = F.regexp_extract(url, r"^([^?#]*)", 1)
    return F.coalesce(
        F.when(given.rlike(r"^\d+$"), given),
        match_or_null(path, r"/(\d{6,})\.html$"),
        match_or_null(url, r"(\d{6,})"),
    )


def simple_listing_id(url: Column) -> Column:
    """Digits after the first ``id=``."""
    return match_or_null(url, r"id=(\d+)")


def admissible_site(url: Column) -> Column:
    """Site code of a web address that may be scored; NULL if it is not admissible."""
    params, detail = fv.SITE_WITH_PARAMETERS, fv.SITE_WITH_DETAIL_PAGES
    return F.when(_web(url) & _host(url).endswith(fv.SITE_HOSTS[params]), F.lit(params)).when(
        _web(url) & _host(url).endswith(fv.SITE_HOSTS[detail]) & listing_id_in(url).isNotNull(),
        F.lit(detail),
    )


def site_of(url: Column) -> Column:
    """Site code by host name alone (user info and port do not matter)."""
    name = F.regexp_replace(F.regexp_replace(_host(url), "^.*@", ""), r":\d+$", "")
    return F.coalesce(*[F.when(name.endswith(host), F.lit(site)) for site, host in fv.SITE_HOSTS.items()])


def absolute_listing_url(relative: Column) -> Column:
    given = null_if_empty(relative)
    return F.coalesce(
        F.when(given.rlike("^https?://"), given), F.concat(F.lit(fv.LISTING_HOST), given), F.lit("")
    )


def search_api_url(url: Column) -> Column:
    """API address of a search page; an API address is kept."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    query = first_filled(_query(url), F.lit(fv.CONSUMER_API_DEFAULT_QUERY))
    return F.when(path == fv.CONSUMER_API_PATH, url).otherwise(
        F.concat(F.lit(fv.CONSUMER_API + "?"), query)
    )


def detail_page_url(url: Column) -> Column:
    """Address of the detail page of an ad; unchanged if it already is one or has no id."""
    listing_id = F.coalesce(
        match_or_null(_query(url), r"(?:^|&)id=([^&]+)"), match_or_null(url, r"(\d{6,})")
    )
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    own = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    is_detail = own.endswith(fv.SITE_HOSTS[fv.SITE_WITH_DETAIL_PAGES]) & path.endswith(fv.DETAIL_PAGE_SUFFIX)
    return F.when(listing_id.isNull() | is_detail, url).otherwise(
        F.concat(F.lit(fv.DETAIL_PAGE), listing_id)
    )


def city_of_address(c: Column) -> Column:
    """City behind a five-digit code, else the whole text."""
    return bind(
        null_if_empty(squeeze(c)), lambda text: F.coalesce(match_or_null(text, r"^\d{5}\s+(.+)$"), text)
    )


def client_address(headers: Column, peer: Column, trust_proxy: bool) -> Column:
    """Caller address out of a header map (names in small letters)."""
    direct = first_filled(peer, F.lit("unknown"))
    if not trust_proxy:
        return direct
    forwarded = null_if_empty(F.try_element_at(headers, F.lit("x-forwarded-for")))
    real = null_if_empty(F.try_element_at(headers, F.lit("x-real-ip")))
    return F.coalesce(F.trim(F.substring_index(forwarded, ",", 1)), F.trim(real), direct)
