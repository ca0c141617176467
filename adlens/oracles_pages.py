"""SQL for the page jobs: what the pages were built from is what extraction must give back."""

from __future__ import annotations

from adlens.oracles import _raw


def _shown(title: str, mileage: str = "mileage_km", fuel: str = "fuel_type", power: str = "power_hp", extra: str = "",
           price: str = "floor(abs(price_value))") -> str:
    return f"""WITH raw AS ({_raw(False)})
    SELECT CAST(l_partkey AS VARCHAR) || '00' || replace(listing_id, '-', '0') AS listing_id, {title} AS title, make,
      model, {price} AS price_value, CASE WHEN {price} IS NOT NULL THEN 'EUR' END AS currency, year, {mileage} AS mileage_km,
      {power} AS power_hp, {fuel} AS fuel_type, location_city{extra} FROM raw"""


_PRICE = "lpad(CAST(CAST(floor(abs(price_value)) AS BIGINT) AS VARCHAR), 6, '1')"
_LISTED = "CASE WHEN power_hp BETWEEN 30 AND 900 THEN power_hp END"


def _reader() -> str:
    pick = lambda *values: f"[{', '.join(repr(v) for v in values)}][l_partkey % 5 + 1]"
    return f"""WITH raw AS ({_raw(False)})
    SELECT concat_ws(' ', make, model, '2.0 TDI', version) AS title,
      {pick('Mazda', 'Toyota', 'Volkswagen', 'Mercedes-Benz', 'Some Brand')} AS make,
      {pick('CX-5', 'RAV4', 'T-Roc', 'C Class', 'New Car')} AS model, year,
      lpad(CAST(reg_month AS VARCHAR), 2, '0') || '/' || CAST(year AS VARCHAR) AS first_registration,
      coalesce(mileage_km, 0) AS mileage_km, {_LISTED} AS power_hp, 2000 AS engine_capacity_cm3, 'diesel' AS fuel_type,
      CAST({_PRICE} AS DOUBLE) AS price_value, 'Bad Ort' AS location_city,
      'https://img.classistatic.de/' || CAST(l_partkey AS VARCHAR) || '00' || replace(listing_id, '-', '0') AS image_url,
      CASE WHEN power_hp BETWEEN 30 AND 900 THEN 'listing_specs' END AS power_source, 'title_displacement' AS engine_capacity_source,
      {pick('mazda/cx-5', 'toyota/rav-4', 'volkswagen/t-roc', 'mercedes-benz/c-class', 'some-brand/new-car')} AS source_path
    FROM raw"""


def _report() -> str:
    """What makes two ads one: title, year, mileage, power, price; the picture is no part of it."""
    return f"""WITH raw AS ({_raw(False)}),
    ads AS (SELECT l_partkey, l_suppkey, md5(concat_ws('|', make, model, version, year,
        coalesce(mileage_km, 0), coalesce({_LISTED}, -1), {_PRICE})) AS ad FROM raw),
    shown AS (SELECT 'part ' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') AS page, l_partkey AS number, ad FROM ads
      UNION ALL SELECT 'supplier ' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0'), l_suppkey, ad FROM ads),
    pages AS (SELECT DISTINCT page, CASE number % 7 WHEN 0 THEN 'access denied' WHEN 1 THEN 'not found' END AS error FROM shown),
    firsts AS (SELECT min(page) AS page FROM shown WHERE number % 7 > 1 GROUP BY ad),
    report AS (SELECT page, error, CASE WHEN error IS NULL THEN (SELECT count(*) FROM shown WHERE shown.page = pages.page) ELSE 0 END AS rows,
      (SELECT count(*) FROM firsts WHERE firsts.page = pages.page) AS added FROM pages)"""


def statements() -> dict[str, str]:
    plain = "concat_ws(' ', make, model, version)"
    in_range = "CASE WHEN power_hp BETWEEN 30 AND 900 THEN power_hp END"
    return {
        "api_answers": _shown(plain, power=in_range),
        "search_pages": _shown(plain),
        "advert_pages": _shown(plain),
        "detail_pages": _shown("make || ' ' || model || ' & ' || version", power=in_range, extra=""",
            nullif(engine_capacity_cm3, 0) AS engine_capacity_cm3, 'SUV / Pick-up' AS body_type, seller_name,
            CASE WHEN seller_name <> '' THEN 'dealer' END AS seller_type,
            CASE price_indicator WHEN 'A' THEN 'Pret bun' WHEN 'N' THEN 'Guter Preis' ELSE 'Preț ridicat' END AS price_indicator,
            'https://img.classistatic.de/large/' || CAST(l_partkey AS VARCHAR) || '00' || replace(listing_id, '-', '0')
              || '?rule=mo-640&x=1' AS image_url"""),
        "reader_pages": _reader(),
        "extraction_report": _report() + " SELECT page, rows, added, error FROM report",
        "extraction_totals": _report() + """ SELECT sum(added) AS unique_rows, count(*) AS pages_total,
            count(*) FILTER (rows > 0) AS pages_with_rows FROM report""",
        "result_cards": _shown(plain, mileage="coalesce(mileage_km, 0)",
            # a card's price line needs grouped thousands
            price="CASE WHEN floor(abs(price_value)) >= 1000 THEN floor(abs(price_value)) END", extra=", 'Autohaus' AS seller_name, 'Guter Preis' AS price_indicator"),
    }
