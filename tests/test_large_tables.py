"""Steps that must not cost more than needed on large tables, and the same rows as before."""

import datetime

from pyspark.sql import functions as F

from adlens.functions import enums
from adlens.operators import dedupe, markup
from adlens.plans import sample_jobs
from adlens.sources import sample_tables


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _card(spark, title, text):
    cards = spark.createDataFrame([(title, text, "https://x?id=7")], "title string, text string, url string")
    return markup.card_listings(cards, []).first()


def test_lines_of_a_card_are_not_walked_one_by_one(spark):
    cards = spark.createDataFrame([("t", "a", "u")], "title string, text string, url string")
    plan = _plan(markup.card_listings(cards, []).select("price_value", "year", "seller_name", "location_city", "make"))
    assert "lambda line" not in plan and "array_position" not in plan
    # the pattern of the line with the technical values, once for all its parts
    assert plan.count("Reparierter Unfallschaden") == 1


def test_odd_cards(spark):
    text = (
        "　\r\nBMW 1 234\n1 234 €\x85EZ 9.999\n  Guter Preis \x1f\n Müller  GmbH Parken\nX Sterne\nHaus 5\n\n"
        "12345\tBad Ort\r\n54321 Ort\nKontakt"
    )
    row = _card(spark, " BMW  1 234 ", text)
    assert (row.title, row.make, row.model, row.version) == ("BMW 1 234", "BMW", "1", "234")
    # the title and lines with the technical values give no price
    assert row.price_value == 1234.0 and row.price_indicator == "Guter Preis"
    assert row.seller_name == "Müller GmbH" and row.location_city == "Bad Ort"
    assert row.first_registration is None and row.year is None

    row = _card(spark, "Opel", "Unfallfrei • EZ 03/2010 · 5.000 km ? 1 kW (50 PS) • Benzin  x\n12345 Ort, Privatanbieter")
    assert (row.first_registration, row.year, row.mileage_km, row.power_hp, row.fuel_type) == ("03/2010", 2010, 5000, 50, "Benzin x")
    assert (row.seller_name, row.location_city, row.price_value) == ("Privatanbieter", "Ort", None)
    # numbers on neighbouring lines are no price; all lines above the address are the title
    row = _card(spark, "Opel", "123\n456\nOpel\nOpel\n12345 Ort")
    assert row.price_value is None and row.seller_name is None
    row = _card(spark, "Opel", None)
    assert (row.price_value, row.seller_name, row.location_city) == (None, None, None)


def test_tokens_of_a_clean_title(spark):
    df = spark.createDataFrame([("a",), ("a b",), ("ä bé c d",), ("",), (None,)], "t string")
    both = df.select(enums.first_tokens(F.col("t")).alias("x"), enums.first_tokens_of_clean(F.col("t")).alias("y"))
    assert both.where("NOT x <=> y").count() == 0


def test_best_rows_are_sorted_by_a_number(spark):
    rows = [("s:1", "s:1", 2, "2020-01-01", 1, "a"), ("s:1", "s:1", 3, "2020-01-01", 2, "b"), (None, "s:2", 1, None, 3, "c"), (None, None, 1, None, 4, "d")]
    df = spark.createDataFrame(rows, "dedupe_exact_key string, source_listing_key string, completeness_score int, scraped_at string, pos int, v string")
    kept = dedupe.keep_best_exact(df, "pos")
    assert "xxhash64(" in _plan(kept)
    assert sorted((r.v, r[dedupe.FIRST_SEEN], r[dedupe.MEMBERS]) for r in kept.collect()) == [("b", 1, 2), ("c", 3, 1), ("d", 4, 1)]
    assert sorted(r.v for r in dedupe.keep_best_exact(df, "pos", ["v"]).collect()) == ["b", "c", "d"]


def _folder(spark, folder):
    day = datetime.date(2000, 1, 2)
    tables = {
        "lineitem": ([(o, 1, 1, n, 10.0, 1000.0 * (o + 1), 0.0, 0.1, "A", "O", day) for o in range(40) for n in (1, 1, 2)],
                     "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double,"
                     " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"),
        "orders": ([(o, day, "1-URGENT") for o in range(40)], "o_orderkey bigint, o_orderdate date, o_orderpriority string"),
        "part": ([(1, "x y", "Brand#1", "PROMO", 10, 950.0)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(1, "S 1", 1)], "s_suppkey bigint, s_name string, s_nationkey int"),
        "nation": ([(1, "FRANCE", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(1, "EUROPE")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_priced_rows_travel_alone(spark, tmp_path):
    folder = _folder(spark, tmp_path)
    narrow = sample_jobs.best_priced(spark, folder)
    assert narrow.columns == sample_jobs.PRICED
    trim, bins = sample_jobs.price_trim(spark, folder).collect(), sample_jobs.target_bins(spark, folder).collect()
    assert (spark.sparkContext.applicationId, folder) not in sample_jobs._STORED
    whole = sample_jobs.best(spark, folder).select(*sample_jobs.PRICED)
    assert whole.exceptAll(narrow).count() == narrow.exceptAll(whole).count() == 0
    assert trim == sample_jobs.price_trim(spark, folder).collect()
    assert sorted(bins) == sorted(sample_jobs.target_bins(spark, folder).collect())


def test_a_file_of_many_splits_is_not_dealt_again(spark, tmp_path):
    folder = _folder(spark, tmp_path)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        assert "Repartition" not in _plan(sample_tables.raw_listings(spark, folder))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
