"""What is moved: joins and shuffles of the plans, beside the results on small tables."""

from pyspark.sql import functions as F

from adlens.operators import lookup, markup, pricing, significance
from adlens.plans.scoring import price_reports
from adlens.sources import buckets


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lookups_over_many_tables_take_two_joins(spark):
    schema = "source string, listing_id string, url string, place int, note string"
    tables = [
        (name, spark.createDataFrame([(name, i, u, p, f"{name}{p}") for i, u, p in rows], schema))
        for name, rows in {
            "a": [("7", "https://x/1", 4), ("7", "https://x/2", 2), (None, "https://x/9", None)],
            "b": [("8", "https://x/3/", 1), ("5", "https://x/4", 3)],
            "c": [("9", "https://x/9", 6), ("5", "https://x/3", 0)],
        }.items()
    ]
    asked = spark.createDataFrame(
        [("https://x/3?q=1", "7"), ("https://x/4", "8"), ("https://x/9", "5"), ("https://x/9", None), (None, "4")],
        "url string, wanted_id string",
    )
    found = lookup.resolve(asked, tables, "place", columns=["note"])
    assert _plan(found).count("Join LeftOuter") == 2
    got = {(r.url, r.wanted_id): (r.listing, r.found_in) for r in found.collect()}
    assert got == {
        ("https://x/3?q=1", "7"): ('{"note":"a2"}', "a"), ("https://x/4", "8"): ('{"note":"b3"}', "b"),
        ("https://x/9", "5"): ('{"note":"b3"}', "b"), ("https://x/9", None): ('{"note":"c6"}', "c"), (None, "4"): (None, None),
    }
    by_place = lookup.resolve(asked, tables, "place", prefer="position", columns=["note"])
    assert {r.listing for r in by_place.where("wanted_id = '8'").collect()} == {'{"note":"b1"}'}
    one = lookup.find_listings(asked, tables[1][1], "place", columns=["note"])
    assert one.schema["listing"].dataType.fieldNames() == ["note"]


def test_metrics_reach_the_estimates_without_moving_them(spark):
    metrics = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, None)], "model string, rmse double, mae double")
    rows = spark.createDataFrame(
        [("k", [("b", 10.0), ("a", 20.0), ("c", 30.0), (None, 5.0)]), ("l", [])],
        "source_listing_key string, model_estimates array<struct<model string, predicted_price_eur double>>",
    )
    found = lookup.estimates_with_metrics(rows, metrics)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.source_listing_key: [tuple(e) for e in r.model_estimates] for r in found.collect()}
    assert got == {"k": [("b", 10.0, 3.0, None), ("a", 20.0, 1.0, 2.0), ("c", 30.0, None, None), (None, 5.0, None, None)], "l": []}


def test_reports_of_listings_that_carry_their_estimates(spark):
    estimate = F.array(pricing.estimate({"model": F.lit("a"), "predicted_price_eur": F.lit(100.0), "mae": F.lit(1.0)}))
    rows = spark.createDataFrame(
        [("k", "s", "u", "t", 100.0), ("l", "s", "u", "t", 200.0)],
        "source_listing_key string, source string, url string, title string, price_eur double",
    )
    carried = price_reports(rows.withColumn("model_estimates", estimate), None, ["make"])
    joined = price_reports(rows, rows.select("source_listing_key", estimate.alias("model_estimates")), ["make"])
    assert "Join" not in _plan(carried)
    assert sorted(map(str, carried.collect())) == sorted(map(str, joined.collect())) and carried.count() == 2


def test_a_table_is_compacted_without_a_shuffle(spark, tmp_path):
    table, key = str(tmp_path / "t"), F.col("id")
    rows = spark.range(200).withColumn("v", F.lit("x"))
    for i in range(2):
        buckets.publish(rows.where(key % 2 == i), table, buckets.next_version(spark, table), key, buckets=4)
    before = len(buckets.folders(spark, table))
    buckets.compact(spark, table, rows.schema, key, buckets=4)
    assert before == 8 and len(buckets.folders(spark, table)) == 4
    assert sorted(r.id for r in buckets.read(spark, table, rows.schema).collect()) == list(range(200))


def test_rows_are_not_moved_by_feature(spark):
    rows = spark.range(500).select(
        (F.col("id") % 7).cast("string").alias("make"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).cast("string").alias("model"),
        (F.col("id") * 10.0).alias("price_eur"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = significance.contingency(rows, ["make", "model"])
        plan = counts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    got = {(r.feature, r.value): r for r in counts.collect()}
    assert got["make", "0"].rows == 72 and got["model", "4"].rows == 67 and len(got) == 12
    assert sum(got["make", "3"][f"bin{b}"] for b in range(5)) == got["make", "3"].rows


def test_pieces_of_a_detail_page_are_read_once(spark):
    page = (
        '<img class="Thumbnail" alt="a &amp; b" src="https://img.classistatic.de/1?x=1&amp;y=2">'
        '<img class="HeroBanner" alt="" src="https://img.classistatic.de/2">'
        '<div class="priceRatingBadge_label__x">Guter Preis</div><div data-testid="seller-title-address">'
        '<a class="DealerScrollLink_x" href="#">Auto <b>A</b></a><div class="MainSellerInfo_address">DE-12345 Bad &amp; Ort</div></div>'
    )
    h = F.col("html")
    pages = spark.createDataFrame([(page,), ("<p>none</p>",), (None,)], "html string")
    read = pages.select(markup.price_rating(h).alias("rating"), markup.seller_and_city(h).alias("seller"), markup.best_image(h).alias("image"))
    # a pattern that stands in a plan many times is matched many times for a row
    plan = pages.select(markup.price_rating(h))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("priceRatingBadge") <= 2
    rows = read.collect()
    assert [r.rating for r in rows] == ["Guter Preis", None, None]
    assert tuple(rows[0].seller) == ("Auto A", "Bad & Ort") and rows[0].image == "https://img.classistatic.de/1?x=1&y=2"
    assert tuple(rows[1].seller) == (None, None) and rows[1].image is None and rows[2].image is None
