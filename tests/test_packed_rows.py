"""Rows that are packed for a shuffle come back as they were, and only wanted columns travel."""

from pyspark.sql import functions as F

from adlens.operators import dedupe
from adlens.operators.packed import PACKED, pack, unpack
from adlens.plans import sample_jobs
from tests.test_large_tables import _folder


def test_odd_values_come_back(spark):
    schema = "a string, n bigint, b string, x double, y int, f boolean, p struct<q:string>, e string"
    rows = [
        ("plain", 5, "", 0.1, -3, True, ("\x01",), "é 中"),
        (None, None, None, None, None, None, None, None),
        ("a\x01b", 1, "c", float("nan"), 1, False, (None,), ""),
        ("\x02", -(1 << 63), "a\x02", -0.0, 2, None, None, "\\"),
        ("", (1 << 63) - 1, "\n\r\t\"'", float("inf"), 0, True, ("",), " "),
    ]
    df = spark.createDataFrame(rows, schema).withColumn("i", F.monotonically_increasing_id())
    df = df.unionByName(df.limit(1).withColumns({"a": F.unhex(F.lit("ff41")).cast("string"), "i": F.lit(99).cast("bigint")}))
    moved = pack(df, df.columns).select(PACKED).repartition(3)
    back = unpack(moved, PACKED, df.schema, df.columns, [])
    assert back.schema.simpleString() == df.schema.simpleString()
    assert df.exceptAll(back).count() == back.exceptAll(df).count() == 0
    assert back.where("hex(a) = 'FF41'").count() == 1
    one = unpack(pack(df, ["a"]).select(PACKED), PACKED, df.schema, ["a"], [])
    assert sorted(map(str, one.collect())) == sorted(map(str, df.select("a").collect()))
    # most rows are a text: their other form is empty
    assert pack(df, df.columns).where(f"{PACKED}._whole IS NULL").count() == 3


def test_near_copies_travel_with_the_wanted_columns(spark):
    schema = ("source_listing_key string, dedupe_exact_key string, dedupe_fuzzy_key string, completeness_score bigint, "
              "scraped_at string, price_eur double, year bigint, mileage_km bigint, title string, pos bigint")
    rows = [
        ("k1", "k1", "f", 3, "2020-01-01", 1.0, 2000, 5, "a", 1), ("k1", "k1", "f", 4, "2019-01-01", 2.0, None, 5, "b", 2),
        ("k2", None, "f", 4, "2020-01-01", 3.0, 2001, None, "c", 3), ("k3", "", None, 1, None, None, 2001, 5, "d", 4),
        ("k4", "k4", None, 1, None, None, 2001, 5, "e", 5),
    ]
    df = spark.createDataFrame(rows, schema)
    whole = dedupe.deduplicate(df, "pos", fuzzy=True)
    shown = ["price_eur", "year", "mileage_km"]
    narrow = dedupe.deduplicate(df, "pos", fuzzy=True, columns=shown)
    assert narrow.columns == [*shown, dedupe.MEMBERS, dedupe.SURVIVORS]
    assert sorted(map(str, narrow.collect())) == sorted(map(str, whole.select(*narrow.columns).collect()))
    assert dedupe.dedupe_report(narrow).collect() == dedupe.dedupe_report(whole).collect()
    assert sorted(r.title for r in whole.collect()) == ["c", "d", "e"]


def test_only_the_columns_in_use_are_stored(spark, tmp_path):
    folder = _folder(spark, tmp_path)
    place = (spark.sparkContext.applicationId, folder)
    jobs = [sample_jobs.scoring_payload, sample_jobs.verdict_by_label, sample_jobs.lookup_in_order]
    narrow = [sorted(map(str, job(spark, folder).collect())) for job in jobs]
    assert place not in sample_jobs._STORED
    assert all(len(df.columns) < 15 for name, df in sample_jobs._STORED.items() if name[:2] == place)
    sample_jobs.best(spark, folder)
    for name in [n for n in sample_jobs._STORED if n[:2] == place and n != place]:
        del sample_jobs._STORED[name]
    assert narrow == [sorted(map(str, job(spark, folder).collect())) for job in jobs]


def test_a_wider_stored_table_is_read(spark, tmp_path):
    folder = _folder(spark, tmp_path)
    sample_jobs.best(spark, folder, sample_jobs.KEYED)
    before = len(sample_jobs._STORED)
    assert sample_jobs.best_priced(spark, folder).columns == sample_jobs.PRICED
    assert len(sample_jobs._STORED) == before
