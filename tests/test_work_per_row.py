"""Expressions that must not do a step twice for a row, and the same results as before."""

import random
import unicodedata

from pyspark.sql import functions as F

from adlens import fixed_values as fv
from adlens.functions import enums, numbers, text
from adlens.operators import markup
from adlens.operators.embedded_json import parameter_map


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_are_matched_once(spark):
    df = spark.createDataFrame([("x",)], "x string")
    assert _plan(df.select(numbers.decimal_in(F.col("x")).alias("z"))).count(fv.PLAIN_DECIMAL) == 1
    assert _plan(df.select(enums.first_tokens(F.col("x")).alias("z"))).count("regexp_extract(") == 3
    # an empty text in a cast throws and catches an exception
    assert "try_cast(regexp_extract" not in _plan(df.select(numbers.power_with_source(F.col("x")).alias("z")))
    assert "try_cast(regexp_extract" not in _plan(df.select(numbers.engine_with_source(F.col("x")).alias("z")))


def test_reader_price_is_matched_three_times_a_block(spark):
    pages = spark.createDataFrame([("a/b", "t", "r")], "path string, text string, reader_url string")
    # the test, the amount, and what stands before it
    assert _plan(pages.select(markup._ad_blocks(F.col("text")).alias("z"))).count(fv.READER_PRICE) == 3


def test_filter_of_parameters_is_stated_once(spark):
    params = "array<struct<key:string,displayValue:string,value:string>>"
    given = [("a", "1", None), ("", "2", None), ("b", None, "3"), ("a", "", "4"), (None, "5", None)]
    df = spark.createDataFrame([(given,), ([],)], f"p {params}")
    made = df.select(parameter_map(F.col("p")).alias("m"))
    assert [r.m for r in made.collect()] == [{"b": "3", "a": "4"}, {}]
    assert _plan(made).count("filter(") == 2


def test_wide_characters_are_ranges(spark):
    assert text.ranges("xzyab") == r"\x{61}-\x{62}\x{78}-\x{7a}"
    wide = sorted(text.accent_tables()[2])
    df = spark.createDataFrame([(i, f"a{ch}b") for i, ch in enumerate(wide)] + [(-1, "€ – “a” 中 é")], "i int, x string")
    got = {r.i: r.y for r in df.select("i", text.fold_accents(F.col("x")).alias("y")).collect()}
    assert got[-1] == "€ – “a” 中 e"
    for i, ch in enumerate(wide):
        bare = "".join(p for p in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(p))
        assert got[i] == f"a{bare}b"


def test_squeeze_leaves_single_blanks_alone(spark):
    draw = random.Random(7)
    signs = ["a", "é", " ", " ", "\t", "\n", "\u00a0", "\x1c", "\x1f", "\x85", "\u2003", "\u3000"]
    texts = ["".join(draw.choices(signs, k=draw.randrange(12))) for _ in range(400)] + [None]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    every_run = F.trim(F.regexp_replace("x", fv.WHITESPACE + "+", " "))
    plainly = F.when(F.col("x").rlike(fv.CLEAN_TEXT), F.col("x")).otherwise(every_run)
    assert df.where(~text.squeeze(F.col("x")).eqNullSafe(plainly)).count() == 0
    assert df.select(F.regexp_count("x", F.lit(text._RUN)).alias("n")).where("n > 0").count() < len(texts)
    assert spark.range(1).select(F.regexp_count(F.lit("a b c"), F.lit(text._RUN)).alias("n")).first().n == 0


def test_a_section_of_a_page_is_located_once(spark):
    mark = 'data-testid="vip-key-features-list-item-'
    pages = [
        f'é<div {mark}mileage"><h4>x</h4><h4> 10 &amp; km </h4><h4> </h4></div><h4 {mark}power">80 kW</h4>',
        f'{mark}mileage">no <b>heading</b>{mark}mileage"><h4>later</h4>',
        f'<p {mark}mileage" {mark}power"><h4>5</h4>', "<p>none</p>", None,
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    h = F.col("html")
    made = df.select("i", markup.feature_value(h, "mileage").alias("m"), markup.feature_value(h, "power").alias("p"))
    # every time the marker stands in the plan the page is searched once more
    assert _plan(made).count("list-item-mileage") <= 2
    got = {r.i: (r.m, r.p) for r in made.collect()}
    assert got == {
        0: ("10 & km", "80 kW"), 1: ('data-testid="vip-key-features-list-item-mileage">no heading', None),
        2: ('<p data-testid="vip-key-features-list-item-mileage"', "5"), 3: (None, None), 4: (None, None),
    }
    price = df.select("i", markup.text_by_test_id(F.lit('<i data-testid="a">1</i>'), "a", 20).alias("x")).first()
    assert price.x == "1"
    seller = '<a data-testid="seller-title-address"><div class="MainSellerInfo_title__x">Haus &amp; Hof</div> DE-12345 Bad Ort'
    row = spark.createDataFrame([(seller,)], "html string").select(markup.seller_and_city(h).alias("s")).first()
    assert tuple(row.s) == ("Haus & Hof", "Bad Ort")
