"""The stream of best records keeps no copy of its listings beside the arrivals."""

import os

from adlens.operators import dedupe
from adlens.operators.normalize import normalize
from adlens.plans import sample_streams
from adlens.schemas import LISTING_COLUMNS
from adlens.session import checkpoint_folder


def test_stream_of_best_records_stores_listings_once(spark, monkeypatch):
    ads = [(f"src_{i % 2}", str(i % 30), f"t {i}", float(i), "2020-01-01", i) for i in range(90)]
    ads.append(("src_0", None, "x", None, None, 90))
    raw = spark.createDataFrame(ads, "source string, listing_id string, title string, price_value double, scraped_at string, pos int")
    rows = normalize(raw, keep=["pos"])
    monkeypatch.setattr(sample_streams, "listings", lambda spark, folder: rows)
    place = checkpoint_folder(spark).removeprefix("file:")
    stored = lambda: {n for n in os.listdir(place) if n.startswith("table-")}
    before = stored()
    made = sample_streams.best_records_stream(spark, "")
    wanted = dedupe.keep_best_exact(rows, "pos")
    show = lambda df: sorted(str(r) for r in df.select(*LISTING_COLUMNS).collect())
    assert show(made) == show(wanted)
    assert stored() == before
