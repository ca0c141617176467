"""Files, snapshots, streams and the kNN model on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlens.operators import models as M
from adlens.plans.export import export, refresh_comparables
from adlens.sources import buckets, history, listings, pages, snapshots
from adlens.streaming import ingest
from adlens.streaming.admission import admit_stream


def _ad(i, price, at):
    return {"source": "mobilede", "listing_id": str(i), "url": f"https://x/{i}?a=1", "title": "BMW X3 d", "price_value": price,
            "currency": "EUR", "scraped_at": at, "raw": {"image_url": "u"}}


def _write(path, ads):
    path.write_text("\n\n".join(json.dumps(a) for a in ads) + "\n", encoding="utf-8")


def test_export_round_trip(spark, tmp_path):
    _write(tmp_path / "a.jsonl", [_ad(1, 10.0, "2024-01-01"), _ad(2, 5.0, "2024-01-01")])
    _write(tmp_path / "b.jsonl", [_ad(1, 11.0, "2024-01-01")])
    inputs = [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]
    export(spark, inputs, str(tmp_path / "out"), str(tmp_path / "report"))
    back = {r.listing_id: r for r in listings.read_csv(spark, str(tmp_path / "out")).collect()}
    assert back["1"].price_eur == 11.0 and back["1"].make == "BMW" and back["1"].model == "X3" and back["1"].version == "d"
    assert spark.read.json(str(tmp_path / "report")).first().exact_duplicates_removed == 1


def test_snapshot_moves_after_success(spark, tmp_path):
    _write(tmp_path / "a.jsonl", [_ad(1, 10.0, "2024-01-01")])
    table = str(tmp_path / "pool")
    assert snapshots.current_version(spark, table) is None
    for stamp in ("20240101", "20240102"):
        refresh_comparables(spark, [str(tmp_path / "a.jsonl")], table, stamp)
    assert snapshots.current_version(spark, table).endswith("snapshot=20240102")
    assert snapshots.read_current(spark, table).count() == 1


def test_cached_pages(spark, tmp_path):
    (tmp_path / "audi__a4.md").write_text("x" * 1200)
    (tmp_path / "bmw.md").write_text("x" * 1000)
    assert [r.path for r in pages.read_cached_pages(spark, str(tmp_path)).collect()] == ["audi/a4"]


def test_incremental_best_table(spark, tmp_path):
    raw, table = tmp_path / "raw", str(tmp_path / "best")
    raw.mkdir()
    for n, ads in enumerate([[_ad(1, 10.0, "2024-01-01"), _ad(2, 7.0, "2024-01-01")], [_ad(1, 12.0, "2024-01-02")]]):
        _write(raw / f"{n}.jsonl", ads)
        stream = ingest.normalize_stream(ingest.read_raw_stream(spark, str(raw)))
        ingest.maintain_best(stream, table, str(tmp_path / "state")).awaitTermination()
    best = {r.listing_id: r.price_eur for r in ingest.read_best(spark, table).collect()}
    assert best == {"1": 12.0, "2": 7.0}
    # the second batch wrote the bucket of its listing and no other
    versions = [f.split("/")[-2] for f in buckets.folders(spark, table)]
    assert sorted(versions) == ["batch=000000000000", "batch=000000000001"]


def test_batch_that_is_merged_again_changes_nothing(spark, tmp_path):
    table = str(tmp_path / "best")
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    places = buckets.touched(rows, F.col("k"))
    for _ in range(2):
        buckets.publish(rows, table, "batch=1", F.col("k"), places)
    assert sorted(r.v for r in buckets.read(spark, table, rows.schema).collect()) == [1, 2, 3]
    assert buckets.read(spark, table, rows.schema, before="batch=1").count() == 0


def test_buckets_refuse_what_would_lose_rows(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    with pytest.raises(ValueError):
        buckets.publish(rows, table, "v=1", F.col("k"), [buckets.touched(rows.limit(1), F.col("k"))[0]])
    assert buckets.read(spark, table, rows.schema).count() == 0
    buckets.publish(rows, table, "v=2", F.col("k"))
    with pytest.raises(ValueError):
        buckets.publish(rows, table, "v=3", F.col("k"), buckets=8)
    # a replaced bucket without rows is empty, the other one stays
    buckets.publish(rows.limit(0), table, "v=4", F.col("k"), buckets.touched(rows.where("k = 'a'"), F.col("k")))
    assert [r.k for r in buckets.read(spark, table, rows.schema).collect()] == ["b"]


def test_history_table_rewrites_one_bucket(spark, tmp_path):
    table = str(tmp_path / "history")
    made = history.history_rows(spark.createDataFrame(
        [(1, "2024-01-01", "x"), (1, "2024-01-02", "y"), (2, "2024-01-01", "z"), (None, "2024-01-01", "n")],
        "user_id bigint, created_at string, title string"))
    history.append_history(made, table)
    before = set(buckets.folders(spark, table))
    entry = history.read_history(spark, table, 1).where("title = 'x'").first().id
    assert history.delete_history(spark, table, 2, entry) == 0
    assert set(buckets.folders(spark, table)) == before
    assert history.delete_history(spark, table, 1, entry) == 1
    assert len(before - set(buckets.folders(spark, table))) == 1
    history.append_history(made.where("title = 'z'"), table)
    titles = lambda: sorted(r.title for r in history.read_history(spark, table).collect())
    assert titles() == ["n", "y", "z", "z"]
    assert history.delete_history(spark, table, 2) == 2 and history.delete_history(spark, table, 1) == 1
    assert titles() == ["n"]
    buckets.compact(spark, table, history.HISTORY, F.col("user_id"))
    assert titles() == ["n"] and len(buckets.folders(spark, table)) == 1


def test_snapshots_are_read_in_the_format_they_were_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "a",\nb'), (2, None)], "n int, t string")
    table = str(tmp_path / "t")
    for version, fmt in [("v1", "parquet"), ("v2", "csv"), ("v3", "json")]:
        snapshots.publish(rows, table, version, fmt)
        got = snapshots.read_current(spark, table, rows.schema)
        assert sorted((r.n, r.t) for r in got.collect()) == [(1, 'say "a",\nb'), (2, None)]


def test_late_events_are_decided_in_their_place(spark, tmp_path):
    arrivals, out = str(tmp_path / "arrivals"), str(tmp_path / "decisions")
    schema = "scope string, key string, ts timestamp, event_id bigint"
    # 50, 55 and 105 come in a later file than 100 and 110; the last round ends the stream
    rounds = [[(100, 1), (110, 2)], [(50, 3), (55, 4), (105, 5)], [(100_000, 6)]]
    for events in rounds:
        rows = spark.createDataFrame([("predict", "u", t, i) for t, i in events], "scope string, key string, t bigint, event_id bigint")
        rows.select("scope", "key", F.timestamp_seconds("t").alias("ts"), "event_id").write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(schema).parquet(arrivals)
        admit_stream(stream, {"predict": (2, 60)}).writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option(
            "path", out
        ).option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    found = {r.event_id: (r.allowed, r.ts.second) for r in spark.read.parquet(out).collect()}
    assert {i: ok for i, (ok, _) in found.items()} == {3: True, 4: True, 1: False, 5: False, 2: True}
    assert found[1][1] == 40


def test_history_is_isolated(spark):
    reports = spark.createDataFrame(
        [(1, "2024-01-01T00:00:00+00:00", 14250.0, 10.0)], "user_id bigint, created_at string, predicted_price_eur double, threshold_percent double"
    )
    rows = history.history_rows(reports)
    entry = rows.first()
    assert (entry.source, entry.title, entry.verdict) == ("unknown", "Anunt fara titlu", "unknown")
    assert history.detail(rows, 1, entry.id).count() == 1 and history.detail(rows, 2, entry.id).count() == 0
    assert history.latest(rows, 1).first().threshold_percent == 10.0


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=40), rng.normal(size=40)
    rows = [(f"k{i:02d}", float(x[i]), float(y[i])) for i in range(40)]
    train = spark.createDataFrame(rows[:30], "source_listing_key string, power_hp double, label double")
    test = spark.createDataFrame(rows[30:], "source_listing_key string, power_hp double, label double")
    got = {r[0]: r.prediction for r in M.KnnModel(train, ["power_hp"], 3).transform(test).collect()}
    z = (x - x[:30].mean()) / x[:30].std()
    for i in range(30, 40):
        d = np.abs(z[:30] - z[i])
        near = np.argsort(d)[:3]
        assert abs(got[f"k{i:02d}"] - np.average(y[near], weights=1 / d[near])) < 1e-6


def test_delete_keeps_rows_without_a_user(spark):
    from adlens.sources import history

    rows = spark.createDataFrame([("a", 1), ("b", None), (None, 1), ("c", 2)], "id string, user_id bigint")
    left, removed = history.without(rows, 1, "a")
    assert {(r.id, r.user_id) for r in left.collect()} == {("b", None), (None, 1), ("c", 2)}
    assert removed.first().removed == 1


def test_csv_files_with_other_column_order(spark, tmp_path):
    from adlens.sources import listings

    (tmp_path / "1").mkdir()
    (tmp_path / "10").mkdir()
    (tmp_path / "1" / "x.csv").write_text("make,model\nAudi,A4\n")
    (tmp_path / "10" / "x.csv").write_text("model,make\nA6,Audi\n")
    read = listings.read_csv(spark, [str(tmp_path / "10"), str(tmp_path / "1")])
    got = {(r.make, r.model, r[listings.POSITION].file) for r in read.collect()}
    assert got == {("Audi", "A4", 1), ("Audi", "A6", 0)}


def test_first_named_file_decides_the_kind(spark, tmp_path):
    from adlens.sources import listings

    (tmp_path / "a.jsonl").write_text('{"source_listing_key": "x"}\n')
    (tmp_path / "b.jsonl").write_text('{"url": "y"}\n' * 50)
    assert listings.holds_normalized(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")])
    assert not listings.holds_normalized(spark, [str(tmp_path / "b.jsonl"), str(tmp_path / "a.jsonl")])


def test_many_quantiles_at_once(spark):
    import numpy as np
    from adlens.operators.quantiles import exact_quantiles

    values = [float(x) for x in np.random.default_rng(1).normal(size=30_000).round(3)]
    shares = [i / 100 for i in range(101)]
    got = exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double").repartition(4), [], "v", shares).first().quantiles
    assert np.allclose(got, np.quantile(values, shares), atol=1e-9)
