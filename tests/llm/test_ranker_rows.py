"""The ranker learns from all labelled rows, however many they are."""

from pyspark.sql import functions as F

from adlens.llm import quality_ranker


def test_pairs_grow_with_the_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(quality_ranker, "PAIRS", 100)
    rows = spark.range(4000).select(
        "id", (F.col("id") % 4 > 0).alias("good"), F.array((F.col("id") % 3).cast("int"), (F.col("id") % 2).cast("int")).alias("x")
    )
    pairs = quality_ranker._pairs(rows, [3, 2], 3000, 1000)
    # every row meets ROUNDS * IN_SLOT others or more on average
    assert pairs.count() > 0.8 * quality_ranker.ROUNDS * quality_ranker.IN_SLOT * 3000
    gaps = {tuple(map(int, r.features.toArray())) for r in pairs.collect()}
    assert all(sum(g[:3]) == 0 and sum(g[3:]) == 0 and max(g) <= 1 for g in gaps) and len(gaps) > 9


def test_no_labelled_row_is_left_out(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_ranker, "cut_lineage", lambda df: seen.append(df.count()) or df)
    monkeypatch.setattr(quality_ranker, "MAX_LABELLED", 50, raising=False)
    rows = spark.range(400).select("id", (F.col("id") % 2 == 0).alias("good"), (F.col("id") % 5).cast("double").alias("v"))
    ranker = quality_ranker.learn(rows, ["v"])
    assert seen[0] == 400 and set(ranker.weights) == {"v"}
