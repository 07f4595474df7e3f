import math

import pytest

from reelspan.operators import ranking

HIT = "query_id string, index_row long, video_id string, original_frame_id long, score double"


def listed(spark, rows):
    return spark.createDataFrame(rows, "query_id string, rank long, index_row long, video_id string, frame long, score double")


def test_ranked_orders_by_score_then_row_and_drops_unusable(spark):
    rows = [("q", 3, "v", 1, 0.5), ("q", 1, "v", 2, 0.5), ("q", 2, None, 3, 0.9), ("q", 2, None, 3, 0.9), ("q", 4, "v", 4, None), ("q", 5, "v", 5, math.nan), (None, 6, "v", 6, 1.0)]
    out = ranking.ranked(spark.createDataFrame(rows, HIT)).orderBy("rank").collect()
    assert [r.index_row for r in out] == [2, 1, 3]
    assert ranking.ranked(spark.createDataFrame([], HIT)).count() == 0


def test_fusion_prefers_score_then_best_rank_then_row(spark):
    schema = "query_id string, list_id int, weight double, rank long, index_row long, video_id string, frame long, score double"
    rows = [("q", 0, 1.0, 1, 1, "v", 1, 0.9), ("q", 0, 1.0, 2, 0, "v", 2, 0.8), ("q", 1, 1.0, 1, 0, "v", 2, 0.7), ("q", 1, 1.0, 2, 1, "v", 1, 0.6), ("q", 1, 1.0, 3, 2, "v", 3, 0.5)]
    df = spark.createDataFrame(rows, schema)
    assert [r.index_row for r in ranking.reciprocal_rank_fusion(df).orderBy("rank").collect()] == [0, 1, 2]
    merged = {r.index_row: r for r in ranking.merged_ranks(df).collect()}
    assert merged[0].score == 0.8 and merged[1].score == 0.9
    with pytest.raises(Exception, match="positive"):
        ranking.reciprocal_rank_fusion(spark.createDataFrame([("q", 0, 0.0, 1, 1, "v", 1, 0.9)], schema)).collect()


def test_greedy_dedup_compares_with_what_was_kept(spark):
    rows = [("q", 1, 1, "v", 100, 0.9), ("q", 2, 2, "v", 108, 0.8), ("q", 3, 3, "v", 115, 0.7), ("q", 4, 4, "w", 100, 0.6), ("q", 5, 5, None, 1, 0.5), ("q", 6, 6, None, 2, 0.4)]
    df = listed(spark, rows)
    assert sorted(r.index_row for r in ranking.temporal_dedup(df, 10).collect()) == [1, 3, 4, 5]
    assert ranking.temporal_dedup(df, 0).count() == 6


def test_responses_keep_raw_rank(spark):
    rows = [("q", 1, 0, "a", 10, 0.9), ("q", 2, 1, "a", 15, 0.8), ("q", 3, 2, "b", 12, 0.7), ("q", 4, 3, "a", 100, 0.6)]
    out = ranking.responses(listed(spark, rows), window=10, most_per_video=1).orderBy("final_rank").collect()
    assert [(r.index_row, r.raw_rank, r.final_rank) for r in out] == [(0, 1, 1), (2, 3, 2)]


def test_even_positions_round_half_to_even(spark):
    from pyspark.sql import functions as F

    df = spark.range(1).select(ranking.even_positions(F.lit(6), 3).alias("a"), ranking.even_positions(F.lit(2), 5).alias("b"), ranking.even_positions(F.lit(5), 1).alias("c"))
    row = df.first()
    assert (row.a, row.b, row.c) == ([0, 2, 5], [0, 1], [2])


def test_objects_change_the_order(spark):
    labels = spark.createDataFrame([("q", 1, "bus", 0.9), ("q", 1, "boat", 0.4), ("q", 2, "bus", 0.2), ("q", 2, "bus", 0.5)], "query_id string, index_row long, label string, score double")
    plans = spark.createDataFrame([("q", ["bus", "dog"], ["boat"])], "query_id string, required array<string>, excluded array<string>")
    found = {r.index_row: r.consistency for r in ranking.object_consistency(labels, plans).collect()}
    assert found == {1: 0.05, 2: 0.25}
    assert [(r.label, r.total) for r in ranking.object_vocabulary(labels).orderBy("rank").collect()] == [("bus", 1.6), ("boat", 0.4)]
    short = listed(spark, [("q", 1, 1, "v", 1, 0.5), ("q", 2, 2, "v", 2, 0.5), ("q", 3, 3, "v", 3, 0.5)])
    cosines = spark.createDataFrame([("q", 1, "negative", 0.3), ("q", 1, "negative", 0.1), ("q", 2, "positive", 0.1)], "query_id string, index_row long, side string, cosine double")
    out = ranking.contrastive(short, cosines, ranking.object_consistency(labels, plans), 1.0, 1.0, 0.0).orderBy("rank").collect()
    assert [r.index_row for r in out] == [2, 3, 1]


def test_text_matches(spark):
    schema = "query_id string, index_row long, score double, exact boolean, confidence double"
    rows = [("q", 2, 0.9, False, 0.9), ("q", 1, 0.9, True, 0.5), ("q", 1, 0.8, True, 0.9), ("q", 3, 0.9, True, 0.6)]
    best = ranking.best_text_matches(spark.createDataFrame(rows, schema), 2).orderBy("rank").collect()
    assert [r.index_row for r in best] == [3, 1]
