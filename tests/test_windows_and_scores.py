import pytest
from pyspark.sql import functions as F

from reelspan.operators import evaluation, windows


def test_sampling(spark):
    row = spark.range(1).select(
        windows.sampled_frames(F.lit(0), F.lit(10), F.array(F.lit(5)), 3).alias("a"),
        windows.sampled_frames(F.lit(0), F.lit(10), F.array(F.lit(9)), 1, near=2).alias("b"),
    ).first()
    assert row.a == [0, 5, 10] and row.b == [0, 7, 9, 10]
    with pytest.raises(ValueError):
        windows.sampled_frames(F.lit(0), F.lit(1), F.array(F.lit(0)), 0)


def test_window_is_clamped_to_the_video_and_refined_on_its_first_seed(spark):
    hits = spark.createDataFrame([("q", 1, 7, "v", 10, 0.9), ("q", 2, 8, "v", 8, 0.8), ("q", 3, 9, "v", 99, 0.7), ("q", 4, 10, "x", 1, 0.6)], "query_id string, rank long, index_row long, video_id string, frame long, score double")
    videos = spark.createDataFrame([("v", 2.5, 11), ("y", None, 5)], "video_id string, fps double, frame_count long")
    out = windows.evidence_windows(hits, videos)
    first = out.orderBy("rank").first()
    assert (first.start_frame, first.end_frame, first.seeds, first.raw_ranks) == (5, 10, [8, 10], [1, 2])
    fine = windows.refined_windows(out, videos).orderBy("rank").first()
    assert (fine.start_frame, fine.end_frame, fine.seeds) == (6, 10, [8, 10])


def test_answers_are_distinct_in_normal_form(spark):
    rows = [("q", "v", 1, "a", "A", 0.5), ("q", "v", 1, "a", "a", 0.7), ("q", "v", 1, "b", "B", None), ("q", "u", 1, "a", "A", 0.7)]
    df = spark.createDataFrame(rows, "query_id string, video_id string, frame_id long, normalized_answer string, raw_answer string, joint_score double")
    assert [(r.video_id, r.raw_answer) for r in windows.ranked_answers(df).orderBy("rank").collect()] == [("u", "A"), ("v", "a")]


def test_scores(spark):
    responses = spark.createDataFrame([("q", 1, "w", 5), ("q", 2, "v", 20), ("q", 3, "v", 21)], "query_id string, rank long, video_id string, frame long")
    truth = spark.createDataFrame([("q", "v", 10, 20), ("empty", "v", 1, 2)], "query_id string, video_id string, start long, end long")
    scores = evaluation.frame_score(truth, responses)
    assert [r.score for r in scores.orderBy("rank").collect()] == [0.0, 1.0, 0.0]
    recall = evaluation.recall_at(truth, scores)
    rows = {r.query_id: r for r in recall.collect()}
    assert (rows["q"].r_1, rows["q"].r_5, rows["q"].final) == (0.0, 1.0, 0.8) and rows["empty"].final == 0.0
    assert evaluation.mean_metrics(recall).first().final == 0.4
    assert evaluation.compared(recall, recall).first().final == 0.0
    with pytest.raises(Exception, match="different queries"):
        evaluation.compared(recall, recall.where("query_id = 'q'")).collect()


def test_path_score(spark):
    truth = spark.sql("select 'q' query_id, 'v' video_id, array(named_struct('start', 1L, 'end', 2L), named_struct('start', 5L, 'end', 6L), named_struct('start', 7L, 'end', 8L), named_struct('start', 9L, 'end', 9L)) intervals")
    responses = spark.createDataFrame([("q", 1, "v", [1, 5, 7, 10]), ("q", 2, "w", [1, 5, 7, 9])], "query_id string, rank long, video_id string, frames array<long>")
    assert [r.score for r in evaluation.path_score(truth, responses).orderBy("rank").collect()] == [0.75, 0.0]
    with pytest.raises(Exception, match="number of events"):
        evaluation.path_score(truth, spark.createDataFrame([("q", 1, "w", [1])], responses.schema)).collect()
    ok = spark.createDataFrame([([1, 2, 3],), ([1, 1],), ([],), ([4],)], "f array<long>").select(evaluation.increasing(F.col("f")).alias("x")).collect()
    assert [r.x for r in ok] == [True, False, False, True]


def test_percentiles_interpolate(spark):
    row = evaluation.percentiles(spark.createDataFrame([(1.0,), (3.0,), (10.0,)], "x double"), "x").first()
    assert row.p50 == 3.0 and abs(row.p95 - 9.3) < 1e-9
