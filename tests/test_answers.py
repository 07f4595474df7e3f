import itertools

from pyspark.sql import functions as F

from reelspan.operators import answers, hybrid
from reelspan.operators.config import HybridConfig

WINDOW = "query_id string, video_id string, start_frame long, end_frame long, samples array<long>, score double"


def test_answers_of_windows(spark):
    def engine():  # in here, so that it goes to the workers by value
        def answer(question, description, frames):
            if frames[0] == 7:
                raise ValueError
            return "9\tx" if frames[0] == 8 else f"{len(frames) - 1}\t Red "

        return answer

    prompts = spark.createDataFrame([("q", "A car. What colour?"), ("r", " "), ("s", "Who?")], "query_id string, text string")
    rows = [("q", "v", 0, 20, [1, 10], 0.5), ("q", "v", 5, 20, [5, 10], 0.4), ("q", "w", 0, 9, [7, 8], 0.9), ("q", "w", 8, 9, [8], 0.9), ("r", "v", 0, 9, [1], 0.1), ("t", "v", 0, 9, [1], 0.1)]
    windows = spark.createDataFrame(rows, WINDOW)
    found = answers.hypotheses(prompts, windows, engine)
    assert sorted((r.query_id, r.frame_id, r.raw_answer, r.normalized_answer, r.joint_score) for r in found.collect()) == [("q", 10, "Red", "red", 0.4), ("q", 10, "Red", "red", 0.5)]
    ranked = answers.answered(prompts, windows, engine)
    assert [(r.frame_id, r.joint_score, r["rank"]) for r in ranked.collect()] == [(10, 0.5, 1)]
    became = {r.query_id: (r.parsed, r.windows, r.hypotheses, r.responses) for r in answers.outcomes(prompts, windows, found, ranked).collect()}
    assert became == {"q": (True, 4, 2, 1), "r": (False, 1, 0, 0), "s": (True, 0, 0, 0)}
    assert answers.answered(prompts, windows).count() == 0 and answers.answered(prompts.limit(0), windows, engine).count() == 0


def test_evidence_contract(spark):
    windows = spark.createDataFrame([("q", "v", 0, 20, [1, 10], 0.5), ("q", "v", 5, 9, [6], 0.5), ("q", "w", 0, 9, [12], 0.1)], WINDOW)
    good = answers.frame_evidence(windows)
    assert {(r.video_id, r.fault) for r in answers.evidence_faults(windows, good).collect()} == {("w", "outside")}
    bad = good.where("video_id = 'v'").withColumn("slot", F.col("slot") + F.when(F.col("start_frame") == 0, 0).otherwise(1))
    assert {(r.video_id, r.start_frame, r.fault) for r in answers.evidence_faults(windows, bad).collect()} == {("v", 5, "slots"), ("w", 0, "none")}


HITS = "list_id int, rank long, index_row long, video_id string, frame long, score double"


def test_hybrid_for_a_set_of_queries(spark):
    def load():
        plans = {
            "two events": '{"holistic_visual": null, "visual_clauses": [], "ordered_events": [{"visual": "a", "exact_text": null}, {"visual": "b", "exact_text": null}], "exact_texts": []}',
            "with TEXT": '{"holistic_visual": null, "visual_clauses": [], "ordered_events": [], "exact_texts": ["TEXT"]}',
        }
        return lambda query: plans[query]  # fails on any other

    config = HybridConfig(enabled=True)
    queries = spark.createDataFrame([("e", "two events"), ("t", "with TEXT"), ("f", "no plan"), ("x", " "), (None, "two events")], "query_id string, text string")
    plans = hybrid.planned(queries, load, config)
    got = {r.query_id: (r.fallback, len(r.lists), list(r.exact)) for r in plans.collect()}
    assert got == {"e": (False, 3, []), "t": (False, 1, ["TEXT"]), "f": (True, 1, [])}
    ticks = itertools.count(0, 10)
    late = hybrid.planned(queries, load, config, clock=lambda: next(ticks))
    assert all(r.fallback and len(r.lists) == 1 for r in late.collect())
    hits = spark.createDataFrame([(0, 1, 1, "v", 50, 0.9), (0, 2, 2, "v", 100, 0.8), (1, 1, 3, "w", 10, 0.7), (2, 1, 4, "w", 20, 0.6)], HITS)
    search = lambda texts: texts.drop("depth", "text").join(hits, "list_id")
    match = spark.createDataFrame([("TEXT", 1, 2, "v", 100, 1.0)], "exact_text string, rank long, index_row long, video_id string, frame long, score double")
    found = hybrid.hybrid_set(plans, search, config, lambda texts: texts.join(match, "exact_text"))
    lists = {}
    for r in found.orderBy("query_id", "rank").collect():
        lists.setdefault(r.query_id, []).append((r.index_row, r.fused))
    assert lists["f"] == [(1, False), (2, False)]  # as it was searched
    assert lists["t"] == [(2, True), (1, True)]  # the text match lifts the second
    assert [row for row, _ in lists["e"]][0] == 3  # the whole chain's representative comes first
    assert hybrid.hybrid_set(plans.limit(0), search, config).count() == 0


def test_events_are_searched_and_aligned(spark):
    prompts = spark.createDataFrame([("q", "E1: a E2: b"), ("r", "a"), ("s", "")], "query_id string, text string")
    hits = spark.createDataFrame([("a", 0.9, 1, "v", 10), ("b", 0.8, 2, "v", 30), ("b", 0.7, 3, "v", 5)], "text string, score double, index_row long, video_id string, frame long")
    paths = answers.retrieved_paths(prompts, lambda events: events.join(hits, "text").drop("text"))
    assert {(r.query_id, tuple(r.frames)) for r in paths.collect()} == {("q", (10, 30)), ("r", (10,))}
    assert answers.retrieved_paths(prompts.limit(0), lambda events: events.join(hits, "text").drop("text")).count() == 0
