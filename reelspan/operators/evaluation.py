"""Scores of responses against ground truth, recall at cutoffs, and run comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions.text import judged_form_udf

# The cutoffs of the ranked scores.
CUTOFFS = (1, 5, 20, 50, 100)
MAX_RESPONSES = 100


def frame_score(truth: DataFrame, responses: DataFrame) -> DataFrame:
    """(query_id, rank, score): 1 where a response's frame lies in the true interval of the true video, ends included.

    ``truth``: (query_id, video_id, start, end); ``responses``: (query_id, rank,
    video_id, frame). Responses of queries without truth are left out.
    """
    t = truth.select("query_id", F.col("video_id").alias("tv"), "start", "end")
    hit = (F.col("video_id") == F.col("tv")) & F.col("frame").between(F.col("start"), F.col("end"))
    return responses.join(t, "query_id").select("query_id", "rank", F.when(hit, 1.0).otherwise(0.0).alias("score"))


def answer_score(truth: DataFrame, responses: DataFrame, matcher: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The same, where the response's answer must match one of the true ``answers`` too.

    Without ``matcher`` answers match that are equal case folded and with white
    space collapsed; a matcher gets the columns of the answer and of a true one.
    """
    t = truth.select("query_id", F.col("video_id").alias("tv"), "start", "end", "answers")
    if matcher is None:
        plain = truth.select("query_id", F.explode("answers").alias("a")).select("query_id", judged_form_udf("a").alias("a")).groupBy("query_id").agg(F.collect_set("a").alias("answers"))
        t = t.drop("answers").join(plain, "query_id", "left")
        joined = responses.withColumn("_judged", judged_form_udf("answer")).join(t, "query_id")
        matched = F.array_contains("answers", F.col("_judged"))
    else:
        joined = responses.join(t, "query_id")
        matched = F.exists("answers", lambda a: matcher(F.col("answer"), a))
    hit = (F.col("video_id") == F.col("tv")) & F.col("frame").between(F.col("start"), F.col("end")) & matched
    return joined.select("query_id", "rank", F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0).alias("score"))


def path_score(truth: DataFrame, responses: DataFrame) -> DataFrame:
    """The share of events whose frame lies in its interval; 0 in another video.

    ``truth``: (query_id, video_id, intervals array<struct<start,end>>). A
    response with another number of frames is an error, whatever its video.
    """
    t = truth.select("query_id", F.col("video_id").alias("tv"), "intervals")
    held = F.zip_with("frames", "intervals", lambda f, i: F.when((f >= i["start"]) & (f <= i["end"]), 1.0).otherwise(0.0))
    share = F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size("intervals")
    checked = F.when(F.size("frames") != F.size("intervals"), F.raise_error(F.lit("a response has another number of events than its query")).cast("double"))
    score = checked.otherwise(F.when(F.col("video_id") == F.col("tv"), share).otherwise(0.0))
    return responses.join(t, "query_id").select("query_id", "rank", F.round(score, 9).alias("score"))


def increasing(frames: Column) -> Column:
    """Whether frames are there and strictly increase."""
    pairs = F.zip_with(F.slice(frames, 1, F.size(frames) - 1), F.slice(frames, 2, F.greatest(F.size(frames) - 1, F.lit(0))), lambda a, b: a < b)
    return (F.size(frames) > 0) & F.when(F.size(frames) > 1, F.forall(pairs, lambda x: x)).otherwise(True)


def response_faults(responses: DataFrame, identity: list[str]) -> DataFrame:
    """Queries with more than the allowed number of responses, or with a response twice."""
    counts = responses.groupBy("query_id", *identity).agg(F.count("*").alias("c")).groupBy("query_id").agg(F.sum("c").alias("n"), F.count("*").alias("d"))
    too_many, twice = F.col("n") > MAX_RESPONSES, F.col("n") != F.col("d")
    return counts.where(too_many | twice).select("query_id", F.when(too_many, "too-many").otherwise("duplicate").alias("fault"))


def recall_at(queries: DataFrame, scores: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """query_id, r_<k> for each cutoff, final: the best score within the cutoff, and their mean; 0 for a query without responses."""
    best = scores.groupBy("query_id").agg(*[F.max(F.when(F.col("rank") <= k, F.col("score"))).alias(f"r_{k}") for k in cutoffs])
    joined = queries.select("query_id").distinct().join(best, "query_id", "left")
    filled = joined.select("query_id", *[F.coalesce(f"r_{k}", F.lit(0.0)).alias(f"r_{k}") for k in cutoffs])
    total = sum((F.col(f"r_{k}") for k in cutoffs), F.lit(0.0))
    return filled.withColumn("final", F.round(total / len(cutoffs), 9))


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """One row: the number of queries and the mean of each metric, 0 without queries."""
    names = [c for c in metrics.columns if c != "query_id"]
    return metrics.agg(F.count("*").alias("n_queries"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 9).alias(c) for c in names])


def compared(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Mean of candidate less mean of baseline for each metric; both must have the same queries."""
    names = [c for c in baseline.columns if c != "query_id"]
    both = baseline.join(candidate.select("query_id", *[F.col(c).alias("c_" + c) for c in names], F.lit(True).alias("there")), "query_id", "full")
    alone = F.col("there").isNull() | F.col(names[0]).isNull()
    checked = F.when(F.max(alone.cast("int")) == 1, F.raise_error(F.lit("the runs have different queries")).cast("double"))
    return both.agg(*[checked.otherwise(F.round(F.avg("c_" + c) - F.avg(c), 9)).alias(c) for c in names])


def percentiles(values: DataFrame, value: str) -> DataFrame:
    """p50 and p95 by linear interpolation, exact."""
    return values.agg(F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"))


class TaskFault(ValueError):
    """A task is unknown."""


def evaluated(task: str, queries: DataFrame, truth: DataFrame, responses: DataFrame, matcher: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Recall at the cutoffs and final score of every query of a task: kis, qa or trake. Faulty lists of responses are errors."""
    identity = {"kis": ["video_id", "frame"], "qa": ["video_id", "frame", "answer"], "trake": ["video_id", "frames"]}
    if task not in identity:
        raise TaskFault(f"no such task: {task}")
    faults = response_faults(responses, identity[task]).select("query_id", F.col("fault").alias("_fault"))
    checked = responses.join(faults, "query_id", "left").withColumn("rank", F.when(F.col("_fault").isNotNull(), F.raise_error(F.concat(F.lit("responses of a query: "), F.col("_fault"))).cast("long")).otherwise(F.col("rank"))).drop("_fault")
    scores = {"kis": frame_score, "trake": path_score}[task](truth, checked) if task != "qa" else answer_score(truth, checked, matcher)
    return recall_at(queries, scores)
