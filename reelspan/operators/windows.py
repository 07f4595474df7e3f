"""Evidence windows around hits, their refinement, and frame sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelspan.operators.ranking import placed


def sampled_frames(start: Column, end: Column, seeds: Column, samples: int, near: int = 0) -> Column:
    """Seeds, what lies ``near`` them, and ``samples`` frames evenly from start to end; sorted and distinct."""
    if samples < 1:
        raise ValueError("samples must be positive")
    parts = [seeds]
    if near:
        parts += [F.transform(seeds, lambda f: F.greatest(start, f - near)), F.transform(seeds, lambda f: F.least(end, f + near))]
    if samples == 1:
        parts.append(F.array(start))
    else:
        parts.append(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: start + F.floor((end - start) * i / F.lit(samples - 1))))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def _bounds(center: Column, seconds: float) -> tuple[Column, Column]:
    radius = F.greatest(F.lit(1), F.ceil(F.lit(seconds) * F.col("fps") / 2)).cast("long")
    return F.greatest(F.lit(0).cast("long"), center - radius), F.least(F.col("frame_count") - 1, center + radius)


_ORDER = ["raw_ranks", "video_id", "start_frame"]


def _of_videos(df: DataFrame, videos: DataFrame) -> DataFrame:
    known = videos.where(F.col("fps").isNotNull() & ~F.isnan("fps") & F.col("frame_count").isNotNull()).select("video_id", "fps", "frame_count").dropDuplicates(["video_id"])
    return df.join(known, "video_id")


def evidence_windows(hits: DataFrame, videos: DataFrame, seconds: float = 4.0, most: int = 20, seeds_per_video: int = 3, samples: int = 5, near: int = 0) -> DataFrame:
    """Windows around the best hits of each video of a list, with the ranks of the hits in them.

    ``hits``: (query_id, rank, index_row, video_id, frame, score). Hits of an
    unknown video, of one without rate, or beyond its frames take no part.
    """
    inside = _of_videos(hits, videos).where((F.col("frame") >= 0) & (F.col("frame") < F.col("frame_count")))
    by_score = [F.col("score").desc(), F.col("index_row")]
    first = F.row_number().over(Window.partitionBy("query_id", "video_id", "frame").orderBy(*by_score))
    nth = F.row_number().over(Window.partitionBy("query_id", "video_id").orderBy(*by_score))
    seeds = inside.withColumn("_f", first).where(F.col("_f") == 1).withColumn("_n", nth).where(F.col("_n") <= seeds_per_video)
    start, end = _bounds(F.col("frame"), seconds)
    seeds = seeds.select("query_id", "video_id", F.col("frame").alias("center"), F.col("score").alias("top"), start.alias("start_frame"), end.alias("end_frame"))
    members = inside.select("query_id", "video_id", "frame", "rank", "index_row")
    band = seeds.join(members, ["query_id", "video_id"]).where(F.col("frame").between(F.col("start_frame"), F.col("end_frame")))
    windows = band.groupBy("query_id", "video_id", "center", "top", "start_frame", "end_frame").agg(F.array_sort(F.collect_set("rank")).alias("raw_ranks"), F.array_sort(F.collect_set("frame")).alias("frames"))
    centers = seeds.groupBy("query_id", "video_id").agg(F.array_sort(F.collect_set("center")).alias("centers"))
    windows = windows.join(centers, ["query_id", "video_id"])
    windows = windows.withColumn("seeds", F.filter("centers", lambda c: (c >= F.col("start_frame")) & (c <= F.col("end_frame"))))
    windows = windows.withColumn("samples", sampled_frames(F.col("start_frame"), F.col("end_frame"), F.col("frames"), samples, near))
    return placed(windows.select("query_id", "video_id", "start_frame", "end_frame", "seeds", "samples", F.col("top").alias("score"), "raw_ranks"), [F.col("score").desc(), *map(F.col, _ORDER)], most)


def refined_windows(windows: DataFrame, videos: DataFrame, seconds: float = 1.0, most: int = 20, samples: int = 5, near: int = 0) -> DataFrame:
    """Shorter windows around the first seed of each window; scores and ranks stay."""
    joined = _of_videos(windows.drop("rank"), videos)
    joined = joined.withColumn("center", F.element_at("seeds", 1))
    start, end = _bounds(F.col("center"), seconds)
    joined = joined.withColumns({"start_frame": start, "end_frame": end})
    held = F.filter("seeds", lambda c: (c >= F.col("start_frame")) & (c <= F.col("end_frame")))
    joined = joined.withColumn("seeds", F.when(F.size(held) > 0, held).otherwise(F.array("center")))
    joined = joined.withColumn("samples", sampled_frames(F.col("start_frame"), F.col("end_frame"), F.col("seeds"), samples, near))
    return placed(joined.select("query_id", "video_id", "start_frame", "end_frame", "seeds", "samples", "score", "raw_ranks"), [F.col("score").desc(), *map(F.col, _ORDER)], most)


def ranked_answers(hypotheses: DataFrame, limit: int = 100) -> DataFrame:
    """Distinct answers of each query by joint score, then video, frame and normalised answer.

    Hypotheses without joint score, video, frame or answer take no part.
    """
    keys = ["video_id", "frame_id", "normalized_answer"]
    usable = hypotheses.where(F.col("joint_score").isNotNull() & ~F.isnan("joint_score") & F.col("query_id").isNotNull())
    for k in keys:
        usable = usable.where(F.col(k).isNotNull())
    best = usable.groupBy("query_id", *keys).agg(F.max(F.struct("joint_score", "raw_answer")).alias("b"))
    rows = best.select("query_id", *keys, F.col("b.joint_score").alias("joint_score"), F.col("b.raw_answer").alias("raw_answer"))
    return placed(rows, [F.col("joint_score").desc(), *map(F.col, keys)], limit)
