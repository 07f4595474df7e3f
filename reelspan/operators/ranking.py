"""Ranked lists: fusion, de-duplication, diversity, re-ranking.

A ranked list has ``query_id``, ``index_row``, ``video_id``, ``frame`` and
``score``; ``rank`` counts from 1. Every order is total: its last columns are
row or identifier. Rows with a null or NaN score, a null query or a null row
are in no list; repeated rows of one (query, row) count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(hits: DataFrame, depth: int = 500) -> DataFrame:
    """The lists with their ranks, each cut at ``depth``: score descending, row ascending."""
    usable = hits.where(F.col("query_id").isNotNull() & F.col("index_row").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    once = usable.groupBy("query_id", "index_row").agg(F.max("score").alias("score"), F.min("video_id").alias("video_id"), F.min("original_frame_id").alias("frame"))
    return placed(once, [F.col("score").desc(), F.col("index_row")], depth)


def placed(rows: DataFrame, order: list[Column], depth: int | None = None, group: str = "query_id", name: str = "rank") -> DataFrame:
    """Add the place in the group by a total order; keep the first ``depth``."""
    rows = rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
    return rows if depth is None else rows.where(F.col(name) <= depth)


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60, decimals: int = 9) -> DataFrame:
    """Weighted: lists (query_id, list_id, weight, rank, index_row, video_id, frame) to one list.

    Order: fused score, then best rank, then row. Weights that are not positive
    and finite are refused when the rows are read.
    """
    bad = F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") <= 0)
    weight = F.when(bad, F.raise_error(F.lit("list weights must be positive"))).otherwise(F.col("weight"))
    fused = lists.groupBy("query_id", "index_row").agg(
        F.round(F.sum(weight / (k + F.col("rank"))), decimals).alias("score"),
        F.min("rank").alias("best_rank"),
        F.min("video_id").alias("video_id"),
        F.min("frame").alias("frame"),
    )
    return placed(fused, [F.col("score").desc(), F.col("best_rank"), F.col("index_row")])


def merged_ranks(lists: DataFrame, k: int = 60, decimals: int = 9) -> DataFrame:
    """Unweighted fusion that keeps the score a row was first seen with.

    Order: fused score, row, video, frame. Input: (query_id, list_id, rank,
    index_row, video_id, frame, score).
    """
    merged = lists.groupBy("query_id", "index_row").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), decimals).alias("fused"),
        F.min_by("score", F.struct("list_id", "rank")).alias("score"),
        F.min("video_id").alias("video_id"),
        F.min("frame").alias("frame"),
    )
    return placed(merged, [F.col("fused").desc(), F.col("index_row"), F.col("video_id"), F.col("frame")])


def temporal_dedup(hits: DataFrame, window: int) -> DataFrame:
    """Walk every list by rank and drop what lies within ``window`` frames of something kept of the same video.

    A window of 0 drops nothing. Lists are cut at their depth before, which
    bounds what one fold walks over.
    """
    if window == 0:
        return hits
    walked = hits.groupBy("query_id", "video_id").agg(F.array_sort(F.collect_list(F.struct("rank", "frame", "index_row", "score"))).alias("w"))

    def step(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda y: F.abs(y["frame"] - x["frame"]) <= window), kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate("w", F.expr("slice(w, 1, 0)"), step)
    return walked.select("query_id", "video_id", F.inline(kept)).select(*hits.columns)


def identity_distinct(hits: DataFrame) -> DataFrame:
    """The first of each (video, frame) of a list."""
    first = F.row_number().over(Window.partitionBy("query_id", "video_id", "frame").orderBy("rank"))
    return hits.withColumn("_n", first).where(F.col("_n") == 1).drop("_n")


def per_video_cap(hits: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` of each video of a list; null keeps all."""
    if most is None:
        return hits
    nth = F.row_number().over(Window.partitionBy("query_id", "video_id").orderBy("rank"))
    return hits.withColumn("_n", nth).where(F.col("_n") <= most).drop("_n")


def responses(hits: DataFrame, window: int = 0, most_per_video: int | None = None, limit: int = 100) -> DataFrame:
    """``raw_rank`` as given and ``final_rank`` after de-duplication, distinct frames, the cap and the limit."""
    final = per_video_cap(identity_distinct(temporal_dedup(hits, window)), most_per_video)
    return placed(final.withColumnRenamed("rank", "raw_rank"), [F.col("raw_rank")], limit, name="final_rank")


def best_text_matches(matches: DataFrame, limit: int | None = None) -> DataFrame:
    """Of each (query, row) the best match; order score, exact first, confidence, row."""
    order = [F.col("score").desc(), F.col("exact").desc(), F.col("confidence").desc()]
    best = F.row_number().over(Window.partitionBy("query_id", "index_row").orderBy(*order))
    once = matches.withColumn("_n", best).where(F.col("_n") == 1).drop("_n")
    return placed(once, [*order, F.col("index_row")], limit)


def boosted_by_text(hits: DataFrame, matches: DataFrame, weight: float) -> DataFrame:
    """Score plus ``weight`` times the text match of the row, ranked again."""
    added = hits.drop("rank").join(matches.select("query_id", "index_row", F.col("score").alias("_m")), ["query_id", "index_row"], "left")
    scored = added.withColumn("score", F.round(F.col("score") + weight * F.coalesce("_m", F.lit(0.0)), 9)).drop("_m")
    return placed(scored, [F.col("score").desc(), F.col("index_row")])


def object_consistency(labels: DataFrame, plans: DataFrame) -> DataFrame:
    """(query_id, index_row, consistency): mean over the required labels of the greatest confidence, less the greatest of an excluded one.

    ``labels``: (query_id, index_row, label, score) of the shortlist's detections;
    ``plans``: (query_id, required, excluded), arrays of labels.
    """
    best = labels.groupBy("query_id", "index_row", "label").agg(F.max("score").alias("s"))
    named = best.groupBy("query_id", "index_row").agg(F.map_from_entries(F.collect_list(F.struct("label", "s"))).alias("m"))
    confidence = lambda label: F.coalesce(F.element_at("m", label), F.lit(0.0))
    wanted = F.when(F.size("required") > 0, F.aggregate("required", F.lit(0.0), lambda a, x: a + confidence(x)) / F.size("required")).otherwise(0.0)
    unwanted = F.coalesce(F.array_max(F.transform("excluded", confidence)), F.lit(0.0))
    return named.join(plans, "query_id").select("query_id", "index_row", F.round(wanted - unwanted, 9).alias("consistency"))


def object_vocabulary(labels: DataFrame, limit: int = 64) -> DataFrame:
    """(query_id, label, total, rank): of each query's shortlist the labels with the greatest summed score; equal sums by label."""
    sums = labels.groupBy("query_id", "label").agg(F.round(F.sum("score"), 6).alias("total"))
    return placed(sums, [F.col("total").desc(), F.col("label")], limit)


def contrastive(shortlist: DataFrame, cosines: DataFrame, consistency: DataFrame, positive: float, negative: float, objects: float) -> DataFrame:
    """base + positive * cos(pos) - negative * max cos(neg) + objects * consistency; equal scores keep their order.

    ``cosines``: (query_id, index_row, side, cosine), side ``positive`` or
    ``negative``. A plan without negatives or objects adds 0 for them.
    """
    sides = cosines.groupBy("query_id", "index_row").agg(
        F.max(F.when(F.col("side") == "positive", F.col("cosine"))).alias("p"), F.max(F.when(F.col("side") == "negative", F.col("cosine"))).alias("n")
    )
    joined = shortlist.join(sides, ["query_id", "index_row"], "left").join(consistency, ["query_id", "index_row"], "left")
    zero = F.lit(0.0)
    score = F.col("score") + positive * F.coalesce("p", zero) - negative * F.coalesce("n", zero) + objects * F.coalesce("consistency", zero)
    rescored = joined.withColumn("score", F.round(score, 9)).drop("p", "n", "consistency").withColumnRenamed("rank", "base_rank")
    return placed(rescored, [F.col("score").desc(), F.col("base_rank")])


def even_positions(n: Column, count: int) -> Column:
    """``count`` places of 0 .. n - 1 evenly apart, half to even, distinct; one place is the middle."""
    if count == 1:
        return F.array(F.floor(n / 2).cast("long"))
    steps = F.sequence(F.lit(0), F.lit(count - 1))
    places = F.transform(steps, lambda i: F.rint(i * (n - 1) / F.lit(count - 1)).cast("long"))
    return F.when(n <= count, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array_distinct(places))
