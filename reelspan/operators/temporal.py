"""Ordered events: chains within a video, and paths over strictly increasing frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelspan.operators.ranking import placed

MAX_EVENTS = 4


def event_chains(
    hits: DataFrame,
    events: int,
    max_gap: int = 9_000,
    rank_constant: int = 60,
    penalty: float = 0.25,
    bonus: float = 1.0,
    prefer_final: bool = False,
    depth: int = 300,
) -> DataFrame:
    """The best chain of every (query, video), ranked in its query.

    ``hits``: (query_id, event, rank, index_row, video_id, frame), events from 0,
    at most four, each list cut at ``depth``; so the chains of one query come
    from a bounded group. Evidence of a hit is ``1 / (rank_constant + rank)``;
    a chain may begin late or stop early but skips no event between. Hits
    without video or frame take no part; of repeated hits of one (event, row) the
    first counts.

    For every hit there is one chain that ends in it: the longest, then that of
    greatest score, best rank and lowest rows. It is found event by event, by a
    join with the chains that end in the event before.
    """
    if not 0 < events <= MAX_EVENTS:
        raise ValueError(f"ordered alignment has one to {MAX_EVENTS} events")
    usable = hits.where(F.col("video_id").isNotNull() & F.col("frame").isNotNull() & (F.col("rank") <= depth))
    once = usable.groupBy("query_id", "event", "video_id", "index_row").agg(F.min(F.struct("rank", "frame")).alias("h")).select("query_id", "event", "video_id", "index_row", "h.rank", "h.frame")
    evidence = F.lit(1.0) / (F.lit(rank_constant) + F.col("rank"))
    here = F.struct(F.col("rank").alias("rank"), F.col("index_row").alias("row"))
    alone = F.struct(F.lit(-1).alias("shorter"), (-evidence).alias("worse"), here.alias("shown"), F.array("index_row").alias("rows"))
    ends, every = None, []
    for event in range(events):
        own = once.where(F.col("event") == event)
        if ends is None:
            ends = own.select("query_id", "video_id", "frame", here.alias("last"), alone.alias("chain"))
        else:
            before = ends.select(F.col("query_id").alias("from_query"), F.col("video_id").alias("from_video"), F.col("frame").alias("from"), F.col("chain").alias("so_far"))
            gap = F.col("frame") - F.col("from")
            linked = own.join(before, (F.col("query_id") == F.col("from_query")) & (F.col("video_id") == F.col("from_video")) & gap.between(1, max_gap), "left")
            longer = F.struct(
                (F.col("so_far.shorter") - 1).alias("shorter"),
                (-(-F.col("so_far.worse") + evidence - penalty * gap / max_gap)).alias("worse"),
                F.least("so_far.shown", here).alias("shown"),
                F.concat("so_far.rows", F.array("index_row")).alias("rows"),
            )
            best = F.min(F.when(F.col("so_far").isNull(), alone).otherwise(longer))
            ends = linked.groupBy("query_id", "video_id", "frame", "rank", "index_row").agg(best.alias("chain")).select("query_id", "video_id", "frame", here.alias("last"), "chain")
        every.append(ends.withColumn("event", F.lit(event)))
    of_videos = reduce(DataFrame.unionByName, every).withColumn("short", F.col("chain.shorter") > -events)
    best = of_videos.groupBy("query_id", "video_id").agg(F.min(F.struct("short", "chain", "last")).alias("b"))
    whole = ~F.col("b.short")
    found = best.select(
        "query_id",
        "video_id",
        (-F.col("b.chain.shorter")).cast("long").alias("coverage"),
        whole.alias("whole"),
        F.round(-F.col("b.chain.worse") + F.when(whole, bonus).otherwise(0.0), 9).alias("score"),
        F.col("b.chain.shown.rank").alias("best_rank"),
        F.when(whole & F.lit(prefer_final), F.col("b.last.row")).otherwise(F.col("b.chain.shown.row")).alias("shown_row"),
        F.col("b.chain.rows").alias("rows"),
    )
    order = [F.col("whole").desc(), F.col("coverage").desc(), F.col("score").desc(), F.col("best_rank"), F.col("shown_row"), F.col("video_id")]
    return placed(found, order)


def boosted_by_chains(hits: DataFrame, chains: DataFrame, weight: float = 1.0) -> DataFrame:
    """Add a video's chain score to the one row that stands for it, and rank again. Other rows keep their score."""
    best = F.row_number().over(Window.partitionBy("query_id", "video_id").orderBy(F.col("score").desc(), "rank"))
    one = chains.withColumn("_n", best).where(F.col("_n") == 1).select("query_id", F.col("shown_row").alias("index_row"), F.col("score").alias("_c"))
    scored = hits.drop("rank").join(one, ["query_id", "index_row"], "left").withColumn("score", F.round(F.col("score") + weight * F.coalesce("_c", F.lit(0.0)), 9)).drop("_c")
    return placed(scored, [F.col("score").desc(), F.col("index_row")])


def event_paths(hits: DataFrame, events: int, gap_penalty: float = 0.01, candidates: int = 50, max_videos: int = 100, max_paths: int = 100) -> DataFrame:
    """Paths with one hit for each event at strictly increasing frames of one video.

    ``hits``: (query_id, event, score, index_row, video_id, frame). Of each event
    the ``candidates`` best count; videos are taken in the order of their names up
    to ``max_videos``; a video needs every event. Score: the sum of the hits less
    ``gap_penalty`` for each frame between first and last. There is one path for
    each last hit; equal predecessors go to the earlier frames. Order: score
    descending, frames ascending, video descending; equal answers once. At most
    ``candidates`` squared pairs are looked at for an event of a query.
    """
    usable = hits.where(F.col("video_id").isNotNull() & F.col("frame").isNotNull())
    top = F.row_number().over(Window.partitionBy("query_id", "event").orderBy(F.col("score").desc(), "index_row"))
    usable = usable.withColumn("_n", top).where(F.col("_n") <= candidates).drop("_n")
    nth = F.dense_rank().over(Window.partitionBy("query_id").orderBy("video_id"))
    usable = usable.withColumn("_v", nth).where(F.col("_v") <= max_videos).drop("_v")
    of = lambda e: usable.where(F.col("event") == e).select("query_id", "video_id", F.col("frame").alias("f"), F.col("score").alias("s"), F.col("index_row").alias("r"))
    paths = of(0).select("query_id", "video_id", "f", "r", F.col("s").alias("total"), F.array("f").alias("frames"))
    for e in range(1, events):
        before = paths.select("query_id", "video_id", F.col("f").alias("pf"), F.round(F.col("total") + gap_penalty * F.col("f"), 9).alias("worth"), F.col("frames").alias("pframes"))
        pairs = of(e).join(before, ["query_id", "video_id"]).where(F.col("pf") < F.col("f"))
        best = F.row_number().over(Window.partitionBy("query_id", "video_id", "r").orderBy(F.col("worth").desc(), "pframes"))
        paths = (
            pairs.withColumn("_n", best).where(F.col("_n") == 1)
            .select("query_id", "video_id", "f", "r", F.round(F.col("worth") + F.col("s") - gap_penalty * F.col("f"), 9).alias("total"), F.concat("pframes", F.array("f")).alias("frames"))
        )
    once = paths.groupBy("query_id", "video_id", "frames").agg(F.max("total").alias("score"))
    return placed(once, [F.col("score").desc(), F.col("frames"), F.col("video_id").desc()], max_paths)
