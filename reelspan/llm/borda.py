"""Problem 5: one ranking from several differently scaled scores.

Method: Borda count. In every group each score ranks the items (competition
ranks, tied items share the mean of their places, items without the score take
the middle place); an item's points for a score are the number of items less
its place, times the score's weight; the sum of the points ranks the items,
equal sums by identifier.

Groups with more than ``heavy_rows`` items are ranked without gathering them: the
distinct values of a score are counted first, cut into ranges at their quantiles,
and each range adds the counts of the ranges above it.

Defined results: null and NaN are missing scores; rows without group or item
take no part; repeated rows of one (group, item) count once, each score with its
greatest value; a group of one item ranks it first; an empty table gives none;
other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelspan.session import has_rows, materialise

SCORES = ("retrieval_score", "support_score", "agreement_score", "joint_score")


def _clean(df: DataFrame, group: str, item: str, scores: Sequence[str]) -> DataFrame:
    known = [F.when(F.isnan(F.col(s).cast("double")), None).otherwise(F.col(s).cast("double")).alias(s) for s in scores]
    return (
        df.where(F.col(group).isNotNull() & F.col(item).isNotNull())
        .select(F.col(group).alias("g"), F.col(item).alias("i"), *known)
        .groupBy("g", "i")
        .agg(*[F.max(s).alias(s) for s in scores])
    )


def _light(rows: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Add m, and for every score its competition place and its shared place, by windows over the group."""
    whole = Window.partitionBy("g")
    rows = rows.withColumn("m", F.count("*").over(whole))
    for s in scores:
        above = F.rank().over(whole.orderBy(F.col(s).desc_nulls_last()))
        tied = F.count(s).over(Window.partitionBy("g", s))
        rows = rows.withColumn(f"{s}_place", F.when(F.col(s).isNotNull(), above))
        rows = rows.withColumn(f"{s}_shared", F.when(F.col(s).isNotNull(), F.col(f"{s}_place") + (tied - 1) / 2).otherwise((F.col("m") + 1) / 2))
    return rows


def _heavy(rows: DataFrame, counts: DataFrame, scores: Sequence[str], ranges: int) -> DataFrame:
    """The same columns, from counted values instead of gathered groups."""
    rows = items = materialise(rows.join(counts, "g"))
    for s in scores:
        values = items.where(F.col(s).isNotNull()).groupBy("g", F.col(s).alias("v")).agg(F.count("*").alias("c"))
        cuts = values.groupBy("g").agg(F.percentile_approx("v", [k / ranges for k in range(1, ranges)], 1000).alias("cuts"))
        values = values.join(cuts, "g").withColumn("range", F.expr("size(filter(cuts, x -> x < v))")).drop("cuts")
        sums = values.groupBy("g", "range").agg(F.sum("c").alias("t"))
        over = Window.partitionBy("g").orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("g", "range", F.coalesce(F.sum("t").over(over), F.lit(0)).alias("over"))
        inside = Window.partitionBy("g", "range").orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, -1)
        values = values.withColumn("inside", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(sums, ["g", "range"])
        places = values.select("g", F.col("v").alias(s), (F.col("over") + F.col("inside") + 1).alias(f"{s}_place"), "c")
        rows = rows.join(places, ["g", s], "left")
        rows = rows.withColumn(f"{s}_shared", F.when(F.col(s).isNotNull(), F.col(f"{s}_place") + (F.col("c") - 1) / 2).otherwise((F.col("m") + 1) / 2)).drop("c")
    return rows


def borda(
    df: DataFrame,
    group: str = "query_id",
    item: str = "hypothesis_id",
    scores: Sequence[str] = SCORES,
    weights: Mapping[str, float] | None = None,
    heavy_rows: int = 100_000,
    ranges: int = 256,
) -> DataFrame:
    """group, item, m, ``<score>_place`` for every score, points, rank.

    ``<score>_place`` is 1 + the number of items with a higher value, null where
    the score is missing. ``rank`` counts from 1 by points, then item. A heavy
    group's rank is found within ranges of its points.
    """
    weights = {s: 1.0 for s in scores} | dict(weights or {})
    if unknown := set(weights) - set(scores):
        raise ValueError(f"weights for unknown scores: {sorted(unknown)}")
    rows = _clean(df, group, item, scores)
    counts = rows.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > heavy_rows)
    hot = has_rows(counts)
    if hot:
        rows, counts = materialise(rows), materialise(counts)
        heavy = _heavy(rows, counts, scores, ranges)
        rows = rows.join(counts, "g", "left_anti")
    light = _light(rows, scores)
    points = sum((F.lit(float(weights[s])) * (F.col("m") - F.col(f"{s}_shared")) for s in scores), F.lit(0.0))
    columns = ["g", "i", F.col("m").cast("long").alias("m"), *[F.col(f"{s}_place").cast("long").alias(f"{s}_place") for s in scores], points.alias("points")]
    light = light.select(*columns).withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.col("points").desc(), "i")).cast("long"))
    named = lambda ranking: ranking.withColumnRenamed("g", group).withColumnRenamed("i", item)
    if not hot:
        return named(light)
    heavy = materialise(heavy.select(*columns))
    cuts = heavy.groupBy("g").agg(F.percentile_approx("points", [k / ranges for k in range(1, ranges)], 1000).alias("cuts"), F.percentile_approx("i", [k / ranges for k in range(1, ranges)], 1000).alias("ids"))
    # equal points may be many: identifiers cut them again
    heavy = heavy.join(cuts, "g").withColumn("pr", F.expr("size(filter(cuts, x -> x < points))")).withColumn("ir", F.expr("if(array_contains(cuts, points), size(filter(ids, x -> x < i)), 0)")).drop("cuts", "ids")
    return named(light.unionByName(_ranked_in_ranges(heavy).select(*light.columns)))


def _ranked_in_ranges(rows: DataFrame) -> DataFrame:
    """Ranks by points descending, then item: (range of points, points, range of items) in order, each with an offset."""
    cells = rows.groupBy("g", "pr", "points", "ir").agg(F.count("*").alias("t"))
    before = Window.partitionBy("g", "pr").orderBy(F.col("points").desc(), "ir").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("near", F.coalesce(F.sum("t").over(before), F.lit(0)))
    whole = rows.groupBy("g", "pr").agg(F.count("*").alias("t"))
    above = Window.partitionBy("g").orderBy(F.col("pr").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("g", "pr", F.coalesce(F.sum("t").over(above), F.lit(0)).alias("far"))
    cells = cells.drop("t").join(whole, ["g", "pr"])
    inside = F.row_number().over(Window.partitionBy("g", "pr", "points", "ir").orderBy("i"))
    return rows.withColumn("inside", inside).join(cells, ["g", "pr", "points", "ir"]).withColumn("rank", (F.col("inside") + F.col("near") + F.col("far")).cast("long"))


def heads(ranking: DataFrame, group: str = "query_id", item: str = "hypothesis_id", scores: Sequence[str] = SCORES, share: int = 10) -> DataFrame:
    """Of each group the item that every score alone puts among the best ``1 / share``, whatever its rank; of several the best ranked."""
    limit = F.floor(F.col("m") / share)
    sure = F.lit(True)
    for s in scores:
        sure = sure & F.coalesce(F.col(f"{s}_place") <= limit, F.lit(False))
    return ranking.where(sure).groupBy(group).agg(F.min_by(item, "rank").alias(item))
