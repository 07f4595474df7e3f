"""Problem 4: the N best items of every group, with one tie rule.

Method: exact group counts split the groups. Heavy groups, and only they, are cut
into salted ranges of the score at sketched quantiles; the ranges that lie surely
below the N best are left out, each other range keeps its N best, and the N best
of what is left are the group's. Light groups go through an ordinary window. The
two results are united.

Defined results: rows without group or without a finite-or-infinite score (null
or NaN) take no part; repeated rows of one (group, tie columns) count once, with
their best score; a group with fewer than N items keeps all of them; an empty
table gives none; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelspan.session import has_rows, materialise


def top_n(
    df: DataFrame,
    group: str = "video_id",
    score: str = "score",
    ties: Sequence[str] = ("index_row", "query_id"),
    n: int = 10,
    heavy_rows: int = 100_000,
    salts: int = 64,
) -> DataFrame:
    """The N best rows of each group: group, tie columns, score, rank.

    Order: higher score, then the tie columns, each ascending with nulls first.
    """
    usable = df.where(F.col(group).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    items = usable.groupBy(group, *ties).agg(F.max(score).alias("_score"))
    order = [F.col("_score").desc(), *[F.col(t).asc_nulls_first() for t in ties]]

    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    best = lambda rows: rows.select(group, *ties, "_score").withColumn("rank", place).where(F.col("rank") <= n)

    items = materialise(items)
    heavy = items.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > heavy_rows)
    heavy = materialise(heavy)
    if not has_rows(heavy):
        return best(items).withColumnRenamed("_score", score)

    # ranges of the score of the heavy groups only; their number is bounded by rows / heavy_rows
    marked = items.join(heavy, group, "left")
    hot = marked.where(F.col("_n").isNotNull())
    cuts = hot.groupBy(group).agg(F.percentile_approx("_score", [i / salts for i in range(1, salts)], 1000).alias("_cuts"))
    ranged = hot.join(materialise(cuts), group).withColumn("_range", F.expr("size(filter(_cuts, c -> c <= _score))"))
    # the best range that surely holds n items is enough: a cut is off by no more than a thousandth of the group
    sure = F.floor(salts - F.ceil(salts * (F.lit(n) / F.col("_n") + 0.002)) - 1)
    ranged = ranged.where(F.col("_range") >= sure)
    # as many scores may be equal, a salt within the range
    ranged = ranged.withColumn("_salt", F.pmod(F.xxhash64(*ties), F.lit(salts))).drop("_cuts", "_n")
    first = F.row_number().over(Window.partitionBy(group, "_range", "_salt").orderBy(*order))
    kept = ranged.withColumn("_place", first).where(F.col("_place") <= n).select(group, *ties, "_score")

    light = marked.where(F.col("_n").isNull())
    return best(kept).unionByName(best(light)).withColumnRenamed("_score", score)
