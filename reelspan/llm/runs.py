"""Problem 1: repeated consecutive events become one event with count and duration.

Method: each event gets a canonical value, and within an entity the difference
between its row number and its row number among equal canonical values is
constant along a run.

Readings are dealt to parts of ``part_span`` numbers of the order column. An order
number has one reading, so no part of an entity holds more than that many,
however hot the entity. Parts are joined by their first and last readings and
their counts: chains, votes and both row numbers go on over every cut, so the
size of the parts changes nothing in the result.

Canonical value. Neighbouring readings whose folded texts hold the same digits
and lie within ``2 * max_faults`` edits of each other can both be readings of
one caption with at most ``max_faults`` faults each. Folded texts that a chain of
such neighbours holds several times, and that lie further than ``max_faults`` from
each other, are its captions; each reading takes the nearest within
``2 * max_faults`` as its value, since the text held most often can have faults
itself. Where no text is held twice the greatest stands for those near to it.

Defined results: rows without entity, order or text (null, or nothing but
spaces and invisible characters) are passed over and don't end a run; repeated
rows of one (entity, order) count once, the latest received, then the greatest
text; an empty table gives no runs; other columns don't matter.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from reelspan.llm.transducer import fold
from reelspan.session import materialise, ship


@F.pandas_udf(T.StringType())
def folded(texts: pd.Series) -> pd.Series:
    return pd.Series([fold(t) or (t or "").strip() for t in texts], dtype=object)


def _same(left: str, right: str, edits: int):
    """Whether two folded texts can be readings of one caption."""
    digits = lambda c: F.regexp_replace(F.col(c), "[^0-9]", "")
    near = F.levenshtein(F.col(left), F.col(right), edits) >= 0
    return (F.col(left) == F.col(right)) | ((digits(left) == digits(right)) & near)


def readings(df: DataFrame, entity: str, order: str, text: str, received: str) -> DataFrame:
    """(entity, at, raw): one row for each reading that holds text."""
    visible = F.regexp_replace(F.col(text), "(?U)[\\s\\p{Cf}]+", "")
    return (
        df.where(F.col(entity).isNotNull() & F.col(order).isNotNull() & (F.length(visible) > 0))
        .select(F.col(entity).alias("entity"), F.col(order).cast("long").alias("at"), F.struct(F.col(received).alias("r"), F.col(text).alias("t")).alias("v"))
        .groupBy("entity", "at")
        .agg(F.max("v").getField("t").alias("raw"))
    )


def _chained(rows: DataFrame, edits: int) -> DataFrame:
    """Add ``chain``, counted along the whole entity: it goes on where a reading and the one before can show one caption."""
    along = Window.partitionBy("entity", "part").orderBy("at")
    before = F.lag("key").over(along)
    rows = rows.withColumn("before", before).withColumn("new", F.when(F.col("before").isNull(), 0).when(_same("before", "key", edits), 0).otherwise(1))
    parts = rows.groupBy("entity", "part").agg(F.sum("new").alias("news"), F.min_by("key", "at").alias("head"), F.max_by("key", "at").alias("tail"))
    by_part = Window.partitionBy("entity").orderBy("part")
    # between parts: whether the first reading of one goes on with the last of the one before
    parts = parts.withColumn("last", F.lag("tail").over(by_part)).withColumn("opens", F.when(F.col("last").isNull(), 0).when(_same("last", "head", edits), 0).otherwise(1))
    first = F.sum("opens").over(by_part.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("news").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("entity", "part", first.alias("first"))
    within = F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("within", within).join(offsets, ["entity", "part"]).select("entity", "part", "at", "key", (F.col("first") + F.col("within")).alias("chain"))


def _captions(chained: DataFrame, max_faults: int) -> DataFrame:
    """(entity, part, chain, captions, winner) for every part a chain lies in.

    ``captions``: of the texts the chain holds several times, most frequent
    first, those not near to one before. ``winner``: its greatest text. Votes are
    counted before they are brought together.
    """
    held = chained.groupBy("entity", "part", "chain", "key").agg(F.count("*").alias("votes"))
    votes = held.groupBy("entity", "chain", "key").agg(F.sum("votes").alias("votes"))
    several = F.collect_list(F.when(F.col("votes") > 1, F.struct("votes", "key")))
    ordered = votes.groupBy("entity", "chain").agg(F.sort_array(several, asc=False).getField("key").alias("keys"), F.max("key").alias("winner"))
    known = lambda kept, key: F.exists(kept, lambda c: F.levenshtein(c, key, max_faults) >= 0)
    captions = F.aggregate("keys", F.array().cast("array<string>"), lambda kept, key: F.when(known(kept, key), kept).otherwise(F.concat(kept, F.array(key))))
    of_chains = ordered.select("entity", "chain", captions.alias("captions"), "winner")
    # a chain may hold a third of all rows: it is given to its parts, then to their rows
    return held.select("entity", "part", "chain").distinct().join(of_chains, ["entity", "chain"])


def runs(
    df: DataFrame,
    entity: str = "video_id",
    order: str = "frame_id",
    text: str = "raw_text",
    received: str = "received_at",
    max_faults: int = 2,
    part_span: int = 50_000,
) -> DataFrame:
    """One row for each run: entity, caption, n, first_at, last_at, duration.

    ``caption`` is the folded text the run's readings agree on; ``duration`` is
    ``last_at - first_at``.
    """
    ship(df.sparkSession)
    edits = 2 * max_faults
    rows = readings(df, entity, order, text, received)
    rows = materialise(rows.select("entity", F.floor(F.col("at") / part_span).alias("part"), "at", folded("raw").alias("key")))
    chained = materialise(_chained(rows, edits))
    near = F.transform("captions", lambda c, i: F.struct(F.levenshtein(c, F.col("key"), edits).alias("d"), i.alias("i"), c.alias("c")))
    valued = chained.join(_captions(chained, max_faults), ["entity", "part", "chain"])
    voted = F.array_min(F.filter(near, lambda c: c["d"] >= 0))["c"]
    single = (F.size("captions") == 0) & _same("key", "winner", edits)
    valued = valued.select("entity", "part", "at", F.coalesce(voted, F.when(single, F.col("winner")).otherwise(F.col("key"))).alias("value"))
    # equal differences between the two row numbers are one run: first within parts, then with what the parts before hold
    rank = F.row_number().over(Window.partitionBy("entity", "part").orderBy("at"))
    own = F.row_number().over(Window.partitionBy("entity", "part", "value").orderBy("at"))
    numbered = valued.withColumn("island", rank - own)
    pieces = numbered.groupBy("entity", "part", "value", "island").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    shares = pieces.groupBy("entity", "part", "value").agg(F.sum("n").alias("n"))
    earlier = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_before = shares.groupBy("entity", "part").agg(F.sum("n").alias("n")).select("entity", "part", earlier("entity").alias("all"))
    own_before = shares.select("entity", "part", "value", earlier("entity", "value").alias("own"))
    whole = pieces.join(own_before, ["entity", "part", "value"]).join(all_before, ["entity", "part"]).withColumn("island", F.col("island") + F.col("all") - F.col("own"))
    found = whole.groupBy("entity", "value", "island").agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    return found.select("entity", F.col("value").alias("caption"), "n", "first_at", "last_at", (F.col("last_at") - F.col("first_at")).alias("duration"))
