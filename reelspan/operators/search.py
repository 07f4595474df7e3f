"""Vector tables: validation, unit vectors, exact search, index build and checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from reelspan.session import ship

#: One block of query vectors may have so many bytes; more queries are searched block by block.
BLOCK_BYTES = 64_000_000


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def vector_state(vector: Column, dimension: int) -> Column:
    """``ok``, ``missing``, ``dimension``, ``non-finite`` or ``zero``."""
    infinite = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (
        F.when(vector.isNull(), "missing")
        .when(F.size(vector) != dimension, "dimension")
        .when(infinite, "non-finite")
        .when(F.forall(vector, lambda x: x == 0), "zero")
        .otherwise("ok")
    )


def unit_rows(index: DataFrame, row: str = "index_row", vector: str = "embedding", dimension: int = 64) -> DataFrame:
    """(row, unit): the usable vectors at length one, in double precision. Unusable ones are left out."""
    usable = index.where(F.col(row).isNotNull() & (vector_state(F.col(vector), dimension) == "ok"))
    return usable.select(row, norm(F.col(vector)).alias("n"), vector).select(row, F.transform(vector, lambda x: x.cast("double") / F.col("n")).alias("unit"))


def is_unit(vector: Column, tolerance: float = 1e-4) -> Column:
    return F.abs(norm(vector) - 1) <= tolerance


def units(lists: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a list array, and the vectors at length one in double precision."""
    offsets = lists.offsets.to_numpy()
    fit = (np.diff(offsets) == dimension) & ~lists.is_null().to_numpy(zero_copy_only=False)
    rows = np.nonzero(fit)[0]
    values = lists.values.to_numpy(zero_copy_only=False)  # a null is NaN
    matrix = values[offsets[:-1][rows][:, None] + np.arange(dimension)].astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
        matrix = matrix[good]
        matrix /= np.abs(matrix).max(axis=1, initial=0, keepdims=True)  # no square can overflow or vanish
        return rows[good], matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]


@F.arrow_udf(T.DoubleType())
def cosine(left: pa.Array, right: pa.Array) -> pa.Array:
    """Cosines of pairs of vectors, not rounded; null where one of them can't be used or the lengths differ."""
    out = np.full(len(left), np.nan)
    sizes = np.diff(left.offsets.to_numpy())
    for dimension in np.unique(sizes[sizes > 0]).tolist():
        (at, a), (bt, b) = units(left, dimension), units(right, dimension)
        both, i, j = np.intersect1d(at, bt, assume_unique=True, return_indices=True)
        out[both] = np.einsum("ij,ij->i", a[i], b[j])
    return pa.array(out, mask=np.isnan(out))


class Best:
    """The k best rows of each query of a block, kept up to date batch by batch."""

    def __init__(self, queries: int, k: int) -> None:
        self.scores = np.full((queries, k), -np.inf)
        self.rows = np.full((queries, k), -1, dtype=np.int64)
        self.k = k

    def add(self, low: int, scores: np.ndarray, places: np.ndarray, rank: np.ndarray) -> None:
        """``scores`` (queries x rows) of the queries from ``low`` on; of equal scores the lower ``rank`` is better."""
        high = low + len(scores)
        kept, rows = self.scores[low:high], self.rows[low:high]
        most = min(self.k, scores.shape[1])
        bound = np.maximum(kept[:, -1], -np.partition(-scores, most - 1, axis=1)[:, most - 1] if scores.shape[1] > most else -np.inf)
        q, e = np.nonzero(scores >= bound[:, None])  # all that are equal to the last one too
        held_q, held_e = np.nonzero(rows >= 0)
        every_q = np.concatenate([held_q, q])
        every_s = np.concatenate([kept[held_q, held_e], scores[q, e]])
        every_r = np.concatenate([rows[held_q, held_e], places[e]])
        order = np.lexsort((rank[every_r], -every_s, every_q))
        every_q, every_s, every_r = every_q[order], every_s[order], every_r[order]
        begin = np.searchsorted(every_q, np.arange(len(scores)))
        nth = np.arange(len(every_q)) - begin[every_q]
        use = nth < self.k
        self.scores[low + every_q[use], nth[use]] = every_s[use]
        self.rows[low + every_q[use], nth[use]] = every_r[use]


def exact_topk(index: DataFrame, queries: DataFrame, k: int = 10, row: str = "index_row", query: str = "query_row", vector: str = "embedding", dimension: int = 64, decimals: int = 6) -> DataFrame:
    """(query, row, score, rank): the k rows of greatest cosine for each query.

    Scores are rounded; equal ones go to the lower row. The queries are a stated
    set: they are sent out in blocks, each block meets every row where it lies,
    and only each partition's k best of a query are shuffled. Unusable rows and
    queries and those without key take no part; keys may be of any type, that of
    the queries another than that of the rows; fewer than k rows give fewer
    results.
    """
    spark = index.sparkSession
    ship(spark)
    rows = index.where(F.col(row).isNotNull()).select(F.col(row), F.col(vector).cast("array<float>").alias("v"))
    asked = queries.where(F.col(query).isNotNull()).select(F.col(query), F.col(vector).cast("array<float>").alias("v"))
    kinds = f"`{query}` {queries.schema[query].dataType.simpleString()}, `{row}` {index.schema[row].dataType.simpleString()}, score double"
    blocks = max(1, -(-asked.count() * 8 * dimension // BLOCK_BYTES))

    def against(block: pa.Table) -> DataFrame | None:
        block = block.combine_chunks()
        if not block.num_rows:
            return None
        good, unit = units(block.column("v").chunk(0), dimension)
        keys = block.column(query).chunk(0).take(pa.array(good))
        if not len(good):
            return None
        shared = spark.sparkContext.broadcast((keys, unit))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, asked = shared.value
            best, ids = Best(len(asked), k), []
            seen = 0
            for batch in batches:
                good, stored = units(batch.column(1), dimension)
                if not len(good):
                    continue
                # what is kept of the batches before, and this batch
                held = np.unique(best.rows[best.rows >= 0])
                names = pa.concat_arrays([*([ids.take(pa.array(held))] if len(held) else []), batch.column(0).take(pa.array(good))])
                best.rows[best.rows >= 0] = np.searchsorted(held, best.rows[best.rows >= 0])
                ids, places = names, len(held) + np.arange(len(good))
                rank = np.empty(len(names), dtype=np.int64)
                rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
                for low in range(0, len(asked), 512):
                    best.add(low, np.round(asked[low : low + 512] @ stored.T, decimals), places, rank)
                seen += len(good)
            if seen:
                q, e = np.nonzero(best.rows >= 0)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(q)), ids.take(pa.array(best.rows[q, e])), pa.array(best.scores[q, e])], names=[query, row, "score"])

        place = F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), row))
        return rows.mapInArrow(run, kinds).withColumn("rank", place.cast("long")).where(F.col("rank") <= k)

    part = F.pmod(F.xxhash64(query), F.lit(blocks))
    found = [against((asked if blocks == 1 else asked.where(part == n)).toArrow()) for n in range(blocks)]
    found = [f for f in found if f is not None]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], kinds + ", rank bigint")


def built_index(keyframes: DataFrame, features: DataFrame, dimension: int = 64) -> DataFrame:
    """Rows of the index in order (video, ordinal), with the feature row of each keyframe at length one.

    ``features`` has (video_id, clip_row, embedding); ``clip_row`` counts within
    the video. Keyframes without feature row, and feature rows that can't be
    used, are left out. Rows are numbered within each video first and then moved
    by the rows of the videos before it; only one count for each video meets in
    one task.
    """
    usable = features.where(vector_state(F.col("embedding"), dimension) == "ok").select("video_id", "clip_row", "embedding")
    joined = keyframes.where(F.col("clip_row").isNotNull()).join(usable, ["video_id", "clip_row"])
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("keyframe_ordinal", "keyframe_id"))
    numbered = joined.withColumn("p", place)
    sizes = numbered.groupBy("video_id").agg(F.max("p").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("video_id").rowsBetween(Window.unboundedPreceding, -1))
    offset = sizes.select("video_id", F.coalesce(earlier, F.lit(0)).alias("o"))
    length = norm(F.col("embedding"))
    return (
        numbered.join(offset, "video_id")
        .select((F.col("o") + F.col("p") - 1).cast("long").alias("index_row"), "video_id", "keyframe_id", "original_frame_id", "keyframe_path", "object_path", F.transform("embedding", lambda x: (x / length).cast("float")).alias("embedding"))
    )


def index_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that only one of two indexes has, with the side they are on."""
    names = [c for c in expected.columns if c != "embedding"]
    left, right = expected.select(*names, F.xxhash64("embedding").alias("h")), actual.select(*names, F.xxhash64("embedding").alias("h"))
    return left.exceptAll(right).withColumn("side", F.lit("expected")).unionByName(right.exceptAll(left).withColumn("side", F.lit("actual")))


def verified_index(expected: DataFrame, actual: DataFrame, probes: int = 3, k: int = 10) -> DataFrame:
    """(check, n): what differs between an index and its copy; no row if nothing does.

    ``rows``: rows that only one of them has. ``invalid``: rows of the copy whose
    vector isn't usable or not of length one. ``probes``: of the searches for
    ``probes`` rows evenly apart those whose results differ. ``self``: probes
    that do not find themselves first, or something as near.
    """
    from reelspan.operators.ranking import even_positions

    total = F.lit(expected.count())
    chosen = expected.sparkSession.range(1).select(F.explode(even_positions(total, probes)).alias("index_row")).join(expected, "index_row").select(F.col("index_row").alias("query_row"), "embedding")
    here, there = exact_topk(expected, chosen, k), exact_topk(actual, chosen, k)
    first = there.where(F.col("rank") == 1)
    found = {
        "rows": index_differences(expected, actual),
        "invalid": actual.where(~F.coalesce((vector_state(F.col("embedding"), 64) == "ok") & is_unit(F.col("embedding")), F.lit(False))),
        "probes": here.exceptAll(there).unionByName(there.exceptAll(here)).select("query_row").distinct(),
        "self": chosen.select("query_row").join(first.where(F.abs(F.col("score") - 1) <= 1e-5), "query_row", "left_anti"),
    }
    counts = [df.agg(F.lit(name).alias("check"), F.count("*").alias("n")) for name, df in found.items()]
    return reduce(DataFrame.unionByName, counts).where(F.col("n") > 0)


def provenance_faults(hits: DataFrame, index: DataFrame) -> DataFrame:
    """Hits whose video, keyframe, frame or path isn't that of their row in the index, or whose row isn't in it; nulls are equal."""
    names = ["video_id", "keyframe_id", "original_frame_id", "keyframe_path"]
    known = index.select("index_row", F.struct(*names).alias("known"))
    joined = hits.join(known, "index_row", "left")
    same = F.col("known").isNotNull()
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"known.{n}"))
    return joined.where(~same).drop("known")
