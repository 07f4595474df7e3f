"""Retrieval, fusion, alignment and windows over the hit and index tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelspan.operators import ranking, search, temporal, windows
from reelspan.session import materialise, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(make):
        QUERIES[make.__name__] = make
        if sql:
            ORACLE_SQL[make.__name__] = sql
        return make

    return keep


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(table(spark, sf_dir, "search_hits"))


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three neighbouring queries are the lists of one pack."""
    number = F.regexp_extract("query_id", r"(\d+)", 1).cast("long")
    weights = F.element_at(F.array(F.lit(2.0), F.lit(1.5), F.lit(1.0)), (number % 3 + 1).cast("int"))
    return hits(spark, sf_dir).select(
        F.concat(F.lit("pack-"), F.floor(number / 3).cast("string")).alias("query_id"), (number % 3).alias("list_id"), weights.alias("weight"),
        "rank", "index_row", "video_id", "frame", "score",
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every row whose number is divisible by 20."""
    index = table(spark, sf_dir, "index_vectors")
    return index.where(F.col("index_row") % 20 == 0).select(F.col("index_row").alias("query_row"), "embedding")


_HITS = """
WITH RECURSIVE once AS (
  SELECT query_id, index_row, max(score) AS score, min(video_id) AS video_id, min(original_frame_id) AS frame FROM search_hits
  WHERE query_id IS NOT NULL AND index_row IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY query_id, index_row),
hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, index_row) AS rank FROM once) WHERE rank <= 500)
"""
_LISTS = (
    _HITS
    + """, lists AS (
  SELECT 'pack-' || CAST(n // 3 AS VARCHAR) AS query_id, n % 3 AS list_id, CASE n % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 1.5 ELSE 1.0 END::DOUBLE AS weight, rank, index_row, video_id, frame, score
  FROM (SELECT *, CAST(regexp_extract(query_id, '(\\d+)', 1) AS BIGINT) AS n FROM hits))
"""
)
_VECTORS = """
WITH usable AS (
  SELECT index_row, embedding::DOUBLE[] AS e FROM index_vectors
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
"""


@query(
    _VECTORS
    + """, scored AS (
  SELECT q.index_row AS query_row, r.index_row, round(list_cosine_similarity(q.e, r.e), 6) AS score FROM usable q, usable r WHERE q.index_row % 20 = 0)
SELECT query_row, index_row, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, index_row) AS rank FROM scored) WHERE rank <= 10"""
)
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact_topk(table(spark, sf_dir, "index_vectors"), query_vectors(spark, sf_dir))


@query(
    """SELECT CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'dimension'
  WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'non-finite'
  WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'zero' ELSE 'ok' END AS state, count(*) AS n FROM index_vectors GROUP BY 1"""
)
def vector_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "index_vectors").groupBy(search.vector_state(F.col("embedding"), 64).alias("state")).agg(F.count("*").alias("n"))


@query(_VECTORS + "SELECT index_row, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm FROM usable")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "index_vectors")
    usable = index.where(search.vector_state(F.col("embedding"), 64) == "ok")
    return usable.select("index_row", F.round(search.norm(F.col("embedding")), 6).alias("norm"))


@query(_HITS + "SELECT query_id, index_row, score, rank FROM hits")
def ranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("query_id", "index_row", "score", "rank")


@query(
    _LISTS
    + """, fused AS (SELECT query_id, index_row, round(sum(weight / (60 + rank)), 9) AS score, min(rank) AS best_rank FROM lists GROUP BY 1, 2)
SELECT query_id, index_row, score, best_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, index_row) AS rank FROM fused"""
)
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.reciprocal_rank_fusion(lists(spark, sf_dir)).select("query_id", "index_row", "score", "best_rank", "rank")


@query(
    _LISTS
    + """, fused AS (SELECT query_id, index_row, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, arg_min(score, list_id * 1000000 + rank) AS score FROM lists GROUP BY 1, 2)
SELECT query_id, index_row, fused, score, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, index_row) AS rank FROM fused"""
)
def rrf_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.merged_ranks(lists(spark, sf_dir)).select("query_id", "index_row", "fused", "score", "rank")


_DEDUP = (
    _HITS
    + """, ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY rank) AS pos FROM hits),
walk AS (
  SELECT query_id, video_id, pos, index_row, rank, frame, score, [frame] AS kept, true AS keep FROM ordered WHERE pos = 1
  UNION ALL
  SELECT o.query_id, o.video_id, o.pos, o.index_row, o.rank, o.frame, o.score,
    CASE WHEN len(list_filter(w.kept, lambda x: abs(x - o.frame) <= 100)) > 0 THEN w.kept ELSE list_append(w.kept, o.frame) END,
    len(list_filter(w.kept, lambda x: abs(x - o.frame) <= 100)) = 0
  FROM walk w JOIN ordered o ON o.query_id = w.query_id AND o.video_id IS NOT DISTINCT FROM w.video_id AND o.pos = w.pos + 1),
dedup AS (SELECT query_id, video_id, index_row, rank, frame, score FROM walk WHERE keep)
"""
)


@query(_DEDUP + "SELECT query_id, index_row, rank FROM dedup")
def temporal_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.temporal_dedup(hits(spark, sf_dir), 100).select("query_id", "index_row", "rank")


@query(_HITS + "SELECT query_id, index_row, rank FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, video_id, frame ORDER BY rank) = 1")
def identity_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.identity_distinct(hits(spark, sf_dir)).select("query_id", "index_row", "rank")


@query(_HITS + "SELECT query_id, index_row, rank FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, video_id ORDER BY rank) <= 2")
def per_video_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.per_video_cap(hits(spark, sf_dir), 2).select("query_id", "index_row", "rank")


_RESPONSES = (
    _DEDUP
    + """, ident AS (SELECT * FROM dedup QUALIFY row_number() OVER (PARTITION BY query_id, video_id, frame ORDER BY rank) = 1),
capped AS (SELECT * FROM ident QUALIFY row_number() OVER (PARTITION BY query_id, video_id ORDER BY rank) <= 3),
answers AS (SELECT query_id, index_row, video_id, frame, rank AS raw_rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS final_rank FROM capped QUALIFY final_rank <= 100)
"""
)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.responses(hits(spark, sf_dir), window=100, most_per_video=3)


@query(_RESPONSES + "SELECT query_id, index_row, raw_rank, final_rank FROM answers")
def kis_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("query_id", "index_row", "raw_rank", "final_rank")


def event_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists(spark, sf_dir).withColumn("event", F.col("list_id"))


@query(
    _LISTS
    + """, top AS (SELECT * FROM lists WHERE video_id IS NOT NULL AND frame IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, list_id ORDER BY score DESC, index_row) <= 50),
vids AS (SELECT * FROM top QUALIFY dense_rank() OVER (PARTITION BY query_id ORDER BY video_id) <= 100),
p0 AS (SELECT query_id, video_id, frame AS f, score AS total, [frame] AS frames FROM vids WHERE list_id = 0),
p1 AS (
  SELECT h.query_id, h.video_id, h.frame AS f, round(worth + h.score - 0.01::DOUBLE * h.frame, 9) AS total, list_append(p.frames, h.frame) AS frames
  FROM vids h JOIN (SELECT *, round(total + 0.01::DOUBLE * f, 9) AS worth FROM p0) p ON h.query_id = p.query_id AND h.video_id = p.video_id AND p.f < h.frame WHERE h.list_id = 1
  QUALIFY row_number() OVER (PARTITION BY h.query_id, h.video_id, h.index_row ORDER BY worth DESC, p.frames) = 1),
p2 AS (
  SELECT h.query_id, h.video_id, h.frame AS f, round(worth + h.score - 0.01::DOUBLE * h.frame, 9) AS total, list_append(p.frames, h.frame) AS frames
  FROM vids h JOIN (SELECT *, round(total + 0.01::DOUBLE * f, 9) AS worth FROM p1) p ON h.query_id = p.query_id AND h.video_id = p.video_id AND p.f < h.frame WHERE h.list_id = 2
  QUALIFY row_number() OVER (PARTITION BY h.query_id, h.video_id, h.index_row ORDER BY worth DESC, p.frames) = 1),
u AS (SELECT query_id, video_id, frames, max(total) AS score FROM p2 GROUP BY 1, 2, 3)
SELECT query_id, video_id, array_to_string(frames, ',') AS frames, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, u.frames, video_id DESC) AS rank FROM u QUALIFY rank <= 100"""
)
def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = temporal.event_paths(materialise(event_hits(spark, sf_dir)), 3)
    return paths.select("query_id", "video_id", F.array_join(F.col("frames").cast("array<string>"), ",").alias("frames"), "score", "rank")


@query(ORACLE_SQL["event_paths"].replace("rank <= 100", "rank <= 1"))
def best_event_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_paths(spark, sf_dir).where(F.col("rank") == 1)


_CHAINS = (
    _LISTS
    + """, c0 AS (SELECT query_id, video_id, index_row, rank, frame, 1 AS n, 1.0::DOUBLE / (60 + rank) AS score, [rank, index_row] AS shown, [index_row] AS rows FROM lists WHERE video_id IS NOT NULL AND frame IS NOT NULL AND rank <= 300 AND list_id = 0),
c1 AS (
  SELECT h.query_id, h.video_id, h.index_row, h.rank, h.frame, coalesce(p.n, 0) + 1 AS n, CASE WHEN p.n IS NULL THEN 1.0::DOUBLE / (60 + h.rank) ELSE p.score + 1.0::DOUBLE / (60 + h.rank) - 0.25::DOUBLE * (h.frame - p.frame) / 9000 END AS score,
    CASE WHEN p.n IS NULL OR [h.rank, h.index_row] < p.shown THEN [h.rank, h.index_row] ELSE p.shown END AS shown, CASE WHEN p.n IS NULL THEN [h.index_row] ELSE list_append(p.rows, h.index_row) END AS rows
  FROM (SELECT * FROM lists WHERE video_id IS NOT NULL AND frame IS NOT NULL AND rank <= 300 AND list_id = 1) h
  LEFT JOIN c0 p ON p.query_id = h.query_id AND p.video_id = h.video_id AND h.frame - p.frame BETWEEN 1 AND 9000
  QUALIFY row_number() OVER (PARTITION BY h.query_id, h.video_id, h.index_row ORDER BY coalesce(p.n, 0) DESC, p.score - 0.25::DOUBLE * (h.frame - p.frame) / 9000 DESC, shown, rows) = 1),
c2 AS (
  SELECT h.query_id, h.video_id, h.index_row, h.rank, h.frame, coalesce(p.n, 0) + 1 AS n, CASE WHEN p.n IS NULL THEN 1.0::DOUBLE / (60 + h.rank) ELSE p.score + 1.0::DOUBLE / (60 + h.rank) - 0.25::DOUBLE * (h.frame - p.frame) / 9000 END AS score,
    CASE WHEN p.n IS NULL OR [h.rank, h.index_row] < p.shown THEN [h.rank, h.index_row] ELSE p.shown END AS shown, CASE WHEN p.n IS NULL THEN [h.index_row] ELSE list_append(p.rows, h.index_row) END AS rows
  FROM (SELECT * FROM lists WHERE video_id IS NOT NULL AND frame IS NOT NULL AND rank <= 300 AND list_id = 2) h
  LEFT JOIN c1 p ON p.query_id = h.query_id AND p.video_id = h.video_id AND h.frame - p.frame BETWEEN 1 AND 9000
  QUALIFY row_number() OVER (PARTITION BY h.query_id, h.video_id, h.index_row ORDER BY coalesce(p.n, 0) DESC, p.score - 0.25::DOUBLE * (h.frame - p.frame) / 9000 DESC, shown, rows) = 1),
best AS (
  SELECT query_id, video_id, n AS coverage, n = 3 AS whole, round(score + CASE WHEN n = 3 THEN 1.0 ELSE 0.0 END, 9) AS score, shown[1] AS best_rank, shown[2] AS shown_row, rows
  FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2)
  QUALIFY row_number() OVER (PARTITION BY query_id, video_id ORDER BY n DESC, score DESC, shown[1], rows) = 1),
chains AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY whole DESC, coverage DESC, score DESC, best_rank, shown_row, video_id) AS rank FROM best)
"""
)


@query(_CHAINS + "SELECT query_id, video_id, coverage, whole, score, best_rank, shown_row, array_to_string(rows, ',') AS rows, rank FROM chains")
def event_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = temporal.event_chains(materialise(event_hits(spark, sf_dir)), 3)
    return chains.withColumn("rows", F.array_join(F.col("rows").cast("array<string>"), ","))


@query(
    _CHAINS
    + """, fused AS (SELECT query_id, index_row, round(sum(weight / (60 + rank)), 9) AS score FROM lists GROUP BY 1, 2),
boosted AS (SELECT f.query_id, f.index_row, round(f.score + coalesce(c.score, 0.0), 9) AS score FROM fused f LEFT JOIN chains c ON c.query_id = f.query_id AND c.shown_row = f.index_row)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, index_row) AS rank FROM boosted"""
)
def chain_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = materialise(event_hits(spark, sf_dir))
    return temporal.boosted_by_chains(ranking.reciprocal_rank_fusion(packs), temporal.event_chains(packs, 3)).select("query_id", "index_row", "score", "rank")


_WINDOWS = (
    _HITS
    + """, v AS (SELECT DISTINCT video_id, fps, frame_count FROM videos WHERE fps IS NOT NULL AND NOT isnan(fps) AND frame_count IS NOT NULL),
inside AS (SELECT h.*, fps, frame_count FROM hits h JOIN v USING (video_id) WHERE frame >= 0 AND frame < frame_count),
firsts AS (SELECT * FROM inside QUALIFY row_number() OVER (PARTITION BY query_id, video_id, frame ORDER BY score DESC, index_row) = 1),
seeds AS (
  SELECT query_id, video_id, frame AS center, score AS top, greatest(0, frame - greatest(1, ceil(4.0 * fps / 2)::BIGINT)) AS start_frame, least(frame_count - 1, frame + greatest(1, ceil(4.0 * fps / 2)::BIGINT)) AS end_frame
  FROM firsts QUALIFY row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, index_row) <= 3),
band AS (
  SELECT s.query_id, s.video_id, center, top, start_frame, end_frame, list_sort(list(DISTINCT i.rank)) AS raw_ranks, list_sort(list(DISTINCT i.frame)) AS frames
  FROM seeds s JOIN inside i ON s.query_id = i.query_id AND s.video_id = i.video_id AND i.frame BETWEEN start_frame AND end_frame GROUP BY ALL),
centers AS (SELECT query_id, video_id, list_sort(list(DISTINCT center)) AS centers FROM seeds GROUP BY 1, 2),
windows AS (
  SELECT b.query_id, b.video_id, start_frame, end_frame, list_filter(centers, lambda c: c BETWEEN start_frame AND end_frame) AS seeds,
    list_sort(list_distinct(list_concat(frames, [start_frame + (end_frame - start_frame) * i // 4 FOR i IN [0, 1, 2, 3, 4]]))) AS samples, top AS score, raw_ranks
  FROM band b JOIN centers c ON b.query_id = c.query_id AND b.video_id = c.video_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, raw_ranks, video_id, start_frame) AS rank FROM windows QUALIFY rank <= 20)
"""
)
_WINDOW_COLUMNS = "query_id, video_id, start_frame, end_frame, array_to_string(seeds, ',') AS seeds, array_to_string(samples, ',') AS samples, score, rank"


def _joined(df: DataFrame) -> DataFrame:
    for name in ("seeds", "samples"):
        df = df.withColumn(name, F.array_join(F.col(name).cast("array<string>"), ","))
    return df.drop("raw_ranks")


@query(_WINDOWS + f"SELECT {_WINDOW_COLUMNS} FROM placed")
def evidence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(windows.evidence_windows(materialise(hits(spark, sf_dir)), table(spark, sf_dir, "videos")))


@query(
    _WINDOWS
    + f""", fine AS (
  SELECT p.query_id, p.video_id, seeds, p.score, raw_ranks, seeds[1] AS center, greatest(0, seeds[1] - greatest(1, ceil(1.0 * fps / 2)::BIGINT)) AS start_frame, least(frame_count - 1, seeds[1] + greatest(1, ceil(1.0 * fps / 2)::BIGINT)) AS end_frame
  FROM placed p JOIN v USING (video_id)),
held AS (
  SELECT * REPLACE (CASE WHEN len(list_filter(seeds, lambda c: c BETWEEN start_frame AND end_frame)) > 0 THEN list_filter(seeds, lambda c: c BETWEEN start_frame AND end_frame) ELSE [center] END AS seeds) FROM fine),
final AS (
  SELECT *, list_sort(list_distinct(list_concat(seeds, [start_frame + (end_frame - start_frame) * i // 4 FOR i IN [0, 1, 2, 3, 4]]))) AS samples, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, raw_ranks, video_id, start_frame) AS rank FROM held)
SELECT {_WINDOW_COLUMNS} FROM final"""
)
def refined_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = table(spark, sf_dir, "videos")
    return _joined(windows.refined_windows(windows.evidence_windows(materialise(hits(spark, sf_dir)), videos), videos))


@query(
    """WITH best AS (
  SELECT query_id, video_id, frame_id, normalized_answer, max(joint_score) AS joint_score FROM answer_hypotheses
  WHERE joint_score IS NOT NULL AND NOT isnan(joint_score) AND query_id IS NOT NULL AND video_id IS NOT NULL AND frame_id IS NOT NULL AND normalized_answer IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY joint_score DESC, video_id, frame_id, normalized_answer) AS rank FROM best QUALIFY rank <= 100"""
)
def ranked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.ranked_answers(table(spark, sf_dir, "answer_hypotheses")).drop("raw_answer")


@query(
    """WITH n AS (SELECT video_id, count(*) AS n FROM keyframes WHERE video_id IS NOT NULL GROUP BY 1)
SELECT video_id, CASE WHEN n <= 5 THEN i ELSE CAST(round_even(i * (n - 1) / 4.0, 0) AS BIGINT) END AS position FROM n, (SELECT unnest(range(0, 5)) AS i) WHERE n > 5 OR i < n"""
)
def even_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "keyframes").where(F.col("video_id").isNotNull()).groupBy("video_id").agg(F.count("*").alias("n"))
    return counts.select("video_id", F.explode(ranking.even_positions(F.col("n"), 5)).alias("position"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature rows, numbered within their video: row by row one for each of its keyframes in order."""
    rows = table(spark, sf_dir, "index_vectors")
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("index_row")) - 1
    return rows.select("video_id", place.cast("long").alias("clip_row"), "embedding")


_BUILT = (
    _VECTORS
    + """, rows AS (SELECT index_row, video_id, count(*) OVER (PARTITION BY video_id ORDER BY index_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clip_row FROM index_vectors),
built AS (
  SELECT k.video_id, k.keyframe_id, k.keyframe_ordinal, u.e FROM keyframes k JOIN rows r ON r.video_id = k.video_id AND r.clip_row = k.clip_row JOIN usable u ON u.index_row = r.index_row)
"""
)


@query(_BUILT + "SELECT row_number() OVER (ORDER BY video_id, keyframe_ordinal, keyframe_id) - 1 AS index_row, video_id, keyframe_id, CAST(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))) AS FLOAT) AS first FROM built")
def built_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.built_index(table(spark, sf_dir, "keyframes"), features(spark, sf_dir)).select("index_row", "video_id", "keyframe_id", F.col("embedding")[0].alias("first"))


@query("SELECT 'rows' AS \"check\", 1::BIGINT AS n WHERE false")
def verified_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A built index against its copy, written and read back."""
    built = materialise(search.built_index(table(spark, sf_dir, "keyframes"), features(spark, sf_dir)))
    return search.verified_index(built, materialise(built))


@query(
    _HITS
    + """SELECT s.query_id, s.index_row FROM search_hits s LEFT JOIN index_vectors v ON v.index_row = s.index_row
WHERE v.index_row IS NULL OR s.video_id IS DISTINCT FROM v.video_id OR s.keyframe_id IS DISTINCT FROM v.keyframe_id OR s.original_frame_id IS DISTINCT FROM v.original_frame_id OR s.keyframe_path IS DISTINCT FROM v.keyframe_path"""
)
def provenance_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that don't carry what their index row has; those of no video among them."""
    index = table(spark, sf_dir, "index_vectors").select("index_row", "video_id", "keyframe_id", "original_frame_id", "keyframe_path")
    return search.provenance_faults(table(spark, sf_dir, "search_hits"), index).select("query_id", "index_row")
