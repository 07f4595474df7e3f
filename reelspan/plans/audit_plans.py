"""Constraints, issues and shapes of the collection; objects and re-ranking by them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.operators import audit, objects, ranking, search
from reelspan.plans import retrieval_plans as retrieval
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


_DURATION = "SELECT video_id, round(abs(duration - frame_count / fps), 6) AS apart FROM videos WHERE fps > 0 AND NOT isnan(fps) AND abs(duration - frame_count / fps) > greatest(1.0, 2 / fps)"
_REPEATED = "SELECT video_id, keyframe_id, original_frame_id, before FROM (SELECT *, lag(original_frame_id) OVER (PARTITION BY video_id ORDER BY keyframe_ordinal) AS before FROM keyframes) WHERE original_frame_id <= before"
_RANGE = "SELECT k.video_id, keyframe_id, original_frame_id FROM keyframes k JOIN videos v ON k.video_id = v.video_id WHERE original_frame_id < 0 OR original_frame_id >= frame_count"


@query(_DURATION)
def duration_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duration_faults(table(spark, sf_dir, "videos"))


@query(_REPEATED)
def repeated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.repeated_frames(table(spark, sf_dir, "keyframes"))


def _dup(frame: str, keys: str, code: str, shown: str) -> str:
    there = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    return f"SELECT '{code}' AS code, 'error' AS level, {shown} AS entity FROM {frame} WHERE {there} GROUP BY {keys} HAVING count(*) > 1"


_PAIR = "video_id || '/' || keyframe_id"
_ISSUES = " UNION ALL ".join(
    [
        _dup("videos", "video_id", "duplicate-video", "video_id"),
        _dup("keyframes", "video_id, keyframe_id", "duplicate-keyframe", _PAIR),
        _dup("keyframes", "video_id, keyframe_ordinal", "duplicate-ordinal", "video_id || '/' || keyframe_ordinal"),
        _dup("keyframes", "video_id, clip_row", "duplicate-clip-row", "video_id || '/' || clip_row"),
        f"SELECT 'orphan-keyframe', 'warning', {_PAIR} FROM keyframes k WHERE NOT EXISTS (SELECT 1 FROM videos v WHERE v.video_id = k.video_id)",
        "SELECT 'keyframe-missing', 'error', video_id FROM videos v WHERE NOT EXISTS (SELECT 1 FROM keyframes k WHERE v.video_id = k.video_id)",
        f"SELECT 'frame-out-of-range', 'error', {_PAIR} FROM ({_RANGE})",
        f"SELECT 'frame-not-increasing', 'error', {_PAIR} FROM ({_REPEATED})",
        f"SELECT 'duration-mismatch', 'error', video_id FROM ({_DURATION})",
        "SELECT 'rate-missing', 'warning', video_id FROM videos WHERE fps IS NULL",
        "SELECT 'metadata-missing', 'warning', video_id FROM videos WHERE metadata_path IS NULL",
        f"SELECT 'clip-row-missing', 'warning', {_PAIR} FROM keyframes WHERE clip_row IS NULL",
        f"SELECT 'object-missing', 'warning', {_PAIR} FROM keyframes WHERE object_path IS NULL",
    ]
)


@query(_ISSUES)
def manifest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.manifest_issues(table(spark, sf_dir, "videos"), table(spark, sf_dir, "keyframes"))


_TABLES = ("videos", "keyframes", "index_vectors", "ocr_records", "object_records")


@query(" UNION ALL ".join(f"SELECT '{t}' AS kind, count(*) AS n FROM {t}" for t in _TABLES))
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.inventory(**{t: table(spark, sf_dir, t) for t in _TABLES})


@query(
    """SELECT video_id, keyframe_id, CAST(round_even(original_frame_id / fps * fps, 0) AS BIGINT) AS frame FROM keyframes JOIN videos USING (video_id) WHERE fps > 0 AND NOT isnan(fps)"""
)
def mapped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames found again from their times."""
    videos = table(spark, sf_dir, "videos").where((F.col("fps") > 0) & ~F.isnan("fps")).select("video_id", "fps")
    rows = table(spark, sf_dir, "keyframes").join(videos, "video_id")
    return rows.select("video_id", "keyframe_id", audit.mapped_frame(F.col("original_frame_id"), F.col("original_frame_id") / F.col("fps"), F.col("fps"), "time").alias("frame"))


@query("SELECT k.video_id, k.keyframe_id FROM keyframes k WHERE object_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM object_records o WHERE o.object_path = k.object_path)")
def orphan_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "keyframes").where(F.col("object_path").isNotNull())
    return audit.orphans(known, table(spark, sf_dir, "object_records"), "object_path").select("video_id", "keyframe_id")


@query("SELECT object_id, count(*) AS n FROM object_records WHERE object_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def repeated_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicates(table(spark, sf_dir, "object_records"), ["object_id"])


@query()
def object_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.schema_warnings(table(spark, sf_dir, "object_records"))


@query()
def object_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.plain_detections(table(spark, sf_dir, "object_records"))


@query()
def payload_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.payload_shapes(table(spark, sf_dir, "object_records"))


def labels(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    """(query_id, index_row, label, score): the detections of the keyframes of the hits; only the objects of those are read."""
    rows = table(spark, sf_dir, "index_vectors").select("index_row", "video_id", "keyframe_id").join(hits.select("index_row").distinct(), "index_row", "left_semi")
    records = table(spark, sf_dir, "object_records").where(F.col("object_id").isNotNull())
    placed = records.groupBy("object_id").agg(F.max(F.struct("received_at", "video_id", "keyframe_id")).alias("r")).select("object_id", "r.video_id", "r.keyframe_id")
    shown = materialise(placed.join(rows, ["video_id", "keyframe_id"]).select("object_id", "index_row"))
    found = objects.plain_detections(records.join(shown.select("object_id").distinct(), "object_id", "left_semi"))
    each = found.select(F.col("record").alias("object_id"), F.explode("labels").alias("label"), "score").join(shown, "object_id")
    return materialise(hits.select("query_id", "index_row").join(each.select("index_row", "label", "score"), "index_row"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(retrieval.hits(spark, sf_dir))


@query()
def object_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every query's list the labels that its frames show most."""
    return ranking.object_vocabulary(labels(spark, sf_dir, _hits(spark, sf_dir)))


def consistency(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    plans = hits.select("query_id").distinct()
    plans = plans.select("query_id", F.array(F.lit("person"), F.lit("bus")).alias("required"), F.array(F.lit("boat")).alias("excluded"))
    return ranking.object_consistency(labels(spark, sf_dir, hits), plans)


@query()
def object_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency(spark, sf_dir, _hits(spark, sf_dir))


@query()
def contrastive_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every list against the vectors of its first and last hit. Only the vectors of hits are read into the pairs."""
    hits = _hits(spark, sf_dir)
    vectors = table(spark, sf_dir, "index_vectors").where(F.col("embedding").isNotNull()).select("index_row", F.col("embedding").alias("v"))
    ends = hits.groupBy("query_id").agg(F.min_by("index_row", "rank").alias("positive"), F.max_by("index_row", "rank").alias("negative"))
    sides = ends.select("query_id", F.expr("stack(2, 'positive', positive, 'negative', negative) as (side, row)"))
    sides = sides.join(vectors.select(F.col("index_row").alias("row"), F.col("v").alias("side_v")), "row").select("query_id", "side", "side_v")
    pairs = hits.select("query_id", "index_row").join(vectors, "index_row").join(sides, "query_id")
    cosines = pairs.select("query_id", "index_row", "side", F.round(search.cosine("v", "side_v"), 6).alias("cosine")).where(F.col("cosine").isNotNull())
    return ranking.contrastive(hits, cosines, consistency(spark, sf_dir, hits), 0.4, 0.3, 0.2).select("query_id", "index_row", "score", "base_rank", "rank")
