"""Scores, recall and summaries. The ground truth is made from the tables: of each query the frames around its lowest row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.operators import evaluation, temporal
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


def frame_truth(hits: DataFrame) -> DataFrame:
    first = hits.groupBy("query_id").agg(F.min_by(F.struct("video_id", "frame"), "index_row").alias("t"))
    return first.select("query_id", F.col("t.video_id").alias("video_id"), (F.col("t.frame") - 50).alias("start"), (F.col("t.frame") + 50).alias("end"))


_FRAMES = (
    retrieval._HITS
    + """, truth AS (SELECT query_id, arg_min(video_id, index_row) AS tv, arg_min(frame, index_row) - 50 AS s, arg_min(frame, index_row) + 50 AS e FROM (SELECT query_id, index_row, coalesce(video_id, '') AS video_id, frame FROM hits) GROUP BY query_id),
scored AS (SELECT h.query_id, h.rank, CASE WHEN h.video_id = tv AND frame BETWEEN s AND e THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM hits h JOIN truth USING (query_id)),
recall AS (SELECT query_id, r_1, r_5, r_20, r_50, r_100, round((r_1 + r_5 + r_20 + r_50 + r_100) / 5, 9) AS final FROM (
  SELECT query_id, coalesce(max(score) FILTER (rank <= 1), 0) AS r_1, coalesce(max(score) FILTER (rank <= 5), 0) AS r_5, coalesce(max(score) FILTER (rank <= 20), 0) AS r_20, coalesce(max(score) FILTER (rank <= 50), 0) AS r_50, coalesce(max(score) FILTER (rank <= 100), 0) AS r_100 FROM scored GROUP BY 1))
"""
)


def _frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hits = materialise(retrieval.hits(spark, sf_dir))
    return hits, evaluation.frame_score(frame_truth(hits), hits)


def _recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, scores = _frames(spark, sf_dir)
    return evaluation.recall_at(hits, scores)


@query(_FRAMES + "SELECT query_id, rank, score FROM scored")
def score_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir)[1]


@query(_FRAMES + "SELECT * FROM recall")
def recall_at_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall(spark, sf_dir)


_MEANS = ", ".join(f"round(coalesce(avg({c}), 0), 9) AS {c}" for c in ("r_1", "r_5", "r_20", "r_50", "r_100", "final"))


@query(_FRAMES + f"SELECT count(*) AS n_queries, {_MEANS} FROM recall")
def mean_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mean_metrics(_recall(spark, sf_dir))


_DELTAS = ", ".join(f"round(avg(c.{c}) - avg(b.{c}), 9) AS {c}" for c in ("r_1", "r_5", "r_20", "r_50", "r_100", "final"))
_BACKWARDS = (
    _FRAMES
    + """, b AS (SELECT * FROM recall),
turned AS (SELECT query_id, max(rank) OVER (PARTITION BY query_id) + 1 - rank AS rank, score FROM scored),
c AS (SELECT query_id, r_1, r_5, r_20, r_50, r_100, round((r_1 + r_5 + r_20 + r_50 + r_100) / 5, 9) AS final FROM (
  SELECT query_id, coalesce(max(score) FILTER (rank <= 1), 0) AS r_1, coalesce(max(score) FILTER (rank <= 5), 0) AS r_5, coalesce(max(score) FILTER (rank <= 20), 0) AS r_20, coalesce(max(score) FILTER (rank <= 50), 0) AS r_50, coalesce(max(score) FILTER (rank <= 100), 0) AS r_100 FROM turned GROUP BY 1))
"""
)


@query(_BACKWARDS + f"SELECT {_DELTAS} FROM b JOIN c USING (query_id)")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists read backwards against the lists."""
    from pyspark.sql.window import Window

    hits, scores = _frames(spark, sf_dir)
    last = F.max("rank").over(Window.partitionBy("query_id"))
    return evaluation.compared(evaluation.recall_at(hits, scores), evaluation.recall_at(hits, scores.withColumn("rank", last + 1 - F.col("rank"))))


_ANSWERS = """
WITH best AS (
  SELECT query_id, video_id, frame_id, normalized_answer, max(joint_score) AS joint_score FROM answer_hypotheses
  WHERE joint_score IS NOT NULL AND NOT isnan(joint_score) AND query_id IS NOT NULL AND video_id IS NOT NULL AND frame_id IS NOT NULL AND normalized_answer IS NOT NULL GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY joint_score DESC, video_id, frame_id, normalized_answer) AS rank FROM best QUALIFY rank <= 100),
truth AS (SELECT query_id, arg_max(video_id, rank) AS tv, arg_max(frame_id, rank) - 20 AS s, arg_max(frame_id, rank) + 20 AS e, arg_max(normalized_answer, rank) AS a FROM r GROUP BY 1)
SELECT r.query_id, rank, CASE WHEN video_id = tv AND frame_id BETWEEN s AND e AND normalized_answer = a THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM r JOIN truth USING (query_id)"""


@query(_ANSWERS)
def score_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last answer of each query is its truth."""
    ranked = retrieval.windows.ranked_answers(table(spark, sf_dir, "answer_hypotheses"))
    last = ranked.groupBy("query_id").agg(F.max_by(F.struct("video_id", "frame_id", "normalized_answer"), "rank").alias("t"))
    truth = last.select("query_id", F.col("t.video_id").alias("video_id"), (F.col("t.frame_id") - 20).alias("start"), (F.col("t.frame_id") + 20).alias("end"), F.array("t.normalized_answer").alias("answers"))
    return evaluation.answer_score(truth, ranked.select("query_id", "rank", "video_id", F.col("frame_id").alias("frame"), F.col("normalized_answer").alias("answer")))


_PATH_SCORES = retrieval.ORACLE_SQL["event_paths"].replace("SELECT query_id, video_id, array_to_string(frames, ',') AS frames", ", paths AS (SELECT query_id, video_id, frames") + """)
SELECT p.query_id, p.rank, round(CASE WHEN p.video_id = t.video_id THEN len(list_filter(list_zip(p.frames, t.frames), lambda x: abs(x[1] - x[2]) <= 10)) / 3.0 ELSE 0.0 END, 9)::DOUBLE AS score
FROM paths p JOIN paths t ON t.query_id = p.query_id AND t.rank = 1"""


@query(_PATH_SCORES)
def score_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best path of each query, ten frames to either side, is its truth."""
    paths = materialise(temporal.event_paths(materialise(retrieval.event_hits(spark, sf_dir)), 3))
    around = F.transform("frames", lambda f: F.struct((f - 10).alias("start"), (f + 10).alias("end")))
    truth = paths.where(F.col("rank") == 1).select("query_id", "video_id", around.alias("intervals"))
    return evaluation.path_score(truth, paths.select("query_id", "rank", "video_id", "frames"))


@query("SELECT quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.95) AS p95 FROM search_hits WHERE score IS NOT NULL AND NOT isnan(score)")
def score_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits")
    return evaluation.percentiles(hits.where(F.col("score").isNotNull() & ~F.isnan("score")), "score")


@query(
    """WITH p AS (SELECT query_id, regexp_extract(query_id, '-(kis|qa|trake)$', 1) AS task, count(DISTINCT index_row) AS responses FROM search_hits WHERE query_id IS NOT NULL GROUP BY 1, 2)
SELECT task, count(*) AS n_queries, CAST(sum(responses) AS BIGINT) AS n_responses FROM p GROUP BY 1"""
)
def pack_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits").where(F.col("query_id").isNotNull())
    each = hits.groupBy("query_id", F.regexp_extract("query_id", "-(kis|qa|trake)$", 1).alias("task")).agg(F.count_distinct("index_row").alias("responses"))
    return each.groupBy("task").agg(F.count("*").alias("n_queries"), F.sum("responses").alias("n_responses"))


@query(
    """WITH q AS (SELECT query_id, count(*) FILTER (score IS NOT NULL AND NOT isnan(score)) AS good, count(*) AS n FROM search_hits WHERE query_id IS NOT NULL GROUP BY 1)
SELECT CASE WHEN good = 0 THEN 'no-evidence' WHEN good < n THEN 'partial' ELSE 'applied' END AS status, count(*) AS n FROM q GROUP BY 1"""
)
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits").where(F.col("query_id").isNotNull())
    good = F.count(F.when(F.col("score").isNotNull() & ~F.isnan("score"), 1))
    each = hits.groupBy("query_id").agg(good.alias("good"), F.count("*").alias("n"))
    status = F.when(F.col("good") == 0, "no-evidence").when(F.col("good") < F.col("n"), "partial").otherwise("applied")
    return each.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(retrieval._HITS + "SELECT query_id, 'too-many' AS fault FROM hits GROUP BY query_id HAVING count(*) > 100 UNION ALL SELECT query_id, 'duplicate' FROM (SELECT query_id, count(*) AS n, count(DISTINCT coalesce(video_id, '') || '/' || frame) AS d FROM hits GROUP BY 1) WHERE n <= 100 AND n <> d")
def response_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.response_faults(retrieval.hits(spark, sf_dir), ["video_id", "frame"])
