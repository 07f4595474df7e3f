"""The queries of the training-data operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.borda import borda, heads
from reelspan.llm.leaks import leaks
from reelspan.llm.neighbours import nearest
from reelspan.llm.packing import pack
from reelspan.llm.runs import runs
from reelspan.llm.subjects import assign, fit
from reelspan.llm.topn import top_n
from reelspan.llm.transducer import touched, with_consistent_text
from reelspan.session import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return make(spark, sf_dir)

    QUERIES[make.__name__] = run
    return run


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(table(spark, sf_dir, "ocr_records")).where(F.col("n") >= 2)
    return found.select(F.col("entity").alias("video_id"), F.col("first_at").alias("first_frame_id"), F.col("last_at").alias("last_frame_id"))


@query
def p1_caption_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every caption event, single readings too, with count and duration."""
    found = runs(table(spark, sf_dir, "ocr_records"))
    return found.select(F.col("entity").alias("video_id"), "caption", F.col("n").alias("n_readings"), F.col("first_at").alias("first_frame_id"), F.col("last_at").alias("last_frame_id"), F.col("duration").alias("frames"))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(table(spark, sf_dir, "search_hits")).select("video_id", "query_id", "index_row")


@query
def p4_ranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hits with score and rank."""
    return top_n(table(spark, sf_dir, "search_hits")).select("video_id", "query_id", "index_row", "score", F.col("rank").cast("long").alias("rank"))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads(borda(table(spark, sf_dir, "answer_hypotheses")))


@query
def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ranking of every query."""
    return borda(table(spark, sf_dir, "answer_hypotheses")).select("query_id", "hypothesis_id", "points", "rank")


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "ocr_records").select("ocr_id", "raw_text", "normalized_text")
    able = records.where(touched(F.col("raw_text")) | touched(F.col("normalized_text")))  # no other record can need it
    records = with_consistent_text(able, "raw_text", "normalized_text")
    return records.where(F.col("raw_text_changed") | F.col("normalized_text_changed")).select("ocr_id").distinct()


@query
def p6_consistent_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fields of every record in the consistent form."""
    records = table(spark, sf_dir, "ocr_records").select("ocr_id", "raw_text", "normalized_text").distinct()
    records = with_consistent_text(records, "raw_text", "normalized_text")
    return records.select("ocr_id", F.col("raw_text_consistent").alias("raw_text"), F.col("normalized_text_consistent").alias("normalized_text"), F.col("raw_text_changed").alias("raw_changed"), F.col("normalized_text_changed").alias("normalized_changed"))


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return assign(documents, fit(documents, table(spark, sf_dir, "subject_labels")))


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("subject_id", "doc_id").distinct()


@query
def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have each area."""
    found = _subjects(spark, sf_dir).select("subject_id", "doc_id").distinct()
    return found.groupBy("subject_id").agg(F.count("*").alias("n_documents"))


@query
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every text lies, in containers of 2,048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(table(spark, sf_dir, "index_vectors"))
    return found.select(F.least("index_row", "neighbour").alias("row_a"), F.greatest("index_row", "neighbour").alias("row_b")).distinct()


@query
def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five neighbours of every index row, with similarity and rank."""
    return nearest(table(spark, sf_dir, "index_vectors"))
