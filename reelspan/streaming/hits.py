"""Hits as a stream: late and repeated rows, counts over event time, and the best of each group kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window


def distinct_hits(stream: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """Each (query, row) once within the watermark; rows without key or time are dropped."""
    keyed = stream.where(F.col("query_id").isNotNull() & F.col("index_row").isNotNull() & F.col("received_at").isNotNull())
    return keyed.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["query_id", "index_row"])


def hits_per_video(stream: DataFrame, size: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(window, video_id, n, best): hits of each video in windows of event time."""
    usable = stream.where(F.col("video_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    return usable.withWatermark("received_at", delay).groupBy(F.window("received_at", size), "video_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))


def keep_best(stream: DataFrame, target: str, n: int = 10) -> DataStreamWriter:
    """Keep the N best hits of each video in versioned tables below ``target``, one for each batch.

    A batch meets only what was kept before, so the state is N rows for each
    video. A batch that is run again writes the same version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        usable = batch.where(F.col("video_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score")).select("video_id", "query_id", "index_row", "score")
        if number > 0:
            usable = usable.unionByName(spark.read.parquet(f"{target}/v{number - 1}"))
        once = usable.groupBy("video_id", "query_id", "index_row").agg(F.max("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("video_id").orderBy(F.col("score").desc(), "index_row", "query_id"))
        once.withColumn("_n", place).where(F.col("_n") <= n).drop("_n").write.mode("overwrite").parquet(f"{target}/v{number}")

    return stream.writeStream.foreachBatch(merge)
