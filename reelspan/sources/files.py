"""Reading files: listings, mappings, features, JSON, query packs and sets, and parts of videos through plug-ins."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.operators.nested import parsed

# The ends of a query pack's file names.
TASKS = {"kis": "-kis.txt", "qa": "-qa.txt", "trake": "-trake.txt"}


class SourceFault(ValueError):
    """A file breaks its contract."""


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, stem, folder, size) of the files below a folder, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.element_at(F.split("path", "/"), -2).alias("folder"), F.col("length").alias("size")).orderBy("path")


def _contents(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select("path", stem.alias("video_id"), "content")


def _number(text: str | None, least: float, above: bool) -> float | None:
    if text is None or not text.strip():
        return None
    value = float(text)
    if not np.isfinite(value) or value < least or (above and value == least):
        raise SourceFault(f"a number is out of range: {text}")
    return value


def mappings(spark: SparkSession, root: str, key: str = "n", frame: str = "frame_idx", pattern: str = "*.csv") -> DataFrame:
    """(video_id, ordinal, key, frame, pts_time, fps) of one CSV file for each video; rows in file order.

    A byte order mark is passed over. Files without rows or columns, and empty
    keys, are errors.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for video, content in zip(batch.video_id, batch.content, strict=True):
                rows = list(csv.DictReader(io.StringIO(bytes(content).decode("utf-8-sig"))))
                if not rows or key not in rows[0] or frame not in rows[0]:
                    raise SourceFault(f"the mapping of {video} has no rows or lacks a column")
                if any(not (r[key] or "").strip() for r in rows):
                    raise SourceFault(f"the mapping of {video} has an empty key")
                yield pd.DataFrame(
                    {
                        "video_id": video, "ordinal": range(len(rows)), "key": [r[key].strip() for r in rows], "frame": [int(r[frame]) for r in rows],
                        "pts_time": [_number(r.get("pts_time"), 0, False) for r in rows], "fps": [_number(r.get("fps"), 0, True) for r in rows],
                    }
                )

    return _contents(spark, root, pattern).mapInPandas(read, "video_id string, ordinal long, key string, frame long, pts_time double, fps double")


def features(spark: SparkSession, root: str, pattern: str = "*.npy") -> DataFrame:
    """(video_id, clip_row, embedding) of one two-dimensional array file for each video. Pickles are refused."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for video, content in zip(batch.video_id, batch.content, strict=True):
                matrix = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                if matrix.ndim != 2 or not matrix.size:
                    raise SourceFault(f"the features of {video} are no matrix")
                yield pd.DataFrame({"video_id": video, "clip_row": range(len(matrix)), "embedding": list(matrix.astype(np.float32))})

    return _contents(spark, root, pattern).mapInPandas(read, "video_id string, clip_row long, embedding array<float>")


def feature_probe(features_df: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(video_id, rows, dimension, finite, normalized) over all rows of each video."""
    from reelspan.operators.search import norm

    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    unit = F.abs(norm(F.col("embedding")) - 1) <= tolerance
    return features_df.groupBy("video_id").agg(F.count("*").alias("rows"), F.max(F.size("embedding")).alias("dimension"), F.min(finite).alias("finite"), F.min(unit).alias("normalized"))


def json_files(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """(path, text, root): whole files; root is null where a file isn't valid JSON."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    return parsed(rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), "text")


def query_pack(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, task, text) of a folder of text files, by file name; files with other ends are passed over, empty ones are errors."""
    rows = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.trim("value").alias("text"))
    task = F.lit(None).cast("string")
    for name, end in TASKS.items():
        task = F.when(F.endswith("name", F.lit(end)), name).otherwise(task)
    known = rows.withColumn("task", task).where(F.col("task").isNotNull())
    text = F.when(F.length("text") == 0, F.raise_error(F.concat(F.lit("empty query: "), F.col("name")))).otherwise(F.col("text"))
    return known.orderBy("name").select(F.regexp_replace("name", r"\.txt$", "").alias("query_id"), "task", text.alias("text"))


def _object(source: str | Path) -> dict:
    found = json.loads(Path(source).read_text(encoding="utf-8-sig"))
    if not isinstance(found, dict):
        raise SourceFault("the file isn't one JSON object")
    return found


def _exact(found: object, names: set[str], what: str) -> dict:
    if not isinstance(found, dict) or set(found) != names:
        raise SourceFault(f"{what} must have exactly the fields {sorted(names)}")
    return found


def query_set(spark: SparkSession, source: str | Path) -> DataFrame:
    """(query_id, video_id, start, end) of a strict benchmark file: version 1, task kis, distinct ids, at least one."""
    found = _exact(_object(source), {"version", "task", "query_encoder", "queries"}, "a query set")
    if found["version"] != 1 or found["task"] != "kis" or not isinstance(found["queries"], list) or not found["queries"]:
        raise SourceFault("a query set has version 1, task kis and queries")
    _exact(found["query_encoder"], {"model_id", "preprocessing"}, "the encoder")
    rows = []
    for one in found["queries"]:
        truth = _exact(_exact(one, {"query_id", "ground_truth"}, "a query")["ground_truth"], {"video_id", "start", "end"}, "the truth")
        start, end = truth["start"], truth["end"]
        if any(isinstance(x, bool) or not isinstance(x, int) or x < 0 for x in (start, end)) or end < start:
            raise SourceFault("an interval is two whole numbers in order")
        rows.append((str(one["query_id"]), str(truth["video_id"]), start, end))
    if len({r[0] for r in rows}) < len(rows):
        raise SourceFault("a query id is repeated")
    return spark.createDataFrame(rows, "query_id string, video_id string, start long, end long")


def private_texts(spark: SparkSession, source: str | Path, queries: DataFrame) -> DataFrame:
    """(query_id, text) of a private file that names exactly the queries of the set."""
    found = _object(source)
    known = {r[0] for r in queries.select("query_id").toLocalIterator()}
    if set(found) != known or any(not isinstance(t, str) or not t.strip() for t in found.values()):
        raise SourceFault("the texts must be those of the query set, none blank")
    return spark.createDataFrame(sorted(found.items()), "query_id string, text string")


def query_vectors(spark: SparkSession, source: str | Path, ids: list[str], dimension: int) -> DataFrame:
    """(query_id, embedding) of an array file with a usable row for each id in order."""
    if Path(source).suffix != ".npy":
        raise SourceFault("query vectors are one array file")
    matrix = np.load(source, allow_pickle=False)
    if matrix.shape != (len(ids), dimension) or not np.isfinite(matrix).all() or (np.linalg.norm(matrix, axis=1) == 0).any():
        raise SourceFault("query vectors must be finite, not zero, and one for each query")
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in zip(ids, matrix, strict=True)], "query_id string, embedding array<float>")


def evaluation_input(source: str | Path) -> dict:
    """Task, truth and responses of one query for scoring, by task."""
    found = _object(source)
    task = found.get("task")
    if task not in TASKS:
        raise SourceFault("the task is kis, qa or trake")
    truth = {"kis": {"video_id", "start", "end"}, "qa": {"video_id", "start", "end", "answers"}, "trake": {"video_id", "intervals"}}[task]
    answer = {"kis": {"video_id", "frame_id"}, "qa": {"video_id", "frame_id", "answer"}, "trake": {"video_id", "frame_ids"}}[task]
    _exact(found.get("ground_truth"), truth, "the truth")
    for one in found.get("responses", []):
        _exact(one, answer, "a response")
    return found


def decoded(frames: DataFrame, load: Callable[[], Callable[[str, int], bytes | None]]) -> DataFrame:
    """(video_path, frame, image) by a decoder that a plug-in loads once in each worker; frames that can't be read are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = load()
        for batch in batches:
            yield batch.assign(image=[decode(p, int(f)) for p, f in zip(batch.video_path, batch.frame, strict=True)])

    return frames.select("video_path", "frame").mapInPandas(run, "video_path string, frame long, image binary")


def probed(videos: DataFrame, load: Callable[[], Callable[[str], tuple[float, int]]]) -> DataFrame:
    """(video_id, fps, frame_count, duration) by a plug-in that reads a video's head."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probe = load()
        for batch in batches:
            found = [probe(p) for p in batch.video_path]
            yield pd.DataFrame({"video_id": batch.video_id, "fps": [f for f, _ in found], "frame_count": [n for _, n in found], "duration": [n / f for f, n in found]})

    return videos.select("video_id", "video_path").mapInPandas(run, "video_id string, fps double, frame_count long, duration double")


def read_texts(images: DataFrame, load: Callable[[], Callable[[bytes], list[tuple[str, float, list[float]]]]], least: float = 0.35) -> DataFrame:
    """(index_row, raw_text, confidence, box) by a reading model; readings below ``least`` are dropped, corner points flattened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            rows = [(r, t, c, list(np.ravel(b))) for r, i in zip(batch.index_row, batch.image, strict=True) if i is not None for t, c, b in model(bytes(i)) if c >= least]
            yield pd.DataFrame(rows, columns=["index_row", "raw_text", "confidence", "box"])

    return images.select("index_row", "image").mapInPandas(run, "index_row long, raw_text string, confidence double, box array<double>")
