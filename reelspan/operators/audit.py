"""Constraints of the manifest, and the issues a collection has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def issue(df: DataFrame, code: str, level: str, entity: Column) -> DataFrame:
    """(code, level, entity): the shape of every finding."""
    return df.select(F.lit(code).alias("code"), F.lit(level).alias("level"), entity.cast("string").alias("entity"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number; rows with a null in the key take no part."""
    known = df.where(F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda x: x))
    return known.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def orphans(df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in no parent row."""
    return df.join(parents.select(key).distinct(), key, "left_anti")


def duration_faults(videos: DataFrame) -> DataFrame:
    """Videos whose duration and frames / rate differ by more than the greater of a second and two frames."""
    known = videos.where(F.col("fps").isNotNull() & (F.col("fps") > 0) & ~F.isnan("fps"))
    apart = F.abs(F.col("duration") - F.col("frame_count") / F.col("fps"))
    return known.where(apart > F.greatest(F.lit(1.0), 2 / F.col("fps"))).select("video_id", F.round(apart, 6).alias("apart"))


def frame_faults(keyframes: DataFrame, videos: DataFrame) -> DataFrame:
    """Keyframes beyond the frames of their video."""
    joined = keyframes.join(videos.select("video_id", "frame_count"), "video_id")
    return joined.where((F.col("original_frame_id") < 0) | (F.col("original_frame_id") >= F.col("frame_count"))).select("video_id", "keyframe_id", "original_frame_id")


def repeated_frames(keyframes: DataFrame) -> DataFrame:
    """Keyframes whose frame isn't after that of the one before, in file order."""
    before = F.lag("original_frame_id").over(Window.partitionBy("video_id").orderBy("keyframe_ordinal"))
    return keyframes.withColumn("before", before).where(F.col("original_frame_id") <= F.col("before")).select("video_id", "keyframe_id", "original_frame_id", "before")


def mapped_frame(csv_frame: Column, pts_time: Column, fps: Column, source: str = "csv") -> Column:
    """The frame of a mapping row: as given, or time times rate, half to even."""
    return csv_frame if source == "csv" else F.rint(pts_time * fps).cast("long")


def candidate_frames(csv_frame: Column, pts_time: Column, fps: Column) -> Column:
    """(label, frame) of the frames a mapping row can mean: as given and by time, and one to either side; none below 0."""
    by_time = F.rint(pts_time * fps).cast("long")
    options = [(f"{name}{sign}", base + step) for name, base in (("csv", csv_frame), ("time", by_time)) for sign, step in (("", 0), ("-1", -1), ("+1", 1))]
    return F.filter(F.array(*[F.struct(F.lit(n).alias("label"), f.cast("long").alias("frame")) for n, f in options]), lambda c: c["frame"] >= 0)


def matching_keyframes(mapping: DataFrame, files: DataFrame) -> DataFrame:
    """For each (video_id, key) of the mapping the file it names: as it is, without zeros, as a number, or with 3 or 4 digits, in that order.

    ``files``: (video_id, stem). Keys without file have a null stem.
    """
    number = F.col("key").try_cast("long").cast("string")
    forms = F.array(F.col("key"), F.regexp_replace("key", "^0+(?=.)", ""), number, F.lpad(number, 3, "0"), F.lpad(number, 4, "0"))
    tried = mapping.select("video_id", "key", F.posexplode(forms).alias("place", "stem")).where(F.col("stem").isNotNull())
    found = tried.join(files.select("video_id", "stem").distinct(), ["video_id", "stem"])
    best = found.groupBy("video_id", "key").agg(F.min_by("stem", "place").alias("stem"))
    return mapping.join(best, ["video_id", "key"], "left")


def best_mapping(errors: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(label, mean_error, wins): mean pixel error of each candidate frame, and the samples it is best in; ties win each."""
    least = F.min("error").over(Window.partitionBy("sample"))
    rows = errors.withColumn("won", (F.col("error") <= least + tolerance).cast("long"))
    return rows.groupBy("label").agg(F.round(F.avg("error"), 9).alias("mean_error"), F.sum("won").alias("wins"))


def manifest_issues(videos: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Every broken constraint of the manifest as (code, level, entity)."""
    pair = F.concat_ws("/", "video_id", "keyframe_id")
    found = [
        issue(duplicates(videos, ["video_id"]), "duplicate-video", "error", F.col("video_id")),
        issue(duplicates(keyframes, ["video_id", "keyframe_id"]), "duplicate-keyframe", "error", pair),
        issue(duplicates(keyframes, ["video_id", "keyframe_ordinal"]), "duplicate-ordinal", "error", F.concat_ws("/", "video_id", F.col("keyframe_ordinal").cast("string"))),
        issue(duplicates(keyframes, ["video_id", "clip_row"]), "duplicate-clip-row", "error", F.concat_ws("/", "video_id", F.col("clip_row").cast("string"))),
        issue(orphans(keyframes, videos, "video_id"), "orphan-keyframe", "warning", pair),
        issue(orphans(videos, keyframes, "video_id"), "keyframe-missing", "error", F.col("video_id")),
        issue(frame_faults(keyframes, videos), "frame-out-of-range", "error", pair),
        issue(repeated_frames(keyframes), "frame-not-increasing", "error", pair),
        issue(duration_faults(videos), "duration-mismatch", "error", F.col("video_id")),
        issue(videos.where(F.col("fps").isNull()), "rate-missing", "warning", F.col("video_id")),
        issue(videos.where(F.col("metadata_path").isNull()), "metadata-missing", "warning", F.col("video_id")),
        issue(keyframes.where(F.col("clip_row").isNull()), "clip-row-missing", "warning", pair),
        issue(keyframes.where(F.col("object_path").isNull()), "object-missing", "warning", pair),
    ]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def inventory(**tables: DataFrame) -> DataFrame:
    """(kind, n) of the named tables."""
    parts = [df.agg(F.lit(name).alias("kind"), F.count("*").alias("n")) for name, df in sorted(tables.items())]
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out
