"""Publishing: tables by staging and swap, small results as JSON, CSV and ZIP, each checked before it is seen."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bounds of an export.
MAX_ROWS, MAX_ANSWER = 100, 100


class ExportFault(ValueError):
    """A result breaks the export's contract."""


def fingerprint(df: DataFrame) -> str:
    """Rows and their order-free hash: equal tables, equal text."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return f"{row['n']}-{row['h']}"


def publish(df: DataFrame, target: str) -> str:
    """Write a table beside its place, read it back, compare, and only then put it there. The old table stays on any fault."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staging, old = target + ".staging", target + ".old"
    fs.delete(path(staging), True)
    try:
        df.write.parquet(staging)
        mark = fingerprint(df)
        if fingerprint(spark.read.parquet(staging)) != mark:
            raise ExportFault("the written table isn't the one that was to be written")
        fs.delete(path(old), True)
        if fs.exists(path(target)):
            fs.rename(path(target), path(old))
        if not fs.rename(path(staging), path(target)):
            if fs.exists(path(old)):
                fs.rename(path(old), path(target))
            raise ExportFault("the table could not be put in its place")
        fs.delete(path(old), True)
    finally:
        fs.delete(path(staging), True)
    return mark


def publish_artifact(df: DataFrame, target: str, descriptor: dict) -> dict:
    """A table with a descriptor beside it that holds its fingerprint and row count."""
    mark = publish(df, target)
    return write_json(target.removeprefix("file://") + ".json", {**descriptor, "fingerprint": mark, "rows": int(mark.split("-")[0])})


def load_artifact(spark: SparkSession, target: str, required: bool = True) -> DataFrame | None:
    """The table, if its descriptor holds; without descriptor an optional one is None."""
    described = Path(target.removeprefix("file://") + ".json")
    if not described.exists():
        if required:
            raise ExportFault("the artifact has no descriptor")
        return None
    df = spark.read.parquet(target)
    if fingerprint(df) != json.loads(described.read_text())["fingerprint"]:
        raise ExportFault("the artifact isn't the one described")
    return df


def _replace(target: str | Path, content: bytes) -> None:
    target = Path(target)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=".part-")
    try:
        with os.fdopen(handle, "wb") as file:
            file.write(content)
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_json(target: str | Path, value: dict) -> dict:
    """Sorted keys, in place at once; the same value gives the same bytes."""
    _replace(target, (json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n").encode())
    return value


def publish_audit(issues: DataFrame, manifest: str | Path, report: str | Path) -> bool:
    """Write the report; a collection with an error loses its stale manifest. Whether it is valid."""
    counts = {f"{r['level']}/{r['code']}": r["count"] for r in issues.groupBy("level", "code").count().collect()}
    valid = not any(key.startswith("error/") for key in counts)
    write_json(report, {"valid": valid, "issues": counts})
    if not valid:
        Path(manifest).unlink(missing_ok=True)
    return valid


def sha256(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def checked_rows(responses: DataFrame) -> list[tuple]:
    """The responses of one query in order, as CSV rows: video, frame or frames, and an answer if there is one."""
    rows = responses.orderBy("rank").limit(MAX_ROWS + 1).collect()
    out = []
    for r in rows:
        row = r.asDict()
        video = row["video_id"]
        if not video or video.endswith(".mp4") or any(c in video for c in ",\r\n"):
            raise ExportFault("a video id can't be exported")
        frames = row["frames"] if "frames" in row else [row["frame"]]
        if not frames or any(b <= a for a, b in zip(frames, frames[1:], strict=False)):
            raise ExportFault("frames must increase")
        if (answer := row.get("answer")) is not None and (not answer or len(answer) > MAX_ANSWER):
            raise ExportFault("an answer is empty or too long")
        out.append((video, *frames, *([answer] if answer is not None else [])))
    if len(out) > MAX_ROWS or len(set(out)) < len(out):
        raise ExportFault("there are too many responses, or one is repeated")
    return out


def csv_bytes(rows: Sequence[tuple]) -> bytes:
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows)
    return text.getvalue().encode()


def write_csv(target: str | Path, responses: DataFrame) -> None:
    """Without header, one line for each response."""
    _replace(target, csv_bytes(checked_rows(responses)))


def write_zip(target: str | Path, files: dict[str, bytes]) -> None:
    """Files under ``submission/`` by name; the same files give the same bytes."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name in sorted(files):
            if "/" in name or "\\" in name or not name.endswith(".csv"):
                raise ExportFault("a member is a plain .csv name")
            archive.writestr(zipfile.ZipInfo(f"submission/{name}", (1980, 1, 1, 0, 0, 0)), files[name])
    _replace(target, buffer.getvalue())


def pack_report(diagnostics: DataFrame) -> dict:
    """Counts of a pack by task and status, and the sum of responses; no text, no prediction."""
    by = lambda c: {r[0]: r[1] for r in diagnostics.groupBy(c).count().collect()}
    return {"tasks": by("task"), "statuses": by("status"), "responses": diagnostics.agg(F.coalesce(F.sum("responses"), F.lit(0))).first()[0]}
