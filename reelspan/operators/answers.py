"""Answers from evidence windows, and events retrieved and aligned. Models are plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.functions import text as tx
from reelspan.operators.temporal import event_paths
from reelspan.operators.windows import ranked_answers
from reelspan.session import ship

#: An engine gets question, description and the frames of a window, and answers ``<slot><tab><answer>``.
Engine = Callable[[str, str, Sequence[int]], str]


class NoEngine(RuntimeError):
    """There is no answer engine."""


def closed_engine() -> Engine:
    """The engine of where there is none: it answers nothing."""

    def answer(question: str, description: str, frames: Sequence[int]) -> str:
        raise NoEngine("no answer engine is there")

    return answer


def frame_evidence(windows: DataFrame) -> DataFrame:
    """(query_id, video_id, start_frame, end_frame, slot, frame): the sampled frames of every window, slots from 0."""
    return windows.select("query_id", "video_id", "start_frame", "end_frame", F.posexplode("samples").alias("slot", "frame"))


def evidence_faults(windows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Windows whose evidence breaks the contract: none, slots with gaps, other frames than the sampled ones, or frames outside."""
    key = ["query_id", "video_id", "start_frame", "end_frame"]
    got = evidence.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("slot", "frame"))).alias("e"))
    joined = windows.select(*key, "samples").join(got, key, "left")
    frames, slots = F.transform("e", lambda x: x["frame"].cast("long")), F.transform("e", lambda x: x["slot"].cast("long"))
    fault = (
        F.when(F.coalesce(F.size("e"), F.lit(0)) <= 0, "none")
        .when(slots != F.sequence(F.lit(0).cast("long"), F.size("e").cast("long") - 1), "slots")
        .when(frames != F.col("samples").cast("array<bigint>"), "frames")
        .when(F.exists(frames, lambda f: (f < F.col("start_frame")) | (f > F.col("end_frame"))), "outside")
    )
    return joined.withColumn("fault", fault).where(F.col("fault").isNotNull()).select(*key, "fault")


def hypotheses(prompts: DataFrame, windows: DataFrame, load: Callable[[], Engine] = closed_engine) -> DataFrame:
    """One hypothesis for each window that the engine answers.

    ``prompts``: (query_id, text); ``windows``: those of ``evidence_windows``.
    The engine is loaded once in each worker. Windows it fails on, or answers
    against the protocol, have none; blank prompts have none; the prompts of a
    query are one. Scores: support 1, agreement 0, joint that of retrieval.
    """
    ship(prompts.sparkSession)
    asked = prompts.dropDuplicates(["query_id"]).select("query_id", tx.split_prompt(F.col("text")).alias("p")).where(F.col("p.question").isNotNull())
    rows = windows.select("query_id", "video_id", "samples", "score").join(asked.select("query_id", "p.question", "p.description"), "query_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = load()
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                try:
                    slot, answer = tx.parse_answer_line(engine(r.question, r.description, [int(f) for f in r.samples]), len(r.samples))
                except Exception:  # noqa: BLE001 - whatever an engine raises, the other windows count
                    continue
                out.append((r.query_id, r.video_id, int(r.samples[slot]), answer, tx.answer_form(answer), r.score, 1.0, 0.0, r.score))
            yield pd.DataFrame(out, columns=_COLUMNS)

    kind = windows.schema["query_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"query_id {kind}, video_id string, frame_id long, raw_answer string, normalized_answer string, retrieval_score double, support_score double, agreement_score double, joint_score double")


_COLUMNS = ["query_id", "video_id", "frame_id", "raw_answer", "normalized_answer", "retrieval_score", "support_score", "agreement_score", "joint_score"]


def answered(prompts: DataFrame, windows: DataFrame, load: Callable[[], Engine] = closed_engine, limit: int = 100) -> DataFrame:
    """The ranked distinct answers of every query."""
    return ranked_answers(hypotheses(prompts, windows, load), limit)


def outcomes(prompts: DataFrame, windows: DataFrame, found: DataFrame, responses: DataFrame) -> DataFrame:
    """(query_id, parsed, windows, hypotheses, responses) of every prompt: what became of it."""
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    every = prompts.dropDuplicates(["query_id"]).select("query_id", F.coalesce(F.col("text").rlike("(?U)\\S"), F.lit(False)).alias("parsed"))
    for df, name in ((windows, "windows"), (found, "hypotheses"), (responses, "responses")):
        every = every.join(count(df, name), "query_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return every


def retrieved_paths(prompts: DataFrame, search: Callable[[DataFrame], DataFrame], gap_penalty: float = 0.01, candidates: int = 50, max_videos: int = 100, max_paths: int = 100) -> DataFrame:
    """The paths of ordered-event prompts: every event is searched for, and the hits of one prompt are aligned.

    ``prompts``: (query_id, text); ``search`` gives (query_id, event, score,
    index_row, video_id, frame) for (query_id, event, text). Prompts without
    events have no paths; those of one event have one path for each hit.
    """
    ship(prompts.sparkSession)
    events = prompts.dropDuplicates(["query_id"]).select("query_id", F.posexplode(tx.split_events_udf("text")).alias("event", "text"))
    counts = events.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = search(events).join(counts, "query_id")
    sizes = [r["n"] for r in counts.select("n").distinct().orderBy("n").collect()]  # a prompt has few events
    found = [event_paths(hits.where(F.col("n") == n).drop("n"), n, gap_penalty, candidates, max_videos, max_paths) for n in sizes]
    if not found:
        return event_paths(hits.drop("n"), 1, gap_penalty, candidates, max_videos, max_paths)
    return reduce(DataFrame.unionByName, found)
