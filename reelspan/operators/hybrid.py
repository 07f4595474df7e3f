"""Hybrid retrieval: lists of a generated plan fused, completed by text matches and boosted by event chains.

Models are plug-ins: an encoder makes a vector of a text, a planner a plan of a
query. What fails falls back to the plain list, as each step says.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.functions.text import TextFault, baseline_plan, parse_query_plan
from reelspan.operators import ranking, temporal
from reelspan.operators.config import HybridConfig, RerankerConfig
from reelspan.session import materialise, ship


@dataclass(frozen=True)
class Outcome:
    """What was applied; never the query's text."""

    planned: bool
    lists: int
    text_applied: bool
    temporal_applied: bool
    fallback: bool


def plan_lists(plan: dict, config: HybridConfig) -> list[tuple[int, str, float, int, int | None, str]]:
    """(list_id, kind, weight, depth, event, text) of a plan: what is to be searched."""
    lists = []
    for kind, text in plan["visuals"]:
        lists.append((len(lists), kind, config.weight(kind), config.raw_depth if kind == "raw" else config.auxiliary_depth, None, text))
    for event, (text, _) in enumerate(plan["events"]):
        lists.append((len(lists), "event", config.weight("event"), config.auxiliary_depth, event, text))
    return lists


def hybrid(
    query_id: str,
    query: str,
    search: Callable[[Sequence[tuple[int, str]], int], DataFrame],
    planner: Callable[[str], str],
    config: HybridConfig,
    text_matches: Callable[[Sequence[str], DataFrame], DataFrame] | None = None,
    clock: Callable[[], float] = time.perf_counter,
) -> tuple[DataFrame, Outcome]:
    """The ranked list of one query.

    ``search(texts, depth)`` gives (list_id, rank, index_row, video_id, frame,
    score) for (list_id, text) pairs; ``text_matches(texts, fused)`` gives
    (event_text, rank, index_row, video_id, frame, score). Disabled, without a
    plan, or with a plan that came too late, the plain list is the result.
    """
    plain = search([(0, query)], config.raw_depth).withColumn("query_id", F.lit(query_id)).drop("list_id")
    if not config.enabled:
        return plain, Outcome(False, 1, False, False, False)
    started = clock()
    try:
        plan = parse_query_plan(planner(query), query)
    except (TextFault, ValueError, RuntimeError, TypeError):
        return plain, Outcome(False, 1, False, False, True)
    if clock() - started > config.planner_seconds:
        return plain, Outcome(False, 1, False, False, True)
    lists = plan_lists(plan, config)
    info = plain.sparkSession.createDataFrame([(i, w, d, -1 if e is None else e) for i, _, w, d, e, _ in lists], "list_id int, weight double, depth int, event int")
    hits = search([(i, text) for i, _, _, _, _, text in lists], max(config.raw_depth, config.auxiliary_depth))
    hits = hits.join(F.broadcast(info), "list_id").where(F.col("rank") <= F.col("depth")).withColumn("query_id", F.lit(query_id))
    fused = ranking.reciprocal_rank_fusion(hits, config.rrf_k)
    text_applied = bool(config.ocr_enabled and text_matches is not None and plan["exact_texts"])
    events = hits.where(F.col("event") >= 0).select("query_id", "event", "rank", "index_row", "video_id", "frame")
    if text_applied:
        found = text_matches(plan["exact_texts"], fused)
        columns = ["query_id", "list_id", "weight", "rank", "index_row", "video_id", "frame"]
        added = found.groupBy("index_row", "video_id", "frame").agg(F.max("score").alias("score")).withColumn("query_id", F.lit(query_id))
        added = ranking.placed(added, [F.col("score").desc(), F.col("index_row")], config.ocr_depth).withColumns({"list_id": F.lit(len(lists)), "weight": F.lit(config.ocr_weight)})
        fused = ranking.reciprocal_rank_fusion(hits.select(*columns).unionByName(added.select(*columns)), config.rrf_k)
        # an event with an exact text is where that text is read
        for number, (_, exact) in enumerate(plan["events"]):
            if exact is not None:
                read = found.where(F.col("event_text") == exact).select(F.lit(query_id).alias("query_id"), F.lit(number).alias("event"), "rank", "index_row", "video_id", "frame")
                events = events.where(F.col("event") != number).unionByName(read)
    needs_text = any(exact is not None for _, exact in plan["events"])
    temporal_applied = config.temporal_enabled and len(plan["events"]) >= 2 and (text_applied or not needs_text)
    if temporal_applied:
        final_text = plan["events"][-1][1] is not None
        chains = temporal.event_chains(events, len(plan["events"]), config.max_frame_gap, penalty=config.gap_penalty, bonus=config.full_bonus, prefer_final=final_text, depth=config.auxiliary_depth)
        fused = temporal.boosted_by_chains(fused, chains, config.boost_weight)
    if len(lists) == 1 and not text_applied:
        return plain, Outcome(True, 1, False, False, False)
    return fused, Outcome(True, len(lists), text_applied, temporal_applied, False)


def planned(queries: DataFrame, load: Callable[[], Callable[[str], str]], config: HybridConfig, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """(query_id, fallback, exact, lists): the plans of a set of queries (query_id, text).

    The planner is loaded once in each worker. A query whose plan fails, breaks
    its contract or comes too late falls back to its own text alone. ``lists``:
    (list_id, weight, depth, event, text, exact_text).
    """
    ship(queries.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planner = load() if config.enabled else None
        for batch in batches:
            out = []
            for key, query in zip(batch.query_id, batch.text, strict=True):
                began, fallback = clock(), False
                plan = baseline_plan(query)
                if planner is not None:
                    try:
                        plan = parse_query_plan(planner(query), query)
                    except Exception:  # noqa: BLE001 - whatever a planner raises, the query is searched as it is
                        fallback = True
                    if clock() - began > config.planner_seconds:
                        plan, fallback = baseline_plan(query), True
                lists = [{"list_id": i, "weight": w, "depth": d, "event": e, "text": t, "exact_text": None if e is None else plan["events"][e][1]} for i, _, w, d, e, t in plan_lists(plan, config)]
                out.append((key, fallback, plan["exact_texts"], lists))
            yield pd.DataFrame(out, columns=["query_id", "fallback", "exact", "lists"])

    kind = queries.schema["query_id"].dataType.simpleString()
    usable = queries.where(F.col("query_id").isNotNull() & F.col("text").rlike("(?U)\\S")).dropDuplicates(["query_id"]).select("query_id", "text")
    return usable.mapInPandas(run, f"query_id {kind}, fallback boolean, exact array<string>, lists array<struct<list_id:int,weight:double,depth:int,event:int,text:string,exact_text:string>>")


def hybrid_set(
    plans: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    config: HybridConfig,
    text_matches: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The ranked lists of a set of planned queries: (query_id, index_row, video_id, frame, score, rank, fused).

    ``search`` gives (query_id, list_id, rank, index_row, video_id, frame, score)
    for (query_id, list_id, depth, text); ``text_matches`` gives (query_id,
    exact_text, rank, index_row, video_id, frame, score) for (query_id,
    exact_text). Queries with one list and no text match keep the score of that
    list (``fused`` false); the others are fused, completed by text matches, and
    those of two events and more are boosted by their chains; a query whose
    events name an exact text only if there are text matches to look in.
    """
    wanted = materialise(plans.select("query_id", F.size("exact").alias("n_exact"), F.inline("lists")))
    found = search(wanted.select("query_id", "list_id", "depth", "text"))
    hits = materialise(found.join(wanted.drop("text"), ["query_id", "list_id"]).where(F.col("rank") <= F.col("depth")))
    columns = ["query_id", "list_id", "weight", "rank", "index_row", "video_id", "frame"]
    every, read = hits.select(*columns), None
    if config.ocr_enabled and text_matches is not None:
        read = materialise(text_matches(plans.select("query_id", F.explode("exact").alias("exact_text"))))
        best = read.groupBy("query_id", "index_row", "video_id", "frame").agg(F.max("score").alias("score"))
        added = ranking.placed(best, [F.col("score").desc(), F.col("index_row")], config.ocr_depth)
        every = every.unionByName(added.select("query_id", F.lit(-1).alias("list_id"), F.lit(config.ocr_weight).alias("weight"), "rank", "index_row", "video_id", "frame"))
    lists = wanted.groupBy("query_id").agg(F.count("*").alias("n_lists"), F.max("n_exact").alias("n_exact"), F.count("event").alias("n_events"), F.max(F.col("exact_text").isNotNull()).alias("needs_text"), F.max_by("exact_text", F.coalesce("event", F.lit(-1))).isNotNull().alias("ends_in_text"))
    lists = materialise(lists.withColumn("with_text", (F.col("n_exact") > 0) & F.lit(read is not None)))
    fused = ranking.reciprocal_rank_fusion(every, config.rrf_k)
    if config.temporal_enabled:
        events = hits.where(F.col("event").isNotNull())
        columns = ["query_id", "event", "rank", "index_row", "video_id", "frame"]
        seen = events.where(F.col("exact_text").isNull()).select(*columns)
        if read is not None:
            # an event with an exact text is where that text is read
            named = wanted.where(F.col("exact_text").isNotNull()).select("query_id", "event", "exact_text")
            seen = seen.unionByName(named.join(read, ["query_id", "exact_text"]).select(*columns))
        able = lists.where((F.col("n_events") >= 2) & (F.col("with_text") | ~F.col("needs_text")))
        chains = []
        for n in range(2, temporal.MAX_EVENTS + 1):
            for final in (False, True):
                some = seen.join(able.where((F.col("n_events") == n) & (F.col("ends_in_text") == final)).select("query_id"), "query_id", "left_semi")
                chains.append(temporal.event_chains(some, n, config.max_frame_gap, penalty=config.gap_penalty, bonus=config.full_bonus, prefer_final=final, depth=config.auxiliary_depth))
        fused = temporal.boosted_by_chains(fused, reduce(DataFrame.unionByName, chains), config.boost_weight)
    plain = lists.where((F.col("n_lists") == 1) & ~F.col("with_text")).select("query_id")
    names = ["query_id", "index_row", "video_id", "frame", "score", "rank"]
    whole = fused.join(plain, "query_id", "left_anti").select(*names, F.lit(True).alias("fused"))
    return whole.unionByName(hits.join(plain, "query_id", "left_semi").select(*names, F.lit(False).alias("fused")))


class Reranker:
    """Runs a re-ranking within its budget; after one overrun it stays off."""

    def __init__(self, config: RerankerConfig, rerank: Callable[[DataFrame], DataFrame], clock: Callable[[], float] = time.perf_counter) -> None:
        self.config, self.rerank, self.clock = config, rerank, clock
        self.open = False

    def __call__(self, hits: DataFrame) -> tuple[DataFrame, str]:
        """The hits, re-ranked or as they were, and what happened: applied, disabled, open, late, failed or changed."""
        if not self.config.enabled:
            return hits, "disabled"
        if self.open:
            return hits, "open"
        began = self.clock()
        try:
            found = materialise(self.rerank(hits))
            key = F.xxhash64("query_id", "index_row").cast("decimal(38,0)")
            mark = lambda df: df.agg(F.count("*"), F.count_distinct("query_id", "index_row"), F.sum(key)).first()
            bad = found.where(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == F.lit(float("inf"))))
            same = mark(found) == mark(hits) and bad.isEmpty()
        except Exception:  # noqa: BLE001 - whatever a plug-in raises, the list stays
            return hits, "failed"
        if self.clock() - began > self.config.budget_seconds:
            self.open = True
            return hits, "late"
        return (found, "applied") if same else (hits, "changed")
