"""Search in the texts read from frames: postings, exact candidates, fuzzy matches."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelspan.functions import similar
from reelspan.functions import text as tx
from reelspan.operators.ranking import best_text_matches
from reelspan.session import materialise, ship

#: So many queries are sent out at once, and their texts may have so many characters.
BLOCK_QUERIES, BLOCK_CHARS = 20_000, 4_000_000
#: So many pairs of a query and a text are bounded at once.
BLOCK_PAIRS = 500_000

EXACT_WEIGHT, FUZZY_WEIGHT, CONFIDENCE_WEIGHT = 0.85, 0.65, 0.15


def derived(records: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """(ocr_id, index_row, video_id, frame_id, normal, plain, confidence): what is searched.

    Blank texts and readings without row or below ``min_confidence`` are left
    out; repeated rows of one id count once, the latest received.
    """
    ship(records.sparkSession)
    usable = records.where(F.col("ocr_id").isNotNull() & F.col("index_row").isNotNull() & F.col("raw_text").rlike("(?U)\\S") & (F.col("confidence") >= min_confidence) & ~F.isnan("confidence"))
    once = usable.groupBy("ocr_id").agg(F.max(F.struct("received_at", "index_row", "video_id", "frame_id", "raw_text", "confidence")).alias("r")).select("ocr_id", "r.*").drop("received_at")
    return once.withColumn("normal", tx.answer_form_udf("raw_text")).withColumn("plain", tx.plain_fold_udf("raw_text")).drop("raw_text")


def asked(queries: DataFrame) -> DataFrame:
    """(query_id, normal, plain) of the query texts that aren't blank."""
    usable = queries.where(F.col("query_id").isNotNull() & F.col("text").rlike("(?U)\\S")).dropDuplicates(["query_id"])
    return usable.select("query_id", tx.answer_form_udf("text").alias("normal"), tx.plain_fold_udf("text").alias("plain"))


def postings(records: DataFrame) -> DataFrame:
    """(token, ocr_id) of tokens of two characters and more."""
    return records.select("ocr_id", F.explode(F.array_distinct(tx.token_array(F.col("normal")))).alias("token")).where(F.length("token") >= 2)


def _long_tokens(text: str):
    """Distinct tokens of two characters and more."""
    return F.filter(F.array_distinct(tx.token_array(F.col(text))), lambda t: F.length(t) >= 2)


def _named(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.col("normal").alias("q_normal"), F.col("plain").alias("q_plain"))


def _judged(pairs: DataFrame) -> DataFrame:
    """Add whether the text holds the query, as it is or folded."""
    folded = (F.length("q_plain") > 0) & tx.folded_exact_allowed(F.col("q_plain")) & F.contains(F.col("plain"), F.col("q_plain"))
    return pairs.withColumn("exact", F.contains(F.col("normal"), F.col("q_normal")) | folded)


def exact_matches(records: DataFrame, queries: DataFrame, limit: int = 100) -> DataFrame:
    """Exact matches out of the postings: equal text, all tokens, or equal folded text.

    As in the engine this mirrors, the candidates are cut to the ``limit`` most
    confident before they are verified.
    """
    q = _named(queries).where(tx.exact_query_allowed(F.col("q_normal"), F.col("q_plain")))
    # the postings of a query's rarest token hold every text with all of its tokens
    posted = postings(records)
    frequency = posted.groupBy("token").agg(F.count("*").alias("n"))
    wanted = q.select("query_id", F.explode(_long_tokens("q_normal")).alias("token")).join(frequency, "token", "left")
    rare = wanted.groupBy("query_id").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.min(F.col("n").isNotNull()).alias("known")).where("known")
    near = rare.join(posted, "token").select("query_id", "ocr_id").join(q, "query_id").join(records, "ocr_id")
    by_token = near.where(F.size(F.array_except(_long_tokens("q_normal"), _long_tokens("normal"))) == 0)
    equal = q.join(records, F.col("q_normal") == F.col("normal")).select("query_id", "ocr_id")
    plain = q.where(tx.folded_exact_allowed(F.col("q_plain"))).join(records, F.col("q_plain") == F.col("plain")).select("query_id", "ocr_id")
    candidates = by_token.select("query_id", "ocr_id").unionByName(equal).unionByName(plain).distinct().join(records, "ocr_id")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("confidence").desc(), "index_row", "ocr_id"))
    kept = _judged(candidates.withColumn("_n", first).where(F.col("_n") <= limit).join(q, "query_id")).where("exact")
    score = F.round(F.least(F.lit(1.0), EXACT_WEIGHT + CONFIDENCE_WEIGHT * F.col("confidence")), 9)
    return best_text_matches(kept.select("query_id", "index_row", score.alias("score"), "exact", "confidence"), limit)


def text_search(records: DataFrame, queries: DataFrame, limit: int = 100, threshold: float = 0.72, allowed: DataFrame | None = None) -> DataFrame:
    """Exact and fuzzy matches of each query, best of each row.

    Candidates share a token or the folded text with the query; only where there
    are none, and the query is long enough, all (allowed) readings are compared.
    ``allowed`` has (query_id, index_row).

    Without ``allowed`` the queries are sent out in blocks, and each block meets
    every distinct text where it lies: pairs whose bound lies below the threshold
    are left out unseen, the rest are compared. Of equal texts the ``limit`` best
    rows are kept, no more can be among a query's matches.
    """
    q = _named(queries)
    posted = postings(records)
    wanted = q.select("query_id", F.explode(_long_tokens("q_normal")).alias("token"))
    folded = q.where(tx.folded_exact_allowed(F.col("q_plain")))
    plain = folded.join(records, F.col("q_plain") == F.col("plain")).select("query_id", "ocr_id")
    answered = wanted.join(posted.select("token").distinct(), "token", "left_semi").select("query_id").unionByName(plain.select("query_id")).distinct()
    # a query with no candidate at all is compared with every (allowed) reading
    lonely = q.join(answered, "query_id", "left_anti").where(tx.fuzzy_allowed(F.col("q_normal"), F.col("q_plain"))).select("query_id")
    if allowed is None:
        near = _compared(records, q.join(lonely.withColumn("alone", F.lit(True)), "query_id", "left"), limit, threshold)
        return _best(near, limit)
    # the allowed rows are few; their tokens are compared, the postings aren't opened
    permitted = allowed.join(records.select("ocr_id", "index_row", "normal", "plain"), "index_row").join(q, "query_id").join(lonely.withColumn("alone", F.lit(True)), "query_id", "left")
    same = tx.folded_exact_allowed(F.col("q_plain")) & (F.col("q_plain") == F.col("plain"))
    shared = F.arrays_overlap(_long_tokens("q_normal"), _long_tokens("normal"))
    pairs = permitted.where(F.coalesce(shared, F.lit(False)) | same | F.col("alone").isNotNull()).select("query_id", "ocr_id")
    judged = _judged(pairs.join(records, "ocr_id").join(q, "query_id"))
    inexact = F.when(~F.col("exact"), F.col("q_normal"))
    like = F.when(F.col("exact"), 1.0).otherwise(tx.similarity_udf(inexact, "normal", "q_plain", "plain"))
    near = judged.withColumn("like", like).where(F.col("exact") | (F.col("like") >= threshold))
    return _best(near, limit)


def _best(near: DataFrame, limit: int) -> DataFrame:
    score = F.least(F.lit(1.0), F.when(F.col("exact"), EXACT_WEIGHT).otherwise(FUZZY_WEIGHT) * F.col("like") + CONFIDENCE_WEIGHT * F.col("confidence"))
    return best_text_matches(near.select("query_id", "index_row", F.round(score, 9).alias("score"), "exact", "confidence"), limit)


def _compared(records: DataFrame, queries: DataFrame, limit: int, threshold: float) -> DataFrame:
    """(query_id, index_row, confidence, exact, like) of the matches among all readings."""
    spark = records.sparkSession
    once = records.groupBy("normal", "plain", "index_row").agg(F.max("confidence").alias("confidence"))
    best = F.row_number().over(Window.partitionBy("normal", "plain").orderBy(F.col("confidence").desc(), "index_row"))
    kept = once.withColumn("_n", best).where(F.col("_n") <= limit)
    texts = kept.groupBy("normal", "plain").agg(F.collect_list(F.struct("index_row", "confidence")).alias("rows")).withColumn("tokens", _long_tokens("normal"))
    # the tables are small and the work is in the pairs: spread over all cores
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    texts = materialise(texts.repartition(parts))
    asked = queries.select("query_id", "q_normal", "q_plain", _long_tokens("q_normal").alias("tokens"), tx.folded_exact_allowed(F.col("q_plain")).alias("folded"), F.coalesce("alone", F.lit(False)).alias("alone"))
    kind = f"`query_id` {queries.schema['query_id'].dataType.simpleString()}, exact boolean, like double, rows {texts.schema['rows'].dataType.simpleString()}"
    found, block, chars = [], [], 0
    for row in asked.toLocalIterator():
        block.append(tuple(row))
        chars += len(row["q_normal"]) + len(row["q_plain"])
        if len(block) == BLOCK_QUERIES or chars >= BLOCK_CHARS:
            found.append(_against(texts, block, kind, threshold))
            block, chars = [], 0
    if block or not found:
        found.append(_against(texts, block, kind, threshold))
    return reduce(DataFrame.unionByName, found).select("query_id", "exact", "like", F.inline("rows"))


def _against(texts: DataFrame, block: list[tuple], kind: str, threshold: float) -> DataFrame:
    """(query_id, exact, like, rows) of the texts that match a query of the block."""
    spark = texts.sparkSession
    if not block:
        return spark.createDataFrame([], kind)
    block = sorted(block, key=lambda b: len(b[1]))  # queries of like length need the same number of words
    shared = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        tokens = [frozenset(b[3]) for b in block]
        asked = [similar.Forms([b[side] for b in block]) for side in (1, 2)]
        for batch in batches:
            if not batch.num_rows:
                continue
            forms = [similar.Forms(batch.column(k).to_pylist()) for k in (0, 1)]
            words = batch.column(3).to_pylist()
            step = max(1, BLOCK_PAIRS // batch.num_rows)
            for low in range(0, len(block), step):
                some = block[low : low + step]
                passed = _passing(some, low, asked, forms, threshold)
                keys, exact, like, places = [], [], [], []
                for (q, t), sides in passed.items():
                    query_id, normal, plain, _, folded, alone = some[q]
                    n, p = forms[0].texts[t], forms[1].texts[t]
                    if not (alone or not tokens[low + q].isdisjoint(words[t]) or (folded and plain == p)):
                        continue
                    whole = normal in n or (folded and plain in p)
                    ratio = 1.0 if whole else max((SequenceMatcher(None, *((normal, n), (plain, p))[s]).ratio() for s in sides if s == 0 or min(len(plain), len(p)) >= 6), default=0.0)
                    if whole or ratio >= threshold:
                        keys.append(query_id)
                        exact.append(whole)
                        like.append(ratio)
                        places.append(t)
                if keys:
                    columns = [pa.array(keys), pa.array(exact), pa.array(like, type=pa.float64()), batch.column(2).take(pa.array(places))]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "exact", "like", "rows"])

    return texts.select("normal", "plain", "rows", "tokens").mapInArrow(run, kind)


def _passing(some: list[tuple], low: int, asked: list[similar.Forms], forms: list[similar.Forms], threshold: float) -> dict[tuple[int, int], list[int]]:
    """Pairs (query, text) that may match, with the forms (0 as it is, 1 folded) that may reach the threshold or hold the query.

    A form left out lies below the threshold, so the other one is the greater of a match.
    """
    passed: dict[tuple[int, int], list[int]] = {}
    for side in (0, 1):
        length = asked[side].length[low : low + len(some)]
        whole = np.array([side == 0 or bool(b[4]) for b in some])
        least = 0 if side == 0 else 6  # folded forms are compared from six characters on
        both = length[:, None] + forms[side].length[None, :]
        enough = (length >= least)[:, None] & (forms[side].length >= least)[None, :]
        needed = np.where(enough, threshold * both / 2 - 1e-6, np.inf)
        needed = np.minimum(needed, np.where(whole, length, np.inf)[:, None])
        q, t = np.nonzero(similar.shared(asked[side], low, low + len(some), forms[side]) >= needed)
        if not len(q):
            continue
        fits = similar.subsequence([b[1 + side] for b in some], forms[side], q, t) >= needed[q, t]
        for pair in zip(q[fits].tolist(), t[fits].tolist(), strict=True):
            passed.setdefault(pair, []).append(side)
    return passed
