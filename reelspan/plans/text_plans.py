"""Text forms, prompts and search in readings."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelspan.functions import encoders
from reelspan.functions import text as tx
from reelspan.operators import answers, hybrid, ranking, readings, search, windows
from reelspan.operators.config import HybridConfig
from reelspan.plans import retrieval_plans as retrieval
from reelspan.session import materialise, ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(make):
        def run(spark, sf_dir):
            ship(spark)
            return make(spark, sf_dir)

        QUERIES[make.__name__] = run
        if sql:
            ORACLE_SQL[make.__name__] = sql
        return run

    return keep


_SPACE = "trim(regexp_replace({0}, '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}\\x{{1680}}\\x{{205F}}\\x{{2028}}\\x{{2029}}\\x{{0085}}]+', ' ', 'g'))"


@query("SELECT doc_id, " + _SPACE.format("nfc_normalize(text)") + " AS text FROM documents WHERE text IS NOT NULL")
def composed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return documents.select("doc_id", tx.composed_udf("text").alias("text"))


@query(
    "SELECT doc_id, regexp_replace(replace(lower(strip_accents(text)), 'đ', 'd'), '[^0-9a-z]+', '', 'g') AS folded FROM documents WHERE text IS NOT NULL"
)
def plain_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return documents.select("doc_id", tx.plain_fold_udf("text").alias("folded"))


@query("SELECT hypothesis_id, " + _SPACE.format("lower(nfc_normalize(raw_answer))") + " AS answer FROM answer_hypotheses WHERE raw_answer IS NOT NULL")
def answer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "answer_hypotheses").where(F.col("raw_answer").isNotNull()).select("hypothesis_id", tx.answer_form_udf("raw_answer").alias("answer"))


@query("SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+')) AS token FROM eval_items) GROUP BY 1")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items").select(F.explode(tx.token_array(F.col("text"))).alias("token"))
    return items.groupBy("token").agg(F.count("*").alias("n"))


# what a token of the operator holds: letters, marks, digits, letter numbers, joiners and connectors but the underscore
_TOKEN = "[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\x{200C}\\x{200D}\\x{203F}\\x{2040}\\x{2054}\\x{FE33}\\x{FE34}\\x{FE4D}-\\x{FE4F}\\x{FF3F}\\x{24B6}-\\x{24E9}]+"


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS token FROM documents) GROUP BY 1")
def document_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents; every row counts."""
    tokens = table(spark, sf_dir, "documents").select(F.explode(tx.token_array(F.col("text"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def _prompts(spark: SparkSession, sf_dir: str, task: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").where(F.col("task") == task).select("item_id", "text")


_B = "(?:^|[^\\p{L}\\p{N}_])"
_E = "(?:$|[^\\p{L}\\p{N}_])"


def _kinds_sql() -> str:
    """The patterns with word bounds that know letters of every script."""
    cases = []
    for kind, patterns in tx.ANSWER_PATTERNS.items():
        inner = "|".join("(?:" + _bounded(p) + ")" for p in patterns).replace("'", "''")
        cases.append(f"WHEN regexp_matches(q, '{inner}') THEN '{kind}'")
    return "CASE " + " ".join(cases) + " ELSE 'unknown' END"


def _bounded(pattern: str) -> str:
    body = pattern.removeprefix("\\b").removesuffix("\\b")
    return _B + body.replace("\\b.*\\b", "(?:[^\\p{L}\\p{N}_].*[^\\p{L}\\p{N}_]|[^\\p{L}\\p{N}_])").replace("\\b", "") + (_E if pattern.endswith("\\b") else "")


@query("WITH q AS (SELECT item_id, " + _SPACE.format("lower(nfc_normalize(text))") + f" AS q FROM eval_items WHERE text IS NOT NULL) SELECT item_id, {_kinds_sql()} AS kind FROM q")
def answer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").where(F.col("text").isNotNull()).select("item_id", tx.answer_kind(F.col("text")).alias("kind"))


_MARK = "(?:câu\\s+hỏi|cau\\s+hoi|question)\\s*[:：]"
_BEFORE, _AFTER = ("regexp_extract(t, '(?is)^(.*?(?:.*[^\\p{L}\\p{N}_])?)" + _MARK + f"(.*)$', {k})" for k in (1, 2))


@query(
    f"""WITH p AS (SELECT item_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM eval_items WHERE task = 'qa'),
m AS (SELECT item_id, t, trim({_BEFORE}, ' ' || chr(10)) AS b, trim({_AFTER}, ' ' || chr(10)) AS a, regexp_extract(t, '(?s)^(.*[.!?])\\s+(.*)$', 1) AS sb, regexp_extract(t, '(?s)^(.*[.!?])\\s+(.*)$', 2) AS sa FROM p),
parts AS (SELECT item_id, CASE WHEN a <> '' THEN CASE WHEN b <> '' THEN b ELSE t END WHEN regexp_full_match(sa, '[^.!?]*\\?') THEN sb ELSE t END AS description,
  CASE WHEN a <> '' THEN a WHEN regexp_full_match(sa, '[^.!?]*\\?') THEN sa ELSE t END AS question FROM m),
q AS (SELECT *, """ + _SPACE.format("lower(nfc_normalize(question))") + f""" AS q FROM parts), k AS (SELECT item_id, description, question, {_kinds_sql()} AS kind FROM q)
SELECT *, kind IN ('visible_text', 'name', 'number') AS use_ocr, kind = 'speech' AS use_asr FROM k"""
)
def split_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _prompts(spark, sf_dir, "qa").select("item_id", tx.split_prompt(F.col("text")).alias("p")).select("item_id", "p.*")
    kind = parts.withColumn("kind", tx.answer_kind(F.col("question")))
    return kind.withColumn("use_ocr", F.col("kind").isin(*tx.READ_KINDS)).withColumn("use_asr", F.col("kind").isin(*tx.HEARD_KINDS))


@query(
    """WITH marked AS (SELECT item_id, unnest(regexp_split_to_array(text, '(?:^|\\s)E\\d+\\s*:?[ \\t]*')) AS event, generate_subscripts(regexp_split_to_array(text, '(?:^|\\s)E\\d+\\s*:?[ \\t]*'), 1) AS place FROM eval_items WHERE task = 'trake')
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY place) - 1 AS place, trim(event, ' ;,') AS event FROM marked WHERE trim(event, ' ;,') <> ''"""
)
def split_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir, "trake").select("item_id", F.posexplode(tx.split_events_udf("text")).alias("place", "event")).withColumn("place", F.col("place").cast("long"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: the readings whose number is divisible by 20, as query texts."""
    records = table(spark, sf_dir, "ocr_records").where(F.col("ocr_id") % 20 == 0)
    once = records.groupBy("ocr_id").agg(F.max(F.struct("received_at", "raw_text")).alias("r"))
    return once.select(F.col("ocr_id").cast("string").alias("query_id"), F.col("r.raw_text").alias("text"))


# the same forms in SQL
_NORMAL = _SPACE.format("lower(nfc_normalize(<>))")
# full-width forms as their plain ones, and what else decomposes to digits here
_WIDE = "translate(<>, '" + "".join(map(chr, range(0xFF10, 0xFF5B))) + "²³', '" + "".join(chr(c - 0xFEE0) for c in range(0xFF10, 0xFF5B)) + "23')"
_PLAIN = "regexp_replace(replace(lower(strip_accents(replace(replace(" + _WIDE + ", '½', '12'), '№', 'no'))), 'đ', 'd'), '[^0-9a-z]+', '', 'g')"
_LONG = "list_filter(list_distinct(regexp_extract_all(<>, '" + _TOKEN + "')), lambda x: length(x) >= 2)"
_GATE = "length(<>) >= CASE WHEN regexp_matches(<>, '[0-9]') THEN 4 ELSE 6 END"


def _of(form: str, value: str) -> str:
    return form.replace("<>", value)


def exact_sql(queries: str) -> str:
    """Exact matches of ``queries`` (query_id, text) as a CTE ``matches``; the readings as ``readings``."""
    return f"""readings AS (
  SELECT ocr_id, index_row, {_of(_NORMAL, "raw_text")} AS normal, {_of(_PLAIN, "raw_text")} AS plain, {_of(_LONG, _of(_NORMAL, "raw_text"))} AS words, confidence FROM ocr_records
  WHERE ocr_id IS NOT NULL AND index_row IS NOT NULL AND regexp_matches(raw_text, '\\S') AND confidence >= 0 AND NOT isnan(confidence)
  QUALIFY row_number() OVER (PARTITION BY ocr_id ORDER BY received_at DESC NULLS LAST) = 1),
asked AS (SELECT query_id, {_of(_NORMAL, "text")} AS qn, {_of(_PLAIN, "text")} AS qp, {_of(_LONG, _of(_NORMAL, "text"))} AS qw, len(regexp_extract_all({_of(_NORMAL, "text")}, '{_TOKEN}')) AS qt FROM ({queries}) WHERE regexp_matches(text, '\\S')),
candidates AS (
  SELECT query_id, ocr_id, index_row, confidence, contains(normal, qn) OR (qp <> '' AND {_of(_GATE, "qp")} AND contains(plain, qp)) AS exact FROM asked, readings
  WHERE ((regexp_matches(qp, '[0-9]') AND length(qp) >= 4) OR (qt >= 2 AND length(qp) >= 6))
    AND ((len(qw) > 0 AND list_has_all(words, qw)) OR normal = qn OR ({_of(_GATE, "qp")} AND plain = qp))
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, index_row, ocr_id) <= 100),
matches AS (
  SELECT query_id, index_row, round(least(1.0, 0.85::DOUBLE + 0.15::DOUBLE * confidence), 9) AS score, exact, confidence FROM candidates WHERE exact
  QUALIFY row_number() OVER (PARTITION BY query_id, index_row ORDER BY confidence DESC) = 1)
"""


_BEST = "SELECT query_id, index_row, score, exact, confidence, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, exact DESC, confidence DESC, index_row) AS rank FROM matches QUALIFY rank <= 100"
_TEXT_QUERIES = "SELECT CAST(ocr_id AS VARCHAR) AS query_id, raw_text AS text FROM ocr_records WHERE ocr_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY ocr_id ORDER BY received_at DESC NULLS LAST) = 1"


@query("WITH " + exact_sql(_TEXT_QUERIES) + _BEST)
def exact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.exact_matches(materialise(readings.derived(table(spark, sf_dir, "ocr_records"))), materialise(readings.asked(text_queries(spark, sf_dir))))


# what is read in the best hit of each search that has a reading is what its text search asks for
_SEEN = """SELECT query_id, arg_min(raw_text, rank * 10000000000 + ocr_id) AS text FROM (
  SELECT DISTINCT h.query_id, h.rank, o.ocr_id, o.raw_text FROM hits h JOIN (
    SELECT * FROM ocr_records WHERE ocr_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ocr_id ORDER BY received_at DESC NULLS LAST) = 1) o USING (index_row) WHERE regexp_matches(o.raw_text, '\\S')) GROUP BY 1"""


def seen_texts(hits: DataFrame, records: DataFrame) -> DataFrame:
    """(query_id, text): what is read in the best ranked hit of each list that has a reading."""
    latest = records.where(F.col("ocr_id").isNotNull()).groupBy("ocr_id").agg(F.max(F.struct("received_at", "index_row", "raw_text")).alias("r")).select("ocr_id", "r.index_row", "r.raw_text")
    shown = hits.join(latest.where(F.col("raw_text").rlike("(?U)\\S")), "index_row")
    return shown.groupBy("query_id").agg(F.min_by("raw_text", F.struct("rank", "ocr_id")).alias("text"))


def text_matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The hits, and the exact text matches of each list's own text among all readings."""
    hits, records = materialise(retrieval.hits(spark, sf_dir)), table(spark, sf_dir, "ocr_records")
    return hits, readings.exact_matches(materialise(readings.derived(records)), materialise(readings.asked(seen_texts(hits, records))))


@query(retrieval._HITS + ", " + exact_sql(_SEEN) + _BEST)
def text_match_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_matches(spark, sf_dir)[1]


@query(
    retrieval._HITS + ", " + exact_sql(_SEEN)
    + """, boosted AS (SELECT h.query_id, h.index_row, round(h.score + 0.2 * coalesce(m.score, 0.0), 9) AS score FROM hits h LEFT JOIN matches m ON m.query_id = h.query_id AND m.index_row = h.index_row)
SELECT query_id, index_row, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, index_row) AS rank FROM boosted"""
)
def text_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, matches = text_matches(spark, sf_dir)
    return ranking.boosted_by_text(hits, matches, 0.2).select("query_id", "index_row", "score", "rank")


@query()
def fuzzy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy search of the stated query set in all readings."""
    records = materialise(readings.derived(table(spark, sf_dir, "ocr_records")))
    return readings.text_search(records, readings.asked(text_queries(spark, sf_dir)))


def _engine():
    """A stand-in: it picks a frame by the question's length, and fails on some windows."""

    def answer(question: str, description: str, frames) -> str:
        if frames[0] % 7 == 0:
            raise ValueError("unclear")
        return f"{len(question) % len(frames)}\tAbout {len(description)}"

    return answer


def qa_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The qa prompts, dealt to the lists in turn, and the evidence windows of the lists."""
    hits = materialise(retrieval.hits(spark, sf_dir))
    items = _prompts(spark, sf_dir, "qa").select((F.row_number().over(Window.orderBy("item_id")) - 1).alias("p"), "text")  # a fixed table of few prompts
    number = F.regexp_extract("query_id", r"(\d+)", 1).cast("long")
    prompts = hits.select("query_id").distinct().crossJoin(items.agg(F.count("*").alias("n"))).select("query_id", (number % F.col("n")).alias("p")).join(items, "p").select("query_id", "text")
    return prompts, materialise(windows.evidence_windows(hits, table(spark, sf_dir, "videos")))


_QA = retrieval._WINDOWS.replace("WITH RECURSIVE once", "WITH RECURSIVE " + ORACLE_SQL["split_prompts"].split("WITH ", 1)[1].split("q AS (SELECT *, ")[0] + "once") + """,
numbered AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS p, count(*) OVER () AS n FROM parts),
asked AS (SELECT w.*, question, description FROM placed w JOIN numbered ON CAST(regexp_extract(w.query_id, '(\\d+)', 1) AS BIGINT) % n = p),
hypo AS (SELECT query_id, video_id, samples[length(question) % len(samples) + 1] AS frame_id, 'about ' || length(description) AS normalized_answer, score AS joint_score FROM asked WHERE samples[1] % 7 <> 0),
best AS (SELECT query_id, video_id, frame_id, normalized_answer, max(joint_score) AS joint_score FROM hypo GROUP BY 1, 2, 3, 4)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY joint_score DESC, video_id, frame_id, normalized_answer) AS rank FROM best QUALIFY rank <= 100"""


@query(_QA)
def qa_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of a stand-in engine from the windows of every list."""
    prompts, seen = qa_inputs(spark, sf_dir)
    return answers.answered(prompts, seen, _engine).drop("raw_answer")


@query()
def qa_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every qa prompt."""
    prompts, seen = qa_inputs(spark, sf_dir)
    found = materialise(answers.hypotheses(prompts, seen, _engine))
    return answers.outcomes(prompts, seen, found, windows.ranked_answers(found))


def _encoded(texts: DataFrame) -> DataFrame:
    return texts.withColumn("embedding", encoders.encoder_udf(lambda: encoders.hash_encoder(64))("text"))


def _search(spark: SparkSession, sf_dir: str, texts: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """Hits of texts under their keys, by the stand-in encoder, in all rows."""
    index = table(spark, sf_dir, "index_vectors")
    asked = _encoded(texts).select(F.to_json(F.struct(*keys)).alias("key"), "embedding")
    kinds = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)
    hits = search.exact_topk(index, asked, depth, query="key").select(F.from_json("key", kinds).alias("k"), "index_row", "score", "rank").select("k.*", "index_row", "score", "rank")
    return hits.join(index.select("index_row", "video_id", F.col("original_frame_id").alias("frame")), "index_row")


@query()
def retrieved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of the ordered-event prompts, each event searched for by a stand-in encoder."""
    prompts = _prompts(spark, sf_dir, "trake").select(F.col("item_id").alias("query_id"), "text")
    return answers.retrieved_paths(prompts, lambda events: _search(spark, sf_dir, events, ["query_id", "event"], 100))


def _planner():
    """A stand-in: the parts of a request are its clauses and, of two and more, its events; it fails on long requests."""

    def plan(text: str) -> str:
        parts = list(dict.fromkeys(p.strip()[:200] for p in tx.composed(text).split(". ") if p.strip()))[:3]
        if len(text) > 600:
            return "not a plan"
        events = [{"visual": p, "exact_text": None} for p in parts] if len(parts) > 1 else []
        return json.dumps({"holistic_visual": parts[0], "visual_clauses": parts, "ordered_events": events, "exact_texts": []})

    return plan


@query()
def hybrid_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval for all search requests at once, by a stand-in planner and encoder."""
    config = HybridConfig(enabled=True)
    requests = _prompts(spark, sf_dir, "kis").select(F.col("item_id").alias("query_id"), "text")
    plans = materialise(hybrid.planned(requests, _planner, config))
    depth = max(config.raw_depth, config.auxiliary_depth)
    return hybrid.hybrid_set(plans, lambda texts: _search(spark, sf_dir, texts, ["query_id", "list_id"], depth), config).select("query_id", "index_row", "score", "rank", "fused")
