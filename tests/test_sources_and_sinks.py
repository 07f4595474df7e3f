import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspan.functions.encoders import encoder_udf, hash_encoder
from reelspan.operators import config, hybrid, search
from reelspan.sources import files, sinks
from reelspan.streaming import hits as streaming


def test_mapping_and_features_make_an_index(spark, tmp_path):
    (tmp_path / "map").mkdir()
    (tmp_path / "map" / "v.csv").write_bytes("﻿n,frame_idx,pts_time,fps\n001,10,0.4,25\n002,50,,\n".encode())
    rows = files.mappings(spark, str(tmp_path / "map")).orderBy("ordinal").collect()
    assert [(r.key, r.frame, r.pts_time) for r in rows] == [("001", 10, 0.4), ("002", 50, None)]
    (tmp_path / "feat").mkdir()
    matrix = np.zeros((3, 64), dtype=np.float32)
    matrix[0, 0], matrix[1, 1] = 2, 3
    np.save(tmp_path / "feat" / "v.npy", matrix)
    feats = files.features(spark, str(tmp_path / "feat"))
    probe = files.feature_probe(feats).first()
    assert (probe.rows, probe.dimension, probe.finite, probe.normalized) == (3, 64, True, False)
    keyframes = spark.createDataFrame([("v", "1", 0, 10, 1), ("v", "2", 1, 50, 0), ("v", "3", 2, 60, 2), ("v", "4", 3, 70, None)], "video_id string, keyframe_id string, keyframe_ordinal long, original_frame_id long, clip_row long")
    keyframes = keyframes.withColumns({"keyframe_path": F.lit("p"), "object_path": F.lit(None).cast("string")})
    index = search.built_index(keyframes, feats)
    assert [(r.index_row, r.keyframe_id) for r in index.orderBy("index_row").collect()] == [(0, "1"), (1, "2")]
    assert search.index_differences(index, index).count() == 0
    assert files.listing(spark, str(tmp_path), "*.npy").first().stem == "v"
    (tmp_path / "map" / "w.csv").write_text("n,frame_idx\n")
    with pytest.raises(Exception, match="no rows"):
        files.mappings(spark, str(tmp_path / "map")).collect()


def test_search_ties_and_unusable_vectors(spark):
    vec = lambda *x: [float(v) for v in x] + [0.0] * (64 - len(x))
    index = spark.createDataFrame([(0, vec(1, 0)), (1, vec(2, 0)), (2, vec(0, 1)), (3, vec()), (4, None), (5, [1.0])], "index_row long, embedding array<float>")
    queries = index.where("index_row in (1, 3)").withColumnRenamed("index_row", "query_row")
    out = search.exact_topk(index, queries, 2).orderBy("query_row", "rank").collect()
    assert [(r.query_row, r.index_row, r.score) for r in out] == [(1, 0, 1.0), (1, 1, 1.0)]
    assert search.exact_topk(index.limit(0), queries, 2).count() == 0 and search.exact_topk(index, queries.limit(0), 2).count() == 0


def test_packs_and_sets(spark, tmp_path):
    for name, text in (("b-kis.txt", "find"), ("a-qa.txt", "what?"), ("c-trake.txt", "E1: x"), ("note.md", "no"), ("other.txt", "no")):
        (tmp_path / name).write_text(text)
    assert [(r.query_id, r.task) for r in files.query_pack(spark, str(tmp_path)).orderBy("query_id").collect()] == [("a-qa", "qa"), ("b-kis", "kis"), ("c-trake", "trake")]
    good = {"version": 1, "task": "kis", "query_encoder": {"model_id": "m", "preprocessing": "p"}, "queries": [{"query_id": "q", "ground_truth": {"video_id": "v", "start": 1, "end": 2}}]}
    source = tmp_path / "set.json"
    source.write_text(json.dumps(good))
    queries = files.query_set(spark, source)
    assert queries.first().end == 2
    for bad in ({**good, "more": 1}, {**good, "version": 2}, {**good, "queries": []}, {**good, "queries": good["queries"] * 2}):
        source.write_text(json.dumps(bad))
        with pytest.raises(files.SourceFault):
            files.query_set(spark, source)
    texts = tmp_path / "texts.json"
    texts.write_text('{"q": "hello"}')
    assert files.private_texts(spark, texts, queries).count() == 1
    texts.write_text('{"q": "hello", "r": "x"}')
    with pytest.raises(files.SourceFault):
        files.private_texts(spark, texts, queries)


def test_publishing(spark, tmp_path):
    df = spark.range(5)
    target = f"file://{tmp_path}/table"
    sinks.publish_artifact(df, target, {"model": "m"})
    sinks.publish_artifact(spark.range(6), target, {"model": "m"})
    assert sinks.load_artifact(spark, target).count() == 6
    assert sinks.load_artifact(spark, f"file://{tmp_path}/none", required=False) is None
    described = tmp_path / "table.json"
    described.write_text(described.read_text().replace("6-", "7-"))
    with pytest.raises(sinks.ExportFault):
        sinks.load_artifact(spark, target)
    responses = spark.createDataFrame([(2, "v", 5, "no"), (1, "v", 4, "yes, sir")], "rank long, video_id string, frame long, answer string")
    sinks.write_csv(tmp_path / "q.csv", responses)
    assert (tmp_path / "q.csv").read_bytes() == b'v,4,"yes, sir"\nv,5,no\n'
    for bad in (responses.withColumn("video_id", F.lit("a.mp4")), responses.withColumn("answer", F.lit("x" * 101)), responses.withColumns({"frame": F.lit(1), "answer": F.lit("a")})):
        with pytest.raises(sinks.ExportFault):
            sinks.checked_rows(bad)
    sinks.write_zip(tmp_path / "a.zip", {"b.csv": b"1", "a.csv": b"2"})
    sinks.write_zip(tmp_path / "b.zip", {"a.csv": b"2", "b.csv": b"1"})
    assert (tmp_path / "a.zip").read_bytes() == (tmp_path / "b.zip").read_bytes()
    (tmp_path / "manifest").write_text("old")
    issues = spark.createDataFrame([("c", "error", "e")], "code string, level string, entity string")
    assert not sinks.publish_audit(issues, tmp_path / "manifest", tmp_path / "report.json") and not (tmp_path / "manifest").exists()
    diag = spark.createDataFrame([("kis", "ok", 3), ("qa", "ok", 0)], "task string, status string, responses long")
    assert sinks.pack_report(diag) == {"tasks": {"kis": 1, "qa": 1}, "statuses": {"ok": 2}, "responses": 3}


def test_configuration():
    assert config.load(config.RetrievalConfig, {"result_limit": 5}).result_limit == 5
    for kind, bad in ((config.RetrievalConfig, {"result_limit": 0}), (config.RetrievalConfig, {"no": 1}), (config.HybridConfig, {"raw_weight": 0}), (config.RerankerConfig, {"enabled": True}), (config.EncoderConfig, {"model_id": "m", "revision": "main"})):
        with pytest.raises(config.ConfigFault):
            config.load(kind, bad)


def test_hybrid_falls_back_and_boosts(spark):
    rows = [(k, "v" if k < 3 else "w", 10 * k) for k in range(6)]

    def find(texts, depth):
        data = [(i, n + 1, (r + i) % 6, rows[(r + i) % 6][1], rows[(r + i) % 6][2], 1.0 - n / 10) for i, _ in texts for n, r in enumerate(range(min(depth, 6)))]
        return spark.createDataFrame(data, "list_id int, rank long, index_row long, video_id string, frame long, score double")

    on = config.HybridConfig(enabled=True)
    plan = json.dumps({"holistic_visual": None, "visual_clauses": ["c"], "ordered_events": [{"visual": "x", "exact_text": None}, {"visual": "y", "exact_text": None}], "exact_texts": []})
    assert hybrid.hybrid("q", "text", find, lambda q: plan, config.HybridConfig())[1].lists == 1
    assert hybrid.hybrid("q", "text", find, lambda q: "nonsense", on)[1].fallback
    ticks = iter([0.0, 9.0])
    assert hybrid.hybrid("q", "text", find, lambda q: plan, on, clock=lambda: next(ticks))[1].fallback
    fused, outcome = hybrid.hybrid("q", "text", find, lambda q: plan, on)
    assert outcome.temporal_applied and outcome.lists == 4 and fused.count() == 6
    hits = find([(0, "t")], 6).withColumn("query_id", F.lit("q"))
    good = config.RerankerConfig(enabled=True, positive_weight=1.0)
    assert hybrid.Reranker(good, lambda h: h)(hits)[1] == "applied"
    assert hybrid.Reranker(good, lambda h: h.limit(2))(hits)[1] == "changed"
    assert hybrid.Reranker(good, lambda h: 1 / 0)(hits)[1] == "failed"
    ticks = iter([0.0, 9.0])
    late = hybrid.Reranker(good, lambda h: h, clock=lambda: next(ticks))
    assert late(hits)[1] == "late" and late(hits)[1] == "open"


def test_encoder(spark):
    encode = encoder_udf(lambda: hash_encoder(16))
    out = [r.v for r in spark.createDataFrame([("a b",), ("A  b",), (None,), (" ",)], "t string").coalesce(1).select(encode("t").alias("v")).collect()]
    assert out[0] == out[1] and out[2] is None and out[3] is None and abs(sum(x * x for x in out[0]) - 1) < 1e-5


def test_streams(spark, tmp_path):
    schema = "query_id string, index_row long, video_id string, score double, received_at timestamp"
    source = spark.sql("select * from values ('q', 1L, 'v', 0.5D, timestamp '2025-01-01 00:00:00'), ('q', 1L, 'v', 0.5D, timestamp '2025-01-01 00:01:00'), ('q', 2L, 'v', 0.9D, timestamp '2025-01-01 00:02:00'), ('r', 3L, null, 0.1D, timestamp '2025-01-01 09:00:00') as t(query_id, index_row, video_id, score, received_at)")
    source.coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    run = streaming.distinct_hits(read()).writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    run.awaitTermination(120)
    assert spark.table("once").count() == 3
    run = streaming.hits_per_video(read()).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    run.awaitTermination(120)
    assert [(r.video_id, r.n, r.best) for r in spark.table("counts").collect()] == [("v", 3, 0.9)]
    run = streaming.keep_best(read(), f"{tmp_path}/best", 1).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c3").start()
    run.awaitTermination(120)
    assert [r.index_row for r in spark.read.parquet(f"{tmp_path}/best/v0").collect()] == [2]


def test_search_keys_of_any_type_many_batches_and_queries(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    points = rng.integers(-2, 3, size=(400, 64)).astype(float)  # many equal cosines
    index = spark.createDataFrame([(f"r{k:03d}", [float(x) for x in p]) for k, p in enumerate(points)], "index_row string, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(k, [float(x) for x in points[k]]) for k in range(0, 400, 7)] + [(-1, None)], "query_row int, embedding array<float>")
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    want = set()
    for q in range(0, 400, 7):
        scores = np.round(unit @ unit[q], 6)
        order = np.lexsort((np.arange(400), -scores))[:5]
        want |= {(q, f"r{r:03d}", n + 1) for n, r in enumerate(order.tolist())}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        found = {(r.query_row, r.index_row, r["rank"]) for r in search.exact_topk(index, queries, 5).collect()}
        search.BLOCK_BYTES, size = 20 * 8 * 64, search.BLOCK_BYTES
        blocks = {(r.query_row, r.index_row, r["rank"]) for r in search.exact_topk(index, queries, 5).collect()}
        search.BLOCK_BYTES = size
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == blocks == want


def test_a_changed_index_is_found_out(spark):
    rows = [(k, "v", f"k{k}", k, "p", [1.0 if j == k else 0.0 for j in range(64)]) for k in range(6)]
    schema = "index_row long, video_id string, keyframe_id string, original_frame_id long, keyframe_path string, embedding array<float>"
    index = spark.createDataFrame(rows, schema)
    assert search.verified_index(index, index).count() == 0
    changed = spark.createDataFrame([*rows[:5], (*rows[5][:5], [2.0] + [0.0] * 63)], schema)
    found = {r.check: r.n for r in search.verified_index(index, changed).collect()}
    assert found["rows"] == 2 and found["invalid"] == 1 and found["self"] == 1
    hits = index.drop("embedding").withColumn("query_id", F.lit("q"))
    assert search.provenance_faults(hits, index).count() == 0
    assert search.provenance_faults(hits.withColumn("keyframe_path", F.lit("x")), index).count() == 6 and search.provenance_faults(hits, index.limit(0)).count() == 6
