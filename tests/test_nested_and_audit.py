import json

from reelspan.operators import audit, nested, objects

SCHEMA = "object_id long, payload string, received_at timestamp, det_path string, root int"


def table(spark, payloads):
    return spark.createDataFrame([(k, p, None, "clash", 1) for k, p in enumerate(payloads)], SCHEMA)


def test_layouts_and_faults(spark):
    payloads = [
        json.dumps({"detection_class_names": ["a", None, " ", "b"], "detection_scores": ["0.5"], "detection_boxes": []}),
        json.dumps([{"label": "x", "parts": [{"name": "y", "children": [{"class_id": 3, "parts": [{"name": "deep", "parts": [{"name": "deeper", "parts": [{"name": "deepest"}]}]}]}]}]}, {"label": ""}, 7]),
        "﻿" + json.dumps(json.dumps({"frames": [{"results": [{"class_name": "z", "bbox": {"xmin": 1, "ymin": "2", "xmax": 3, "ymax": 4}}]}, [{"name": "w", "box": [[0, 0], [2, 0], [2, 5], [0, 5]]}]]})),
        json.dumps({"data": {"objects": [{"category": "k"}]}, "other": [{"label": "no"}]}),
        "{\"objects\": [{\"label\": \"cut\"",
        "{\"objects\": []} tail",
        None,
        "",
        "3",
    ]
    found = {(r.record, r.det_path) for r in nested.detection_paths(table(spark, payloads)).collect()}
    assert found == {(0, "0"), (0, "3"), (1, "0"), (1, "0.0"), (1, "0.0.0"), (1, "0.0.0.0"), (1, "0.0.0.0.0"), (1, "0.0.0.0.0.0"), (2, "0.0"), (2, "1.0"), (3, "0")}
    rows = {(r.record, r.det_path): r for r in nested.detection_table(table(spark, payloads)).collect()}
    assert rows[(0, "0")].score == 0.5 and rows[(0, "3")].score is None
    assert (rows[(2, "0.0")].xmin, rows[(2, "0.0")].ymax) == (1.0, 4.0) and (rows[(2, "1.0")].xmax, rows[(2, "1.0")].ymax) == (2.0, 5.0)
    subs = {(r.det_path, r.parent_path) for r in nested.sub_detection_table(table(spark, payloads)).collect()}
    assert ("0.0.0", "0.0") in subs
    assert [r.valid for r in nested.record_table(table(spark, payloads)).orderBy("record").collect()] == [True] * 4 + [False] * 4 + [True]
    assert nested.detection_paths(table(spark, [])).count() == 0


def test_latest_record_counts(spark):
    df = spark.sql("select 1L object_id, '[{\"name\":\"a\"}]' payload, timestamp '2020-01-01' received_at union all select 1L, '[]', timestamp '2021-01-01' union all select null, '[{\"name\":\"a\"}]', null")
    assert nested.detection_paths(df).count() == 0


def test_json_in_strings_is_unwrapped_however_often(spark):
    payloads = []
    for times in range(9):
        text = json.dumps([{"label": f"w\\\\{times}", "parts": [{"name": "p"}]}])
        for _ in range(times):
            text = json.dumps(text)
        payloads.append(text)
    coded = json.dumps([{"label": "u"}])
    for _ in range(4):
        coded = '"' + coded.replace("\\", "\\u005c").replace('"', "\\u0022") + '"'
    payloads += [coded, json.dumps("[3]"), json.dumps(json.dumps(json.dumps("text"))), '"cut']
    found = {(r.record, r.det_path) for r in nested.detection_paths(table(spark, payloads)).collect()}
    assert found == {(k, path) for k in range(9) for path in ("0", "0.0")} | {(9, "0")}
    assert nested.detection_paths(table(spark, payloads[:1] * 3)).count() == 6


def test_the_latest_row_of_a_record_and_repeated_rows(spark):
    one, two = json.dumps([{"label": "a"}]), json.dumps([{"label": "b"}, {"label": "c"}])
    rows = [(1, one, "2020-01-01"), (1, two, "2021-01-01"), (1, two, "2021-01-01"), (1, one, None), (2, one, None), (2, two, None), (3, None, "2022-01-01"), (3, one, "2021-01-01")]
    df = spark.createDataFrame(rows, "object_id long, payload string, at string").selectExpr("object_id", "payload", "to_timestamp(at) as received_at")
    counts = {r.record: (r.n_detections, r.valid) for r in nested.record_table(df).collect()}
    assert counts[1] == (2, True) and counts[2] in ((1, True), (2, True)) and counts[3] == (0, False)
    assert nested.sub_detection_table(df).count() == 0


def test_object_warnings_and_detections(spark):
    good = {"detection_scores": ["0.9"], "detection_class_names": ["Car"], "detection_class_entities": ["car "], "detection_boxes": [[0, 0, 1, "1"]], "detection_class_labels": [3]}
    payloads = [json.dumps(good), json.dumps({**good, "detection_scores": [1.5], "detection_class_labels": [None]}), json.dumps([{"confidence": 0.8, "category": " Big  Bus "}, {"label": "dog"}, {}]), json.dumps([3]), json.dumps({"a": 1}), "3", "x", json.dumps({"detection_scores": []})]
    warned = {}
    for r in objects.schema_warnings(table(spark, payloads)).collect():
        warned.setdefault(r.record, []).append((r.place, r.warning))
    assert set(warned) == {1, 3, 4, 5, 6, 7}
    assert warned[1] == [(0, "invalid score"), (0, "invalid class label")] and warned[3] == [(0, "no object")] and warned[4] == [(None, "unknown layout")]
    found = {(r.record, r.place): (r.score, r.labels) for r in objects.plain_detections(table(spark, payloads)).collect()}
    assert found == {(0, 0): (0.9, ["car", "3"]), (2, 0): (0.8, ["big bus"]), (2, 1): (1.0, ["dog"])}


def test_manifest_issues(spark):
    videos = spark.createDataFrame([("v", 25.0, 250, 10.0, "b", "m"), ("v", 25.0, 250, 10.0, "b", "m"), ("w", 25.0, 250, 20.0, None, None), ("n", None, 5, 1.0, "b", "m")], "video_id string, fps double, frame_count long, duration double, batch_id string, metadata_path string")
    keyframes = spark.createDataFrame([("v", "1", 0, 25, 0, "o"), ("v", "2", 1, 25, 1, None), ("x", "1", 0, 1, None, "o"), ("w", "1", 0, 300, 0, "o")], "video_id string, keyframe_id string, keyframe_ordinal long, original_frame_id long, clip_row long, object_path string")
    found = {(r.code, r.entity) for r in audit.manifest_issues(videos, keyframes).collect()}
    assert {("duplicate-video", "v"), ("orphan-keyframe", "x/1"), ("keyframe-missing", "n"), ("frame-out-of-range", "w/1"), ("frame-not-increasing", "v/2"), ("duration-mismatch", "w"), ("rate-missing", "n"), ("object-missing", "v/2")} <= found


def test_mapping_forms(spark):
    from pyspark.sql import functions as F

    mapping = spark.createDataFrame([("v", "001"), ("v", "7"), ("v", "x")], "video_id string, key string")
    files = spark.createDataFrame([("v", "1"), ("v", "007"), ("v", "0007")], "video_id string, stem string")
    assert {r.key: r.stem for r in audit.matching_keyframes(mapping, files).collect()} == {"001": "1", "7": "007", "x": None}
    row = spark.range(1).select(audit.mapped_frame(F.lit(1), F.lit(0.1), F.lit(25.0), "time").alias("f"), audit.candidate_frames(F.lit(0), F.lit(0.1), F.lit(25.0)).alias("c")).first()
    assert row.f == 2 and ("csv-1", -1) not in [tuple(x) for x in row.c] and len(row.c) == 5
    errors = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (2, "a", 1.0), (2, "b", 3.0)], "sample int, label string, error double")
    assert {r.label: r.wins for r in audit.best_mapping(errors).collect()} == {"a": 2, "b": 1}
