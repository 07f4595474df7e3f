"""Problem 3 over ``object_records``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelspan.operators import nested
from reelspan.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.detection_paths(table(spark, sf_dir, "object_records")).withColumnRenamed("record", "object_id")


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.record_table(table(spark, sf_dir, "object_records")).withColumnRenamed("record", "object_id").drop("received")


def p3_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.detection_table(table(spark, sf_dir, "object_records")).withColumnRenamed("record", "object_id")


def p3_sub_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.sub_detection_table(table(spark, sf_dir, "object_records")).withColumnRenamed("record", "object_id")


QUERIES = {f.__name__: f for f in (p3_found, p3_records, p3_detections, p3_sub_detections)}

_TEXT = "CASE WHEN json_type({0}) IN ('NULL') OR {0} IS NULL THEN NULL WHEN regexp_matches({0} ->> '$', '\\S') THEN {0} ->> '$' END"
_NAMES = "coalesce(" + ", ".join(_TEXT.replace("{0}", f"json_extract(v, '$.{n}')") for n in nested.NAMES) + ")"
_LISTED = " UNION ALL ".join(
    f"SELECT object_id, prefix, json_extract({c}, '$[*]') AS l FROM containers WHERE json_type({c}) = 'ARRAY'" for c in ("c", *[f"json_extract(c, '$.{n}')" for n in nested.LISTS])
)
_KIDS = " UNION ALL ".join(f"SELECT object_id, det_path || '.' AS prefix, depth, json_extract(v, '$.{n}[*]') AS l FROM nodes WHERE json_type(v, '$.{n}') = 'ARRAY'" for n in nested.KIDS)
_NESTED = f"""
WITH RECURSIVE latest AS (
  SELECT object_id, payload, received_at FROM object_records WHERE object_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY received_at DESC NULLS LAST, payload DESC) = 1),
layers AS (
  SELECT object_id, regexp_replace(payload, '^\\s*\\x{{FEFF}}+', '') AS t, 0 AS n FROM latest
  UNION ALL SELECT object_id, CAST(t AS JSON) ->> '$', n + 1 FROM layers WHERE CASE WHEN json_valid(t) THEN json_type(t) = 'VARCHAR' ELSE false END),
roots AS (SELECT object_id, CAST(t AS JSON) AS j FROM (SELECT object_id, CASE WHEN json_valid(t) THEN t END AS t FROM layers) WHERE t IS NOT NULL AND json_type(t) <> 'VARCHAR'),
tops AS (SELECT object_id, j FROM roots UNION ALL SELECT object_id, json_extract(j, '$.data') FROM roots WHERE json_type(j, '$.data') IS NOT NULL),
containers AS (
  SELECT object_id, '' AS prefix, j AS c FROM tops
  UNION ALL SELECT object_id, i || '.', f FROM (SELECT object_id, unnest(json_extract(j, '$.frames[*]')) AS f, unnest(range(len(json_extract(j, '$.frames[*]')))) AS i FROM tops WHERE json_type(j, '$.frames') = 'ARRAY')),
listed AS ({_LISTED}),
named AS (
  SELECT object_id, prefix, unnest(json_extract(c, '$.detection_class_names[*]')) AS v, unnest(range(len(json_extract(c, '$.detection_class_names[*]')))) AS i FROM containers WHERE json_type(c, '$.detection_class_names') = 'ARRAY'),
nodes AS (
  SELECT object_id, prefix || i AS det_path, 0 AS depth, v FROM (SELECT object_id, prefix, unnest(l) AS v, unnest(range(len(l))) AS i FROM listed) WHERE {_NAMES} IS NOT NULL
  UNION ALL
  SELECT object_id, prefix || i, depth + 1, v FROM (SELECT object_id, prefix, depth, unnest(l) AS v, unnest(range(len(l))) AS i FROM ({_KIDS})) WHERE {_NAMES} IS NOT NULL),
found AS (
  SELECT object_id, det_path, depth FROM nodes
  UNION ALL SELECT object_id, prefix || i, 0 FROM named WHERE {_TEXT.replace("{0}", "v")} IS NOT NULL)
"""
ORACLE_SQL: dict[str, str] = {
    "p3_found": _NESTED + "SELECT DISTINCT object_id, det_path FROM found",
    "p3_records": _NESTED
    + """SELECT l.object_id, count(f.det_path) FILTER (f.depth = 0) AS n_detections, count(f.det_path) FILTER (f.depth > 0) AS n_sub_detections, bool_or(r.object_id IS NOT NULL) AS valid
FROM latest l LEFT JOIN (SELECT DISTINCT object_id FROM roots) r USING (object_id) LEFT JOIN found f USING (object_id) GROUP BY 1""",
}
