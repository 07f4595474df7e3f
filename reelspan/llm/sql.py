"""SQL that the queries of this package are checked against.

Queries without an entry are tested against brute force in ``tests/llm``.
"""

ORACLE_SQL: dict[str, str] = {}

_HITS = """
WITH items AS (
  SELECT video_id, query_id, index_row, max(score) AS score FROM search_hits
  WHERE video_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
  GROUP BY video_id, query_id, index_row),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, index_row, query_id) AS rank FROM items)
"""
ORACLE_SQL["p4_found"] = _HITS + "SELECT video_id, query_id, index_row FROM ranked WHERE rank <= 10"
ORACLE_SQL["p4_ranked_hits"] = _HITS + "SELECT video_id, query_id, index_row, score, rank FROM ranked WHERE rank <= 10"

_NEAREST = """
WITH usable AS (
  SELECT index_row, any_value(embedding::DOUBLE[]) AS e FROM index_vectors
  WHERE index_row IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
scored AS (SELECT a.index_row, b.index_row AS neighbour, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM usable a, usable b WHERE a.index_row <> b.index_row),
best AS (SELECT *, row_number() OVER (PARTITION BY index_row ORDER BY similarity DESC, neighbour) AS rank FROM scored WHERE similarity >= 0.85 QUALIFY rank <= 5)
"""
# all pairs; the query gives the same on one partition and nearly the same on many
ORACLE_SQL["p2_neighbours"] = _NEAREST + "SELECT * FROM best"
ORACLE_SQL["p2_found"] = _NEAREST + "SELECT DISTINCT least(index_row, neighbour) AS row_a, greatest(index_row, neighbour) AS row_b FROM best"

_S = ("retrieval_score", "support_score", "agreement_score", "joint_score")
_CLEAN = ", ".join(f"max(CASE WHEN isnan({s}) THEN NULL ELSE {s} END) AS {s}" for s in _S)
_PLACES = ", ".join(
    f"CASE WHEN {s} IS NOT NULL THEN rank() OVER (PARTITION BY query_id ORDER BY {s} DESC NULLS LAST) END AS p_{s}, "
    f"CASE WHEN {s} IS NOT NULL THEN rank() OVER (PARTITION BY query_id ORDER BY {s} DESC NULLS LAST) + (count({s}) OVER (PARTITION BY query_id, {s}) - 1) / 2.0 "
    f"ELSE (count(*) OVER (PARTITION BY query_id) + 1) / 2.0 END AS q_{s}"
    for s in _S
)
_BORDA = f"""
WITH items AS (
  SELECT query_id, hypothesis_id, {_CLEAN} FROM answer_hypotheses
  WHERE query_id IS NOT NULL AND hypothesis_id IS NOT NULL GROUP BY query_id, hypothesis_id),
places AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS m, {_PLACES} FROM items),
ranked AS (
  SELECT *, CAST({" + ".join(f"(m - q_{s})" for s in _S)} AS DOUBLE) AS points FROM places),
final AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, hypothesis_id) AS rank FROM ranked)
"""
ORACLE_SQL["p5_ranking"] = _BORDA + "SELECT query_id, hypothesis_id, points, rank FROM final"
ORACLE_SQL["p5_found"] = _BORDA + "SELECT query_id, hypothesis_id FROM final WHERE " + " AND ".join(f"p_{s} <= m // 10" for s in _S)
