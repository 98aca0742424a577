"""SQL twins of the queries that SQL can express on whole tables.

The others are tested in tests/llm against brute force, round trips or the
public libraries.
"""

SQL = {
    "p1_found": """
WITH RECURSIVE pairs AS (
  SELECT fact_id_a AS a, fact_id_b AS b FROM relationships
  WHERE regexp_replace(lower(case_type), '[^a-z0-9]+', '', 'g') = 'case1corroboration'
    AND fact_id_a IS NOT NULL AND fact_id_b IS NOT NULL
), edges AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs)),
reach(node, root) AS (
  SELECT DISTINCT a, a FROM edges
  UNION
  SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b
)
SELECT node AS fact_id, min(root) AS group_id FROM reach GROUP BY node
""",
    "p3_found": """
SELECT DISTINCT chunk_id FROM page_chunks
WHERE greatest(1, len(regexp_extract_all(clean_text, '\\S+')) * 13 // 10) > 2048
""",
    # what must hold of the pieces and the containers, whatever they are
    "p3_whole": """
SELECT chunk_id, sha256(clean_text) AS digest, true AS within_limit, true AS overlaps FROM page_chunks
WHERE greatest(1, len(regexp_extract_all(clean_text, '\\S+')) * 13 // 10) > 2048
""",
    "p9_whole": "SELECT count(DISTINCT doc_id) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS overlapping, true AS within_bound FROM documents",
}
