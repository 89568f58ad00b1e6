"""The derived tables as DuckDB SQL, for the oracles."""

VIEWS = {
    "memories": """
  SELECT d.doc_id AS id, d.doc_id % 10 AS user_id, CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id % 7 END AS project_id, 'doc:' || d.doc_id AS memory_key,
    CASE d.doc_id % 4 WHEN 0 THEN 'semantic' WHEN 1 THEN 'episodic' WHEN 2 THEN 'procedural' ELSE 'working' END AS memory_type,
    CASE CAST(floor(d.doc_id / 4) AS BIGINT) % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'project' WHEN 2 THEN 'team' ELSE 'global' END AS scope,
    d.text AS content, sha256(d.text) AS content_hash,
    CASE WHEN d.doc_id % 10 = 9 THEN 'archived' WHEN d.doc_id % 10 = 8 THEN 'stale' ELSE 'active' END AS status,
    1 + d.doc_id % 4 AS authority_level, CAST(d.doc_id % 101 AS DOUBLE) / 100 AS confidence, CAST(d.doc_id * 7 % 101 AS DOUBLE) / 100 AS importance_score,
    CAST(0 AS DOUBLE) AS recency_score, TIMESTAMP '2023-10-01' + to_days(CAST(d.doc_id % 90 AS INTEGER)) AS created_at,
    TIMESTAMP '2023-12-30' + to_hours(CAST(d.doc_id * 37 % 720 AS INTEGER)) AS updated_at,
    CASE WHEN d.doc_id % 5 = 0 THEN TIMESTAMP '2024-01-15' + to_days(CAST(d.doc_id % 60 AS INTEGER)) END AS expires_at,
    CASE WHEN d.doc_id % 6 = 0 THEN TIMESTAMP '2024-01-20' + to_days(CAST(d.doc_id % 40 AS INTEGER)) END AS valid_to,
    1 AS version, CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)""",
    "queries": """
  SELECT vec_id AS query_id, vec_id % 10 AS user_id, CASE WHEN vec_id % 28 <> 21 THEN CAST(embedding AS DOUBLE[]) END AS query_embedding, 5 AS top_k
  FROM embeddings WHERE vec_id % 7 = 0""",
    "memory_writes": """
  SELECT user_id, 'k' || (CAST(props ->> '$.k' AS BIGINT) % 10) AS memory_key, event_id AS seq, event_type AS content, value / 100 AS importance_score, ts AS written_at
  FROM events""",
    "memory_links": """
  SELECT * FROM (
    SELECT doc_id AS source_id, (doc_id * 3 + 1) % (SELECT count(*) FROM documents) AS target_id,
      CASE doc_id % 5 WHEN 0 THEN 'supports' WHEN 1 THEN 'contradicts' WHEN 2 THEN 'supersedes' WHEN 3 THEN 'derived_from' ELSE 'related_to' END AS link_type FROM documents
    UNION ALL
    SELECT doc_id, (doc_id + 17) % (SELECT count(*) FROM documents),
      CASE (doc_id + 2) % 5 WHEN 0 THEN 'supports' WHEN 1 THEN 'contradicts' WHEN 2 THEN 'supersedes' WHEN 3 THEN 'derived_from' ELSE 'related_to' END FROM documents)
  WHERE source_id <> target_id""",
    "edges": """
  SELECT source_id AS node, target_id AS neighbour, link_type, 'outgoing' AS direction FROM memory_links
  UNION ALL SELECT target_id, source_id, link_type, 'incoming' FROM memory_links""",
    "access_log": """
  SELECT (CAST(props ->> '$.k' AS BIGINT) * 10 + user_id % 10) % (SELECT count(*) FROM documents) AS memory_id, user_id % 10 AS user_id,
    CASE WHEN event_type IN ('view', 'click') THEN 'retrieval' WHEN event_type = 'signup' THEN 'view' ELSE 'prompt_inclusion' END AS access_type, ts AS created_at
  FROM events""",
    "raw_events": """
  SELECT conv_id * 1000 + turn AS event_id, conv_id AS run_id, conv_id % 10 AS user_id,
    CASE role WHEN 'user' THEN 'user_input' WHEN 'assistant' THEN 'model_output' ELSE 'system_note' END AS event_type, text AS content, turn AS sequence_number
  FROM conversations""",
    "thread_messages": """
  SELECT conv_id AS thread_id, turn AS seq, role, text AS content FROM conversations""",
    "tasks": """
  SELECT DISTINCT user_id AS task_id, 'pending' AS state FROM events""",
    "task_requests": """
  SELECT user_id AS task_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'in_progress' WHEN 'click' THEN 'waiting_review' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
    ELSE CASE WHEN event_id % 2 = 0 THEN 'pending' ELSE 'cancelled' END END AS to_state
  FROM events""",
    "rules": """
  SELECT * FROM (VALUES ('pending','in_progress'), ('pending','cancelled'), ('in_progress','waiting_review'), ('in_progress','completed'), ('in_progress','failed'), ('in_progress','cancelled'),
    ('waiting_review','in_progress'), ('waiting_review','completed'), ('waiting_review','failed'), ('waiting_review','cancelled'), ('failed','pending'), ('cancelled','pending')) AS t(from_state, to_state)""",
    "webhooks": """
  SELECT c_custkey AS webhook_id, c_custkey % 10 AS user_id,
    CASE WHEN CAST(floor(c_custkey / 10) AS BIGINT) % 10 = 0 THEN '*' WHEN CAST(floor(c_custkey / 10) AS BIGINT) % 10 < 5 THEN 'memory.created' ELSE 'memory.updated, memory.archived' END AS events,
    c_custkey % 7 <> 0 AS is_active FROM customer""",
    "chain": """
  SELECT *, CASE WHEN prev IS NULL THEN 'created' WHEN prev = content THEN 'skip_identical' ELSE 'updated' END AS action,
    CAST(sum(CASE WHEN prev = content THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, memory_key ORDER BY seq) AS INTEGER) AS version
  FROM (SELECT *, lag(content) OVER (PARTITION BY user_id, memory_key ORDER BY seq) AS prev FROM memory_writes)""",
    "active_valid": """
  SELECT * FROM memories WHERE status = 'active' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-02-01') AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-02-01')""",
    "hybrid": """
  SELECT query_id, user_id, rank, id, round(score, 6) AS final_score, CASE WHEN query_embedding IS NULL THEN 'metadata_only' ELSE 'hybrid_vector' END AS strategy, candidates, matched, memory_key, content, v, rec, importance_score, auth, confidence
  FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS candidates, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
    FROM (SELECT *, CASE WHEN v IS NULL THEN (rec * 0.20 + importance_score * 0.15 + auth * 0.10 + confidence * 0.10) * (1.0 / 0.55) ELSE least(greatest(v, 0), 1) * 0.45 + rec * 0.20 + importance_score * 0.15 + auth * 0.10 + confidence * 0.10 END AS score
      FROM (SELECT *, exp(-ln(2) * greatest(epoch(TIMESTAMP '2024-02-01' - updated_at) / 3600, 0) / 72) AS rec, least(greatest(authority_level, 1), 4) / 4 AS auth,
          count(*) OVER (PARTITION BY query_id) AS matched,
          row_number() OVER (PARTITION BY query_id ORDER BY v DESC NULLS LAST, CASE WHEN query_embedding IS NULL THEN updated_at END DESC, id) AS n
        FROM (SELECT q.query_id, q.query_embedding, q.top_k, m.*, list_cosine_similarity(m.embedding, q.query_embedding) AS v FROM queries q JOIN active_valid m ON m.user_id = q.user_id))
      WHERE n <= 2 * top_k)) WHERE rank <= top_k""",
    "keepers": """
  SELECT user_id, content_hash, id, first_value(id) OVER w AS keep_id, count(*) OVER (PARTITION BY user_id, content_hash) AS n
  FROM memories WHERE status = 'active' WINDOW w AS (PARTITION BY user_id, content_hash ORDER BY authority_level DESC, importance_score DESC, created_at, id)""",
    "observations": """
  SELECT event_id, run_id, user_id, content, sequence_number, CASE WHEN event_type = 'user_input' THEN 'user_input' ELSE 'system_inference' END AS source_type,
    CAST(CASE WHEN event_type = 'user_input' THEN 0.8 ELSE 0.5 END AS DOUBLE) AS confidence
  FROM raw_events WHERE event_type IN ('user_input', 'tool_result', 'model_output') AND length(content) > 0""",
}
NEEDS = {"edges": ["memory_links"], "chain": ["memory_writes"], "active_valid": ["memories"], "hybrid": ["queries", "active_valid"], "keepers": ["memories"], "observations": ["raw_events"]}


def with_views(names: str, body: str, recursive: str = "") -> str:
    """SQL with the named views (space between) and those they need in front."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order] + ([recursive] if recursive else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body if parts else body
