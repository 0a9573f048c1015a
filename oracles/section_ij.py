"""Checking SQL of question answering and whole-run operators."""

from __future__ import annotations

from ledgerleaf import constants as K
from oracles import section_efgh
from oracles.base import cte, lit, query, strip, words
from oracles.section_bcd import amount
from queries import fixtures as X

SQL: dict[str, str] = {}

SQL["i1_question_checks"] = query(
    f"""SELECT query_id, CASE WHEN trim(workspace_id) = '' THEN 'missing_workspace_id' WHEN len(ids) = 0 THEN 'missing_scope'
    WHEN len(list_filter(ids, lambda x: trim(x) = '')) > 0 THEN 'blank_document_id' WHEN {strip('query')} = '' THEN 'missing_query'
    WHEN length({strip('query')}) > 1000 THEN 'query_too_long' END AS error,
    len(list_filter(ids, lambda x: trim(x) <> '')) AS usable_ids FROM faulty""",
    "faulty",
)
SQL["i2_question_vectors"] = query(
    f"SELECT {X.QUESTION_SQL['query_id']} AS query_id, 64 AS size, NULL::varchar AS embed_error FROM conversations WHERE role = 'user'"
)
cte("found", "SELECT * FROM hits_l2", "hits_l2")
_n = "chr(10)"
cte(
    "context",
    f"""SELECT query_id, string_agg(concat('--- BEGIN SOURCE EXCERPT #', rank, ' ---', {_n}, 'Document ID: ', document_id, {_n}, 'Document Type: ', document_type, {_n},
    'Content:', {_n}, {strip('text_content')}, {_n}, '--- END SOURCE EXCERPT #', rank, ' ---'), {_n} || {_n} ORDER BY rank) AS context,
    string_agg(chunk_id, ',' ORDER BY rank) AS sources, count(*) AS n, min_by({strip('text_content')}, rank) AS top FROM found GROUP BY query_id""",
    "found",
)
SQL["i3_context"] = query("SELECT query_id, context FROM context", "context")
SQL["i4_prompt"] = query(
    f"""SELECT query_id, concat('RETRIEVED DOCUMENT CONTEXT:', {_n}, context, {_n}, {_n}, 'USER QUESTION:', {_n}, {strip('query')}) AS prompt
    FROM req JOIN context USING (query_id)""",
    "req", "context",
)
SQL["i5_no_hit_answer"] = query(
    f"SELECT query_id, {lit(K.NO_HIT_ANSWER)} AS answer FROM req WHERE query_id % 2000 >= 1000 OR query_id NOT IN (SELECT query_id FROM context)", "req", "context"
)
SQL["i6_generated_answers"] = query(
    f"""SELECT query_id, CASE WHEN n IS NULL THEN {lit(K.NO_HIT_ANSWER)} WHEN top <> '' THEN top END AS answer,
    CASE WHEN top = '' THEN 'empty_answer' END AS answer_error FROM req LEFT JOIN context USING (query_id)""",
    "req", "context",
)
SQL["i7_source_rows"] = query(
    """SELECT query_id, rank, chunk_id, document_id, workspace_id, chunk_index, document_type, text_content AS snippet, round(distance, 6) AS distance FROM found""",
    "found",
)
SQL["i8_answer_rows"] = query(
    f"""SELECT query_id, {strip('query')} AS query, coalesce(sources, '') AS sources, coalesce(n, 0) AS total_sources_retrieved FROM req LEFT JOIN context USING (query_id)""",
    "req", "context",
)
SQL["i9_scoped_totals"] = query(
    f"""SELECT o_custkey AS query_id, 'ws-' || lpad((o_custkey % 20)::varchar, 2, '0') AS workspace_id,
    coalesce(sum(a::decimal(18,2)), 0)::double AS total, count(a) AS documents_with_total, count(*) AS documents_selected
    FROM orders LEFT JOIN (SELECT key, {amount('grand_total')} AS a FROM ext) ON key = o_orderkey WHERE o_orderkey % 3 <> 1 GROUP BY o_custkey""",
    "ext",
)
cte(
    "run",
    f"""SELECT CASE WHEN key % 37 = 11 THEN '' ELSE document_id END AS document_id, key, CASE WHEN key % 37 = 7 THEN '' ELSE workspace_id END AS ws,
    CASE WHEN key % 37 IN (3, 7) THEN 'upload_document' WHEN key % 37 = 5 THEN 'parse_document' WHEN NOT is_valid THEN 'validate_document'
      WHEN key % 37 = 11 THEN {lit(K.STAGES[5])} WHEN key % 37 = 13 THEN {lit(K.STAGES[6])} WHEN key % 37 = 17 THEN {lit(K.STAGES[7])} END AS stage,
    CASE WHEN key % 37 = 3 THEN 'Uploaded file is empty.' WHEN key % 37 = 5 THEN 'corrupted_csv' WHEN NOT is_valid THEN NULL WHEN key % 37 = 11 THEN 'missing_document_id'
      WHEN key % 37 = 13 THEN 'dimension_mismatch: expected {X.SMALL}, got 3' WHEN key % 37 = 17 THEN 'duplicate_chunk_id' END AS why
    FROM ext JOIN gjudged_status USING (document_id), range(2) AS copies(c) WHERE c = 0 OR key % 37 = 17""",
    "ext", "gjudged_status",
)
SQL["j1_staged_halt"] = query("SELECT document_id, CASE WHEN ws <> '' THEN stage END AS failed_stage, stage IS NULL AS success FROM run", "run")
SQL["j1_stored_documents"] = query(
    """SELECT run.ws AS workspace_id, document_id, count(*) AS stored_count FROM run JOIN valid_chunks USING (document_id) WHERE stage IS NULL GROUP BY ALL""",
    "run", "valid_chunks",
)
SQL["j2_stage_audit"] = query(
    f"""SELECT document_id, n AS stage_no, tool AS tool_name, NOT (tool = coalesce(stage, '') AND stage <> 'validate_document') AS success,
    CASE WHEN tool = stage AND stage <> 'validate_document' THEN why END AS error
    FROM run, (SELECT unnest({words(K.STAGES)}) AS tool, generate_subscripts({words(K.STAGES)}, 1) AS n)
    WHERE ws <> '' AND n <= coalesce(list_position({words(K.STAGES)}, stage), 8)""",
    "run",
)
SQL["j2_step_counts"] = query(
    f"""SELECT 'reviewed' AS step, 'rows' AS counter, count(*) AS value FROM run
    UNION ALL SELECT 'reviewed', tool, count(run.document_id) FROM (SELECT unnest({words((K.STAGES[0], K.STAGES[1], K.STAGES[4], K.STAGES[5]))}) AS tool) LEFT JOIN run ON stage = tool GROUP BY tool
    UNION ALL SELECT 'embedded', counter, value FROM (
      SELECT count(*) AS "rows", count(*) FILTER (WHERE try_cast(regexp_extract(piece, 'Document ID: doc-([0-9]+)', 1) AS bigint) % 37 = 13) AS {K.STAGES[6]}
      FROM run JOIN valid_chunks USING (document_id) WHERE stage IS NULL OR stage IN ({lit(K.STAGES[6])}, {lit(K.STAGES[7])})
    ) UNPIVOT (value FOR counter IN ("rows", {K.STAGES[6]}))""",
    "run", "valid_chunks",
)
SQL["j3_result_rows"] = query(
    """SELECT stage IS NULL AS success, 'DOCUMENT_INGESTION' AS mode, CASE WHEN ws = '' THEN 'UNKNOWN' ELSE ws END AS workspace_id, document_id,
    CASE WHEN ws <> '' THEN stage END AS failed_stage,
    CASE WHEN ws = '' THEN 'Mandatory field ''workspace_id'' cannot be empty.' WHEN stage = 'validate_document'
      THEN 'Document validation failed due to business constraint violations.'
      WHEN stage IS NOT NULL THEN concat('Pipeline stopped at stage ''', stage, ''': ', why) END AS error_message FROM run""",
    "run",
)
SQL["j1_resumed_run"] = SQL["j3_result_rows"]
SQL["j3_question_results"] = query(
    f"""SELECT query_id, why IS NULL AS success, 'QUERY' AS mode, CASE WHEN blank THEN 'UNKNOWN' ELSE workspace_id END AS workspace_id,
    CASE WHEN why IS NOT NULL AND NOT blank THEN 'query_documents' END AS failed_stage,
    CASE WHEN blank THEN 'Mandatory field ''workspace_id'' cannot be empty.' ELSE why END AS error_message FROM (
    SELECT query_id, trim(workspace_id) AS workspace_id, trim(workspace_id) = '' AS blank,
    CASE WHEN trim(workspace_id) = '' THEN 'missing_workspace_id' WHEN len(ids) = 0 THEN 'missing_scope'
    WHEN conv_id % 13 = 3 THEN 'blank_document_id' WHEN {strip('query')} = '' THEN 'missing_query'
    WHEN length({strip('query')}) > 1000 THEN 'query_too_long' WHEN top_k < 1 THEN 'top_k_too_small' WHEN top_k > 50 THEN 'top_k_too_large' END AS why
    FROM faulty)""",
    "faulty",
)
_line = "concat(CASE WHEN k % 7 = 3 THEN 'INVOICE' ELSE 'RECEIPT' END, ' of order ', o_orderkey, ' for customer ', o_custkey)"
cte(
    "arrived",
    f"""SELECT k AS document_id, concat('=== DOCUMENT SUMMARY ===', {_n}, 'Document Type: Receipt', {_n}, 'Document ID: {'x' * 36}', {_n}, 'Validation Status: Valid', {_n}, {_n},
    '=== DOCUMENT TOTALS & CURRENCY ===', {_n}, 'Currency: INR', {_n}, {_n}, '=== EXTRACTED PAGE TEXT ===', {_n}, '[Page 1]', {_n}, string_agg({_line}, {_n} ORDER BY o_orderkey)) AS t
    FROM (SELECT o_custkey // 10 AS k, o_orderkey, o_custkey FROM orders) WHERE k % 7 <> 3 GROUP BY k""",
)
section_efgh.chunked("arrived_chunks", "arrived")
SQL["j4_arriving_vectors"] = query("SELECT 'Receipt' AS document_type, idx AS chunk_index, regexp_replace(piece, 'x+\\nValidation', 'x' || chr(10) || 'Validation') AS text_content FROM arrived_chunks", "arrived_chunks")
SQL["j5_latency_summary"] = """
SELECT event_type AS stage, count(*) AS runs, round(avg(value), 6) AS avg_ms, max(value) AS max_ms,
quantile_disc(value, 0.5) AS p50_ms, quantile_disc(value, 0.95) AS p95_ms FROM events GROUP BY event_type
"""
SQL["j6_workspace_isolation"] = query(
    """SELECT query_id, least(top_k, (SELECT count(*) FROM embeddings WHERE vec_id % 3 = (query_id // 1000) % 2)) AS hits, (query_id // 1000) % 2 AS side, 0 AS "foreign" FROM req""",
    "req",
)
