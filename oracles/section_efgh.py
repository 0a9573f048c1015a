"""Checking SQL of rendering, chunking, embedding, vector table and retrieval."""

from __future__ import annotations

from oracles import section_bcd  # noqa: F401 - defines the extraction CTEs
from oracles.base import cte, query, strip
from oracles.section_a import uuid5
from queries import fixtures as X
from queries import section_efgh as Q

SQL: dict[str, str] = {}

# --- E ------------------------------------------------------------------------------
_nl = "chr(10)"


def _section(title: str, fields: tuple[tuple[str, str], ...], always: str = "") -> str:
    """Title plus labelled lines; null if all fields are empty."""
    lines = ", ".join(f"CASE WHEN {c} <> '' THEN '{label}: ' || {c} END" for label, c in fields)
    body = f"concat_ws({_nl}, {lines}{', ' + always if always else ''})"
    return f"CASE WHEN {body} <> '' THEN '=== {title} ===' || {_nl} || {body} END"


cte(
    "item_lines",
    f"""SELECT document_id, string_agg(concat('Item #', item_number, ': ', CASE WHEN coalesce(description, '') = '' THEN 'N/A' ELSE description END,
    CASE WHEN quantity <> '' THEN ' | Qty: ' || quantity END, CASE WHEN unit_price <> '' THEN ' | Rate: ' || unit_price END,
    CASE WHEN amount <> '' THEN ' | Amount: ' || amount END), {_nl} ORDER BY item_number) AS t FROM items GROUP BY document_id""",
    "items",
)
cte(
    "rendered",
    f"""SELECT e.document_id, e.workspace_id, e.document_type, is_valid, concat_ws({_nl} || {_nl},
    concat('=== DOCUMENT SUMMARY ===', {_nl}, 'Document Type: ', e.document_type, {_nl}, 'Document ID: ', e.document_id, {_nl},
      'Validation Status: ', CASE WHEN is_valid THEN 'Valid' ELSE 'Invalid/Has Warnings' END),
    {_section('HEADER & IDENTIFIERS', (('Number', 'document_number'), ('Date', 'document_date'), ('Due Date', 'due_date')))},
    {_section('SELLER / VENDOR DETAILS', (('GSTIN', 'seller_gstin'), ('PAN', 'seller_pan')))},
    {_section('BUYER / CUSTOMER DETAILS', (('GSTIN', 'buyer_gstin'), ('PAN', 'buyer_pan')))},
    '=== LINE ITEMS & SERVICES ===' || {_nl} || i.t,
    {_section('TAXES & BREAKDOWN', (('CGST', 'cgst'), ('SGST', 'sgst'), ('IGST', 'igst'), ('Total Tax', 'total_tax')))},
    {_section('DOCUMENT TOTALS & CURRENCY', (('Subtotal', 'subtotal'), ('Total Tax', 'tax_amount'), ('Grand Total', 'grand_total')), "'Currency: INR'")},
    '=== EXTRACTED PAGE TEXT ===' || {_nl} || array_to_string(list_transform(pages, lambda pg: concat('[Page ', pg.page_number, ']', {_nl}, {strip('pg.text')})), {_nl})
    ) AS semantic_text
    FROM ext e JOIN gjudged_status USING (document_id) LEFT JOIN item_lines i USING (document_id)""",
    "ext", "gjudged_status", "item_lines",
)
SQL["e1_semantic_text"] = query("SELECT document_id, semantic_text FROM rendered", "rendered")


def chunked(name: str, source: str) -> None:
    """CTE <name>(document_id, idx, piece) over <source>(document_id, t); t is stripped."""
    window = "substr(t, s + 1, 1000)"
    # ASCII without carriage returns: reverse() then works character by character.
    plain = rf"reverse(replace(regexp_replace({window}, '[^\x00-\x7F]', 'x', 'g'), chr(13), 'x'))"

    def at(mark: str, size: int) -> str:
        hit = f"instr(rw, {mark})"
        return f"CASE WHEN {hit} > 0 AND 1001 - {hit} - {size} >= 100 THEN 1001 - {hit} - {size} END"

    step = f"""SELECT document_id, idx, s, n, CASE WHEN s + 1000 >= n THEN n ELSE s + coalesce({at('chr(10) || chr(10)', 2)}, {at('chr(10)', 1)}, {at("' '", 1)}, 1000) END AS cut
      FROM (SELECT *, {plain} AS rw FROM {{rows}})"""
    first = f"(SELECT document_id, t, 0 AS idx, 0 AS s, length(t) AS n FROM {source} WHERE t <> '')"
    following = (
        f"(SELECT w.document_id, x.t, w.idx + 1 AS idx, greatest(w.s + 1, w.cut - 150) AS s, w.n AS n "
        f"FROM {name}_walk w JOIN {source} x USING (document_id) WHERE w.s + 1000 < w.n)"
    )
    cte(
        f"{name}_walk",
        step.format(rows=first) + " UNION ALL " + step.format(rows=following),
        source,
    )
    cte(
        name,
        f"""SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY idx) - 1 AS idx, piece FROM (
        SELECT w.document_id, w.idx, {strip('substr(t, s + 1, cut - s)')} AS piece FROM {name}_walk w JOIN {source} x USING (document_id)) WHERE piece <> ''""",
        f"{name}_walk", source,
    )


cte("prose", f"SELECT doc_id::varchar AS document_id, {strip('text')} AS t FROM documents")
chunked("prose_chunks", "prose")
cte("valid_text", f"SELECT document_id, {strip('semantic_text')} AS t FROM rendered WHERE is_valid", "rendered")
chunked("valid_chunks", "valid_text")
cte("all_text", f"SELECT document_id, {strip('semantic_text')} AS t FROM rendered", "rendered")
chunked("all_chunks", "all_text")
SQL["e2_overlapping_chunks"] = query(
    "SELECT document_id, idx AS chunk_index, piece AS text_content FROM prose_chunks", "prose_chunks"
)
SQL["e3_chunk_ids"] = query(
    f"SELECT document_id, idx AS chunk_index, {uuid5(chr(34) + 'name' + chr(34))} AS chunk_id FROM (SELECT *, concat(document_id, '_chunk_', idx) AS name FROM prose_chunks)",
    "prose_chunks",
)
SQL["e4_chunk_rows"] = query(
    f"""SELECT {uuid5('name')} AS chunk_id, workspace_id, document_id, document_type, chunk_index, total_chunks, is_valid FROM (
    SELECT document_id, workspace_id, document_type, is_valid, idx AS chunk_index, concat(document_id, '_chunk_', idx) AS name,
    count(*) OVER (PARTITION BY document_id) AS total_chunks FROM valid_chunks JOIN rendered USING (document_id))""",
    "valid_chunks", "rendered",
)
SQL["e5_chunk_stats"] = query(
    """SELECT workspace_id, document_id, document_type, coalesce(n, 0) AS total_chunks, length(semantic_text) AS total_characters
    FROM rendered LEFT JOIN (SELECT document_id, count(*) AS n FROM all_chunks GROUP BY ALL) USING (document_id)""",
    "rendered", "all_chunks",
)
SQL["e6_input_checks"] = """
SELECT c_custkey, CASE WHEN c_custkey % 5 IN (1, 2) THEN 'missing_document_id' WHEN c_custkey % 4 IN (1, 2) THEN 'missing_workspace_id' END AS error
FROM customer
"""

# --- F ---------------------------------------------------------------------------------
SQL["f1_truncated_text"] = f"SELECT doc_id, left({strip('text')}, 8000) AS cut FROM documents"
SQL["f2_embeddings"] = """
SELECT doc_id::varchar AS document_id, 'hashing' AS embedding_model, 64 AS size, 0.0::double AS self_distance, NULL::varchar AS embed_error FROM documents
"""
SQL["f3_count_check"] = f"""
SELECT doc_id::varchar AS document_id, CASE WHEN lost THEN 'count_mismatch' END AS error, lost
FROM (SELECT doc_id, starts_with({strip('text')}, 'Is ') AS lost FROM documents)
"""
SQL["f4_dimension_check"] = f"""
SELECT vec_id, CASE WHEN n = 0 THEN 'empty_vector' WHEN n <> 64 THEN concat('dimension_mismatch: expected 64, got ', n) END AS error
FROM (SELECT vec_id, len(embedding[1:{Q.VECTOR_SIZE}]) AS n FROM embeddings)
"""
_v = ", ".join(f"{s} AS {n}" for n, s in X.VECTOR_SQL.items())
cte("vecs", f"SELECT vec_id, label, embedding, {_v} FROM embeddings")
SQL["f5_document_metadata"] = query(
    """SELECT workspace_id, document_id, 'given' AS embedding_model, count(*) FILTER (WHERE vec_id % 251 <> 3) AS total_chunks_processed,
    64 AS vector_dimensions, CASE WHEN count(*) FILTER (WHERE vec_id % 251 = 3) > 0 THEN 'empty_vector' END AS error FROM vecs GROUP BY workspace_id, document_id
    UNION ALL SELECT 'ws-' || n_nationkey % 2, 'label-' || n_nationkey, NULL, 0, 0, 'no_chunks' FROM nation
    WHERE 'label-' || n_nationkey NOT IN (SELECT document_id FROM vecs)""",
    "vecs",
)

# --- G -------------------------------------------------------------------------------------
_p = ", ".join(f"{s} AS {n}" for n, s in Q.PAYLOAD_SQL.items())
SQL["g1_payload_checks"] = f"""
WITH r AS (SELECT vec_id, {_p} FROM embeddings),
q AS (SELECT *, trim(chunk_id) AS cid, row_number() OVER (PARTITION BY workspace_id, document_id, trim(chunk_id) ORDER BY chunk_index) AS seen FROM r),
f AS (SELECT *, CASE WHEN cid = '' THEN 'missing_chunk_id' WHEN seen > 1 THEN 'duplicate_chunk_id' WHEN vector_size = 0 THEN 'empty_vector'
      WHEN vector_size <> 64 THEN 'dimension_mismatch' END AS bad FROM q),
d AS (SELECT workspace_id, document_id, bool_or(document_type IS NULL) AS no_type, min_by(bad, chunk_index) FILTER (WHERE bad IS NOT NULL) AS bad,
      min(chunk_index) FILTER (WHERE bad IS NOT NULL) AS pos FROM f GROUP BY workspace_id, document_id)
SELECT workspace_id, document_id, CASE WHEN trim(workspace_id) = '' THEN 'missing_workspace_id' WHEN trim(document_id) = '' THEN 'missing_document_id'
  WHEN no_type THEN 'missing_document_type' ELSE bad END AS reason,
  CASE WHEN trim(workspace_id) <> '' AND trim(document_id) <> '' AND NOT no_type THEN pos ELSE -1 END AS position
FROM d WHERE trim(workspace_id) = '' OR trim(document_id) = '' OR no_type OR bad IS NOT NULL
UNION ALL SELECT 'ws-x', n_name, 'no_vectors', -1 FROM nation
"""
cte("stored", "SELECT *, concat(workspace_id, ':', document_id, ':', chunk_id) AS record_id FROM vecs", "vecs")
SQL["g2_record_ids"] = query("SELECT vec_id, record_id FROM stored", "stored")
SQL["g3_upsert"] = query(
    """SELECT record_id, workspace_id, CASE WHEN vec_id % 3 = 1 THEN 'old ' || chunk_id ELSE concat('new ', chunk_id, ' v', 1 + vec_id % 2) END AS text_content FROM stored""",
    "stored",
)
SQL["g3_stored_upsert"] = SQL["g3_upsert"]
SQL["g4_stored_rows"] = query(
    """SELECT record_id, workspace_id, document_id, document_type, chunk_id, chunk_index, 'given' AS embedding_model, 64 AS vector_dimensions,
    text_content, len(embedding) AS size, round(list_sum(embedding::double[]), 6) AS vector_sum FROM stored""",
    "stored",
)
SQL["g5_document_counts"] = query("SELECT workspace_id, document_id, count(*) AS stored_count FROM stored GROUP BY ALL", "stored")
SQL["g5_document_records"] = query("SELECT workspace_id, document_id, record_id FROM stored", "stored")
SQL["g5_upsert_summary"] = query(
    """SELECT workspace_id, d AS document_id, count(*) AS stored_count, string_agg(r, ',' ORDER BY r) AS record_ids FROM (
    SELECT workspace_id, d, concat(workspace_id, ':', d, ':', chunk_id) AS r FROM (SELECT *, concat(document_id, '-', vec_id // 200) AS d FROM vecs)) GROUP BY ALL""",
    "vecs",
)

# --- H -----------------------------------------------------------------------------------------
_q = ", ".join(f"{s} AS {n}" for n, s in X.QUESTION_SQL.items())
cte("asked", f"SELECT conv_id, turn, text AS query, {_q} FROM conversations WHERE role = 'user'")
_f = ", ".join(f"{s} AS {n}" for n, s in X.FAULTY_SQL.items())
cte(
    "faulty",
    f"""SELECT * REPLACE ({_f}), CASE WHEN conv_id % 13 = 2 THEN [] WHEN conv_id % 13 = 3 THEN ['label-1', ' '] ELSE [first_doc, second_doc || ' '] END AS ids FROM asked""",
    "asked",
)
SQL["h1_request_checks"] = query(
    """SELECT query_id, CASE WHEN trim(workspace_id) = '' THEN 'missing_workspace_id' WHEN len(ids) = 0 THEN 'missing_scope'
    WHEN len(list_filter(ids, lambda x: trim(x) = '')) > 0 THEN 'blank_document_id'
    WHEN e.embedding IS NULL OR conv_id % 13 = 9 THEN 'missing_vector' WHEN conv_id % 13 = 8 THEN 'dimension_mismatch'
    WHEN top_k < 1 THEN 'top_k_too_small' WHEN top_k > 50 THEN 'top_k_too_large' END AS error
    FROM faulty CROSS JOIN (SELECT max(vec_id) + 1 AS n FROM embeddings) LEFT JOIN embeddings e ON e.vec_id = (conv_id * 31 + turn) % n""",
    "faulty",
)
cte(
    "req",
    """SELECT a.*, trim(workspace_id) AS ws, e.embedding AS qv FROM asked a, (SELECT max(vec_id) + 1 AS n FROM embeddings), embeddings e
    WHERE e.vec_id = (conv_id * 31 + turn) % n""",
    "asked",
)
cte(
    "scope",
    "SELECT query_id, ws, first_doc AS doc FROM req UNION SELECT query_id, ws, second_doc FROM req",
    "req",
)
SQL["h2_scope_filter"] = query(
    """SELECT query_id, workspace_id, document_id, count(*) AS candidates FROM scope JOIN vecs ON workspace_id = ws AND document_id = doc GROUP BY ALL""",
    "scope", "vecs",
)
_zip = "list_zip(s.embedding::double[], r.qv::double[])"
_DISTANCES = {
    "l2": f"list_sum(list_transform({_zip}, lambda z: (z[1] - z[2]) * (z[1] - z[2])))",
    "cos": "1 - list_cosine_similarity(s.embedding::double[], r.qv::double[])",
}
for _name, _d in _DISTANCES.items():
    cte(
        f"hits_{_name}",
        f"""SELECT *, count(*) OVER (PARTITION BY query_id) AS total_results FROM (
        SELECT r.query_id, r.query, r.top_k, s.vec_id, s.record_id, s.chunk_id, s.document_id, s.workspace_id, s.chunk_index, s.document_type,
        coalesce(s.text_content, '') AS text_content, {_d} AS distance,
        row_number() OVER (PARTITION BY r.query_id ORDER BY {_d}, s.record_id) AS rank
        FROM scope c JOIN req r USING (query_id) JOIN stored s ON s.workspace_id = c.ws AND s.document_id = c.doc) WHERE rank <= top_k""",
        "scope", "req", "stored",
    )
_hit = "SELECT query_id, rank, round(distance, 6) AS distance, record_id FROM"
SQL["h3_exact_top_k"] = query(f"{_hit} hits_l2", "hits_l2")
SQL["h3_exact_top_k_join_plan"] = SQL["h3_exact_top_k"]
SQL["h3_exact_top_k_cosine"] = query(f"{_hit} hits_cos", "hits_cos")
SQL["h5_hit_integrity"] = query(
    """SELECT query_id, count(*) AS hits, count(error) AS unsafe_hits, min_by(error, rank) FILTER (WHERE error IS NOT NULL) AS error FROM (
    SELECT query_id, rank, CASE vec_id % 41 WHEN 3 THEN 'missing_metadata' WHEN 5 THEN 'invalid_metadata' WHEN 7 THEN 'invalid_chunk_index'
    WHEN 9 THEN 'outside_workspace' WHEN 11 THEN 'outside_scope' END AS error FROM hits_l2) GROUP BY query_id""",
    "hits_l2",
)
SQL["h6_results"] = query(
    """SELECT query_id, rank, chunk_id, document_id, workspace_id, chunk_index, document_type, text_content, total_results FROM hits_l2""",
    "hits_l2",
)
