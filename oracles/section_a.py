"""Checking SQL of scans, admission and assembly."""

from __future__ import annotations

from ledgerleaf import constants as K
from ledgerleaf.sources import admit
from ledgerleaf.sources import corpus as C
from oracles.base import cte, lit, query, strip, words
from queries import fixtures as X
from queries import section_a as Q

SQL: dict[str, str] = {}


def _map(table: dict[str, str]) -> str:
    keys, values = list(table), list(table.values())
    return f"map({words(keys)}, {words(values)})"


def uuid5(name: str) -> str:
    h = f"sha1(unhex('{K.DNS_NAMESPACE_HEX}') || encode({name}))"
    variant = f"substr('89ab', 1 + (instr('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4, 1)"
    return (
        f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-5', substr({h}, 14, 3), '-', {variant}, "
        f"substr({h}, 18, 3), '-', substr({h}, 21, 12))"
    )


_columns = ", ".join(f"{sql} AS {name}" for name, sql in X.MANIFEST_SQL.items())
cte("manifest", f"SELECT doc_id, text, n_chars, {_columns} FROM documents")
cte(
    "named",
    """SELECT *, CASE WHEN s = '' THEN 'unnamed_file' ELSE s END AS clean FROM (
    SELECT *, ltrim(regexp_replace(split_part(filename, '/', -1), '[^a-zA-Z0-9._-]', '_', 'g'), '.') AS s FROM manifest)""",
    "manifest",
)
cte(
    "typed",
    """SELECT *, CASE WHEN len(parts) > 1 AND parts[-1] <> '' THEN '.' || lower(parts[-1]) ELSE '' END AS ext,
    CASE WHEN parts[-1] = '' THEN [] ELSE list_transform(parts[2:], lambda p: '.' || lower(p)) END AS exts,
    lower(""" + strip("mime_type") + """) AS mime FROM (SELECT *, string_split(clean, '.') AS parts FROM named)""",
    "named",
)
_pairs = "[" + ", ".join(lit(f"{m} {e}") for m, exts in K.MIME_EXTENSIONS.items() for e in exts) + "]"
cte(
    "judged",
    f"""SELECT *, CASE WHEN length = 0 THEN 'Uploaded file is empty.'
    WHEN length > 10485760 THEN 'File size exceeds maximum allowed limit of 10.0 MB.'
    WHEN ext = '' THEN 'File missing extension.'
    WHEN len(bad) > 0 THEN concat('Forbidden dangerous extension detected: ''', bad[1], '''')
    WHEN NOT list_contains({words(K.ALLOWED_EXTENSIONS)}, ext) THEN concat('Unsupported file extension: ''', ext, '''')
    WHEN NOT list_contains({words(K.MIME_EXTENSIONS)}, mime) THEN concat('Unsupported MIME type: ''', mime, '''')
    WHEN NOT list_contains({_pairs}, concat(mime, ' ', ext)) THEN concat('MIME type ''', mime, ''' does not match file extension ''', ext, '''.')
    END AS reason FROM (SELECT *, list_filter(exts, lambda e: list_contains({words(K.BLOCKED_EXTENSIONS)}, e)) AS bad FROM typed)""",
    "typed",
)
SQL["a2_sanitize_filename"] = query("SELECT doc_id, clean AS clean_name FROM named", "named")
SQL["a3_admission"] = query(
    "SELECT doc_id, clean AS original_filename, ext AS file_extension, reason AS reject_reason FROM judged", "judged"
)
_mime = _map(admit.MIME_BY_EXTENSION)
SQL["a4_guess_mime"] = query(
    f"""SELECT doc_id, coalesce({_mime}[CASE WHEN e = '.gz' THEN lower(regexp_extract(replace(base, '.gz', ''), '.(\\.[^.]+)$', 1)) ELSE e END],
    'application/octet-stream') AS guessed FROM (
    SELECT doc_id, split_part(filename, '/', -1) AS base,
    lower(regexp_extract(split_part(filename, '/', -1), '.(\\.[^.]+)$', 1)) AS e FROM manifest)""",
    "manifest",
)
SQL["a5_category"] = query(
    f"SELECT doc_id, coalesce({_map(K.TECHNICAL_CATEGORY)}[ext], 'UNKNOWN') AS category FROM typed", "typed"
)
_id = uuid5("concat(length(workspace_id), '|', workspace_id, length(path), '|', path, sha256(text))")
SQL["a6_catalog"] = query(
    f"""SELECT *, concat(document_id, file_extension) AS stored_filename FROM (
    SELECT {_id} AS document_id, workspace_id, path, clean AS original_filename, ext AS file_extension, mime AS mime_type,
    {_map(K.TECHNICAL_CATEGORY)}[ext] AS technical_file_category, length AS file_size, 'SUCCESS' AS upload_status,
    'UNPROCESSED' AS processing_status, 'VALID' AS validation_status FROM judged WHERE reason IS NULL)""",
    "judged",
)
cte(
    "routed",
    f"""SELECT *, CASE WHEN parser IS NULL THEN concat('Unsupported document extension for parsing: ''', ext, '''') END AS unsupported
    FROM (SELECT *, {_map(K.PARSER_KIND)}[ext] AS parser FROM typed)""",
    "typed",
)
SQL["a7_parser_routing"] = query(
    "SELECT doc_id, parser, coalesce(unsupported, CASE WHEN length = 0 THEN 'empty_document' END) AS error FROM routed", "routed"
)
SQL["a8_text_decode"] = """
SELECT doc_id::varchar AS document_id, text, length(text) AS character_count,
CASE WHEN text = '' THEN 0 ELSE len(p) - CASE WHEN p[-1] = '' THEN 1 ELSE 0 END END AS line_count, 1 AS page_count
FROM (SELECT *, regexp_split_to_array(replace(text, chr(13) || chr(10), chr(10)), '[\\x{a}-\\x{d}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]') AS p FROM documents)
"""
_cell = "concat(l_returnflag, ', \"', l_linestatus, '\"', chr(10), ' second line')"
SQL["a9_csv_documents"] = f"""
SELECT concat('csv-', l_orderkey, {C.PART_SUFFIX}) AS document_id,
concat('Name | Qty | Flags', chr(10), string_agg(concat('Part ', l_partkey, ' | ', l_quantity::bigint, ' | ', {_cell}), chr(10) ORDER BY {', '.join(C.LINE_ORDER)})) AS text,
'Name/Qty/Flags' AS headers, count(*) AS data_rows, count(*) + 1 AS total_rows
FROM (SELECT *, {C.PART} AS part FROM lineitem) GROUP BY l_orderkey, part
"""
SQL["a10_worksheets"] = f"""
WITH numbered AS (
  SELECT l_orderkey, {C.PART} AS part, l_quantity, row_number() OVER (PARTITION BY l_orderkey, {C.PART} ORDER BY {', '.join(C.LINE_ORDER)}) - 1 AS n,
  concat('Part ', l_partkey, '@', l_quantity::bigint, '@@', l_returnflag) AS r FROM lineitem),
sheets AS (
  SELECT l_orderkey, part, n % 3 + 1 AS s, list(r ORDER BY n) FILTER (WHERE l_quantity <= 45) AS rs FROM numbered GROUP BY ALL)
SELECT concat('wb-', l_orderkey, {C.PART_SUFFIX}) AS document_id,
coalesce(string_agg(concat(s, '=--- Worksheet: Sheet ', s, ' ---', chr(10), replace(array_to_string(rs, chr(10)), '@', ' | ')), chr(10) ORDER BY s) FILTER (WHERE rs IS NOT NULL), '') AS pages,
coalesce(string_agg(concat(s - 1, ':', replace(rs[1], '@', '/'), '+', len(rs) - 1), ';' ORDER BY s) FILTER (WHERE rs IS NOT NULL), '') AS tables,
string_agg(concat('Sheet ', s), ', ' ORDER BY s) AS sheet_names, count(rs) AS page_count
FROM sheets GROUP BY l_orderkey, part
"""
_first = "concat('0@', {page}, ':quality/toxic+', quality, '/', toxic, ';1@', {page}, ':only head/+')"
SQL["a11_word_documents"] = f"""
SELECT concat('w-', d.doc_id) AS document_id,
array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> ''), chr(10) || chr(10)) AS text,
CASE WHEN l.doc_id IS NULL THEN '' ELSE {_first.format(page=1)} END AS tables, '' AS author
FROM documents d LEFT JOIN labels l USING (doc_id)
"""
SQL["a12_paged_documents"] = f"""
SELECT concat('w-', d.doc_id) AS document_id, len(string_split(text, chr(10))) AS page_count,
array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: concat(i, '=', {strip('x')})), '|') AS pages,
CASE WHEN l.doc_id IS NULL THEN '' ELSE {_first.format(page='1 + d.doc_id % 2')} END AS tables
FROM documents d LEFT JOIN labels l USING (doc_id)
"""
SQL["a13_image_metadata"] = """
SELECT doc_id::varchar AS document_id, CASE WHEN ok THEN w ELSE 0 END AS width, CASE WHEN ok THEN h ELSE 0 END AS height,
CASE WHEN ok THEN f END AS format, CASE WHEN NOT ok THEN 0 WHEN f = 'JPEG' THEN 47 ELSE 29 END AS size_bytes,
CASE WHEN ok THEN concat('[IMAGE FILE: ', f, ' (', w, 'x', h, 'px)]') END AS page,
CASE WHEN ok THEN 'SUCCESS' ELSE 'FAILED' END AS parsing_status, CASE WHEN NOT ok THEN 'corrupted_image' END AS parse_error
FROM (SELECT doc_id, 1 + n_chars % 4000 AS w, 1 + doc_id % 3000 AS h, doc_id % 7 <> 0 AS ok,
      CASE WHEN doc_id % 3 = 1 THEN 'JPEG' ELSE 'PNG' END AS f FROM documents)
"""
SQL["a14_parsed_documents"] = query(
    """SELECT doc_id::varchar AS document_id, ext AS file_extension,
    CASE WHEN error IS NULL THEN 1 ELSE 0 END AS page_count,
    CASE WHEN error IS NULL AND parser = 'CSV' THEN 1 ELSE 0 END AS tables,
    CASE WHEN error IS NULL THEN 'SUCCESS' ELSE 'FAILED' END AS parsing_status, error AS parse_error
    FROM (SELECT *, CASE WHEN unsupported IS NOT NULL THEN unsupported WHEN doc_id % 17 = 0 THEN 'empty_document'
      WHEN parser = 'IMAGE' THEN 'corrupted_image'
      WHEN parser IN ('PDF', 'DOCX', 'EXCEL') AND NOT (doc_id % 14 = 0 AND doc_id % 3 <> 0) THEN 'not_decoded' END AS error FROM routed)""",
    "routed",
)
SQL["a15_corpus"] = query(
    "SELECT document_id, CASE WHEN len(pages) = 1 THEN pages[1].text ELSE concat(pages[1].text, chr(10), pages[2].text) END AS body FROM docs",
    "docs",
)
