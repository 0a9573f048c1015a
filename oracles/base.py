"""Building blocks of the checking SQL (DuckDB dialect).

The documents are made from the same column expressions as the Spark corpus. Every
operator is then written a second time, in SQL and by another route.
"""

from __future__ import annotations

import re

from ledgerleaf.sources import corpus as C

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str, recursive: bool = False) -> None:
    CTES[name] = (needs, sql.strip())


def query(sql: str, *needs: str) -> str:
    """A single statement: the needed CTEs in order, then ``sql``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in CTES[name][0]:
            visit(n)
        order.append(name)

    for n in needs:
        visit(n)
    body = ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in order)
    return f"WITH RECURSIVE {body}\n{sql.strip()}" if order else sql.strip()


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]::varchar[]"


# White space as strip() sees it.
SPACES = "concat(" + ", ".join(
    f"chr({c})" for c in range(0x3001) if chr(c).isspace()
) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


_headers = "CASE kind " + " ".join(
    f"WHEN {n} THEN {words(k[2])}" for n, k in enumerate(C.KINDS)
) + " END"

cte("ol", f"SELECT *, {_select(C.LINE_COLUMNS)} FROM lineitem")
cte(
    "orow",
    f"""SELECT *, CASE WHEN {C.EMPTY_ROW} THEN []::varchar[]
    WHEN {C.SHORT_ROW} THEN [{', '.join(C.CELLS[:3])}] ELSE [{', '.join(C.CELLS)}] END AS cells FROM ol""",
    "ol",
)
cte(
    "d0",
    f"""SELECT l_orderkey AS key, {C.PART} AS part, o_custkey AS custkey, o_orderdate AS orderdate,
    sum(cents)::bigint AS subtotal_cents, count(*) AS n_lines,
    list(cells ORDER BY {', '.join(C.LINE_ORDER)}, cells) AS cell_rows
    FROM orow JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, part, o_custkey, o_orderdate""",
    "orow",
)
_previous = "d0"
for _i, (_name, _sql) in enumerate(C.DOCUMENT_COLUMNS.items()):
    cte(f"d{_i + 1}", f"SELECT *, {_sql} AS {_name} FROM {_previous}", _previous)
    _previous = f"d{_i + 1}"
cte("dt", f"SELECT *, {_select(C.TEXT_COLUMNS)} FROM {_previous}", _previous)
cte(
    "docs",
    f"""SELECT document_id, workspace_id, key, kind, doc_no, doc_date, seller_gstin, subtotal_cents,
    tax_cents, total_fault, n_lines,
    CASE WHEN key % 3 = 0 THEN [{{'page_number': 1, 'text': first_half}}, {{'page_number': 2, 'text': second_half}}]
    ELSE [{{'page_number': 1, 'text': concat_ws(chr(10), first_half, second_half)}}] END AS pages,
    CASE WHEN no_table THEN [] ELSE [{{'headers': {_headers}, 'cell_rows': cell_rows}}] END AS tables,
    concat_ws(chr(10), first_half, second_half) AS body
    FROM dt""",
    "dt",
)

# --- classification -------------------------------------------------------------
from ledgerleaf.rules import BUILTIN_RULES  # noqa: E402

_rules = " UNION ALL ".join(
    f"SELECT {n} AS rule_no, {lit(r.doc_type)} AS doc_type, {lit(kind)} AS kind_, {points} AS points, unnest({words(ws)}) AS word"
    for n, r in enumerate(BUILTIN_RULES, 1)
    for kind, points, ws in (
        ("Primary", 40, r.primary),
        ("Secondary", 15, r.secondary),
        ("Header", 20, r.headers),
        ("Negative", 0, r.negative),
    )
    if ws
)
cte("rule_words", _rules)


def classified(name: str, source: str, rules: str = "rule_words") -> None:
    """CTEs <name>_hits, <name>_scores, <name> over (document_id, body, headers list)."""
    cte(
        f"{name}_up",
        f"SELECT document_id, upper(replace(body, 'ß', 'ss')) AS u, list_transform(headers, lambda h: upper(h)) AS hs FROM {source}",
        source,
    )
    cte(
        f"{name}_hits",
        f"""SELECT document_id, rule_no, doc_type, kind_, points, word FROM {name}_up, {rules}
        WHERE CASE WHEN kind_ = 'Header' THEN len(list_filter(hs, lambda h: contains(h, word))) > 0
        ELSE contains(u, word) END""",
        f"{name}_up", rules,
    )
    cte(
        f"{name}_scores",
        f"""SELECT document_id, rule_no, doc_type, least(sum(points), 100) AS points,
        string_agg(concat(kind_, ': ''', word, ''''), '|' ORDER BY CASE kind_ WHEN 'Primary' THEN 1 WHEN 'Secondary' THEN 2 ELSE 3 END, word) AS signals,
        count(*) AS n FROM {name}_hits h
        WHERE NOT EXISTS (SELECT 1 FROM {name}_hits v WHERE v.document_id = h.document_id AND v.rule_no = h.rule_no AND v.kind_ = 'Negative')
        GROUP BY document_id, rule_no, doc_type""",
        f"{name}_hits",
    )
    cte(
        f"{name}_best",
        f"""SELECT * FROM {name}_scores QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY points DESC, rule_no) = 1""",
        f"{name}_scores",
    )
    cte(
        name,
        f"""SELECT s.document_id, CASE WHEN coalesce(points, 0) < 35 THEN 'Unknown Document' ELSE doc_type END AS document_type,
        coalesce(points, 0) / 100.0::double AS confidence, coalesce(signals, '') AS matched_rules,
        CASE WHEN coalesce(points, 0) < 35 THEN concat('Confidence score (', (coalesce(points, 0) / 100.0::double)::varchar, ') was below minimum threshold (0.35).')
        ELSE concat('Matched ', n, ' keyword/header signals.') END AS reason
        FROM {source} s LEFT JOIN {name}_best b USING (document_id)""",
        source, f"{name}_best",
    )


cte(
    "doc_bodies",
    "SELECT document_id, body, flatten(list_transform(tables, lambda t: t.headers)) AS headers FROM docs",
    "docs",
)
classified("cls", "doc_bodies")
cte("plain_bodies", "SELECT doc_id::varchar AS document_id, text AS body, []::varchar[] AS headers FROM documents")
classified("pcls", "plain_bodies")

# --- extraction: lines and keyword values -----------------------------------------
_ends = "[" + "".join(f"\\x{{{c:x}}}" for c in (10, 13, 11, 12, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029)) + "]"
LINE_ENDS = _ends


def lines_of(text: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array({text}, '{_ends}'), "
        f"lambda x: {strip('x')}), lambda x: x <> '')"
    )


cte(
    "doc_lines",
    f"SELECT document_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (SELECT document_id, {lines_of('body')} AS ls FROM docs)",
    "docs",
)
_VALUE = strip(r"regexp_extract(line, '^[^:\-=]*[:\-=](.*)$', 1)")
cte(
    "line_values",
    f"SELECT document_id, line_no, upper(line) AS u, {_VALUE} AS v FROM doc_lines "
    + r"WHERE regexp_matches(line, '[:\-=]')",
    "doc_lines",
)


def _re(keywords) -> str:
    return "(" + "|".join(re.escape(k).replace("'", "''") for k in keywords) + ")"


def keyword(name: str, keywords, whole: bool) -> None:
    """CTE <name>(document_id, v): value of the first line with a keyword and a value."""
    pattern = _re(keywords)
    if whole:
        pattern = f"(^|[^A-Z0-9]){pattern}([^A-Z0-9]|$)"
    cte(
        name,
        f"SELECT document_id, min_by(v, line_no) AS v FROM line_values WHERE v <> '' AND regexp_matches(u, '{pattern}') GROUP BY document_id",
        "line_values",
    )
