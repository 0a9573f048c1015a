"""Checking SQL of classification, extraction and validation."""

from __future__ import annotations

from ledgerleaf import constants as K
from oracles.base import classified, cte, keyword, lines_of, lit, query, strip, words
from queries import fixtures as X
from queries import section_bcd as Q

SQL: dict[str, str] = {}

# --- B --------------------------------------------------------------------------
SQL["b1_normalized"] = query(
    """SELECT document_id, upper(body) AS corpus_upper,
    upper(array_to_string(headers, chr(10))) AS headers_upper FROM doc_bodies""",
    "doc_bodies",
)
SQL["b2_vetoed_rules"] = query("SELECT DISTINCT document_id, rule_no FROM cls_hits WHERE kind_ = 'Negative'", "cls_hits")
SQL["b3_weighted_scores"] = query("SELECT document_id, rule_no, points / 100.0::double AS score FROM cls_scores", "cls_scores")
SQL["b4_best_rule"] = query("SELECT document_id, doc_type AS document_type, points FROM cls_best", "cls_best")
SQL["b5_threshold"] = query("SELECT document_id, document_type, confidence, reason FROM pcls", "pcls")
SQL["b6_signals"] = query("SELECT document_id, document_type, matched_rules, reason FROM cls", "cls")
cte(
    "user_words",
    """SELECT n_nationkey + 1 AS rule_no, n_name AS doc_type, k AS kind_, p AS points, w AS word FROM nation, (VALUES (1)) t(x),
    LATERAL (SELECT * FROM (VALUES ('Primary', 40, 'USER' || n_nationkey), ('Primary', 40, 'N00000' || n_nationkey),
      ('Secondary', 15, '-' || lpad(n_nationkey::varchar, 2, '0') || '-'),
      ('Header', 20, CASE WHEN n_nationkey % 2 = 1 THEN 'QTY' END), ('Negative', 0, '0' || n_nationkey || '7')) v(k, p, w)) WHERE w IS NOT NULL""",
)
classified("ucls", "doc_bodies", "user_words")
SQL["b7_user_rules"] = query("SELECT document_id, document_type, confidence, matched_rules FROM ucls", "ucls")
cte(
    "customer_words",
    """SELECT c_custkey + 1 AS rule_no, c_name AS doc_type, k AS kind_, p AS points, w AS word FROM customer, (VALUES (1)) t(x),
    LATERAL (SELECT * FROM (VALUES ('Primary', 40, 'N' || lpad(c_custkey::varchar, 8, '0')),
      ('Secondary', 15, lpad(c_nationkey::varchar, 2, '0') || '/'), ('Header', 20, CASE WHEN c_mktsegment = 'BUILDING' THEN 'QTY' END),
      ('Negative', 0, '9' || lpad((c_custkey % 100)::varchar, 2, '0') || '.')) v(k, p, w)) WHERE w IS NOT NULL""",
)
classified("ccls", "doc_bodies", "customer_words")
SQL["b7_customer_rules"] = query("SELECT document_id, document_type, confidence, matched_rules FROM ccls", "ccls")
SQL["b8_type_distribution"] = query(
    "SELECT document_type, count(*) AS documents, round(avg(confidence), 6) AS avg_confidence FROM cls GROUP BY document_type", "cls"
)

# --- C: lines, look-ups, mentions ---------------------------------------------------
SQL["c1_lines"] = query("SELECT document_id, line_no - 1 AS line_no, line FROM doc_lines", "doc_lines")
_GROUPS = {
    "invoice_no": K.INVOICE_NO_KEYWORDS,
    "po_no": K.PO_NO_KEYWORDS,
    "date_text": K.DATE_KEYWORDS,
    "due_date": K.DUE_DATE_KEYWORDS,
    "subtotal": K.SUBTOTAL_KEYWORDS,
    "total": K.TOTAL_KEYWORDS,
    "tax": K.TAX_KEYWORDS,
}
for _way, _whole in (("w", True), ("s", False)):
    for _name, _ks in _GROUPS.items():
        keyword(f"{_way}_{_name}", _ks, _whole)
    SQL["c2_whole_word_values" if _whole else "c3_substring_values"] = query(
        "SELECT document_id, "
        + ", ".join(f"{_way}_{n}.v AS {n}" for n in _GROUPS)
        + " FROM docs "
        + " ".join(f"LEFT JOIN {_way}_{n} USING (document_id)" for n in _GROUPS),
        "docs", *(f"{_way}_{n}" for n in _GROUPS),
    )
for _t in ("CGST", "SGST", "IGST"):
    keyword(f"w_{_t.lower()}", (_t,), True)

# Entity patterns of the checking side.
_GSTIN = r"(?i)\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b"
_PAN = r"(?i)\b[A-Z]{5}[0-9]{4}[A-Z]\b"
_DATE = (
    r"(?i)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}"
    r"|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4})\b"
)
_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
_PHONE = r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
_MONEY = r"(?i)(?:Rs\.?|INR|₹)?\s*([0-9]{1,3}(?:,[0-9]{2,3})*(?:\.[0-9]{2})?)"
_all = lambda body, pattern: f"regexp_extract_all({body}, '{pattern}')"
SQL["c4_nth_entities"] = query(
    f"""SELECT document_id, g[1] AS first_gstin, g[2] AS second_gstin, p[1] AS first_pan, p[2] AS second_pan
    FROM (SELECT document_id, {_all('body', _GSTIN)} AS g, {_all('body', _PAN)} AS p FROM docs)""",
    "docs",
)


def _mentions(key: str, source: str, matches: str, *needs: str) -> str:
    return query(
        f"SELECT {key}, generate_subscripts(m, 1) - 1 AS n, unnest(m) AS mention FROM (SELECT {key}, {matches} AS m FROM {source})",
        *needs,
    )


SQL["c5_date_mentions"] = _mentions("document_id", "docs", _all("body", _DATE), "docs")
SQL["c6_email_mentions"] = _mentions("doc_id", "documents", _all("text", _EMAIL))
SQL["c7_phone_mentions"] = _mentions("doc_id", "documents", _all("text", _PHONE))
SQL["c8_money_mentions"] = _mentions("document_id", "docs", f"regexp_extract_all(body, '{_MONEY}', 1)", "docs")

# --- C: whole documents ----------------------------------------------------------------
cte(
    "fam",
    """SELECT document_id, document_type, CASE
    WHEN document_type IN ('Sales Invoice', 'Purchase Invoice', 'GST Invoice', 'Credit Note', 'Debit Note') THEN 'invoice'
    WHEN document_type IN ('Purchase Order', 'Quotation', 'Sales Order') THEN 'order'
    WHEN document_type IN ('Receipt', 'Payment Voucher', 'Expense Bill') THEN 'receipt'
    WHEN document_type = 'Bank Statement' THEN 'bank' WHEN document_type = 'Salary Slip' THEN 'salary' ELSE 'generic' END AS family FROM cls""",
    "cls",
)
cte(
    "cell_rows",
    """SELECT document_id, unnest(tables[1].cell_rows) AS r, generate_subscripts(tables[1].cell_rows, 1) AS n FROM docs WHERE len(tables) > 0""",
    "docs",
)
cte(
    "items",
    """SELECT document_id, n::int AS item_number,
    CASE WHEN family IN ('bank', 'generic') THEN array_to_string(r, ' | ') ELSE r[1] END AS description,
    CASE WHEN family IN ('invoice', 'order') AND len(r) > 1 THEN r[2] END AS quantity,
    CASE WHEN family = 'invoice' AND len(r) > 2 THEN r[3] END AS unit_price,
    CASE WHEN (family = 'invoice' AND len(r) > 3) OR (family = 'order' AND len(r) > 2) OR (family = 'salary' AND len(r) > 1)
      OR family = 'bank' THEN r[-1] END AS amount
    FROM cell_rows JOIN fam USING (document_id) WHERE len(r) > 0 AND family <> 'receipt'""",
    "cell_rows", "fam",
)
cte("item_counts", "SELECT document_id, count(*) AS items FROM items GROUP BY document_id", "items")
_in = lambda *fs: "family IN (" + ", ".join(lit(f) for f in fs) + ")"
cte(
    "e0",
    f"""SELECT d.document_id, d.workspace_id, d.key, d.pages, d.body, document_type, family, len(tables) AS tables_extracted,
    coalesce(items, 0) AS items,
    CASE family WHEN 'invoice' THEN w_invoice_no.v WHEN 'order' THEN s_po_no.v END AS document_number,
    CASE WHEN family = 'invoice' THEN w_date_text.v WHEN {_in('order', 'receipt')} THEN s_date_text.v END AS stated_date,
    CASE WHEN family = 'invoice' THEN w_due_date.v END AS due_date,
    CASE WHEN family = 'invoice' THEN w_subtotal.v END AS subtotal,
    CASE WHEN family = 'invoice' THEN w_total.v WHEN {_in('order', 'receipt')} THEN s_total.v END AS grand_total,
    CASE WHEN family = 'invoice' THEN w_cgst.v END AS cgst,
    CASE WHEN family = 'invoice' THEN w_sgst.v END AS sgst,
    CASE WHEN family = 'invoice' THEN w_igst.v END AS igst,
    CASE WHEN {_in('invoice', 'order', 'generic')} THEN {_all('body', _GSTIN)} ELSE [] END AS g,
    CASE WHEN {_in('invoice', 'salary', 'generic')} THEN {_all('body', _PAN)} ELSE [] END AS p,
    CASE WHEN {_in('invoice', 'generic')} THEN {_all('body', _DATE)} ELSE [] END AS dd,
    CASE WHEN family = 'generic' THEN {_all('body', _EMAIL)} ELSE [] END AS ee,
    CASE WHEN family = 'generic' THEN {_all('body', _PHONE)} ELSE [] END AS pp
    FROM docs d JOIN fam USING (document_id) LEFT JOIN item_counts USING (document_id) """
    + " ".join(
        f"LEFT JOIN {n} USING (document_id)"
        for n in (
            "w_invoice_no", "s_po_no", "w_date_text", "s_date_text", "w_due_date", "w_subtotal", "w_total", "s_total",
            "w_cgst", "w_sgst", "w_igst",
        )
    ),
    "docs", "fam", "item_counts", "w_invoice_no", "s_po_no", "w_date_text", "s_date_text", "w_due_date", "w_subtotal",
    "w_total", "s_total", "w_cgst", "w_sgst", "w_igst",
)
_part = lambda x: f"coalesce(try_cast(regexp_replace({x}, '[^0-9.]', '', 'g') AS double), 0)"
cte(
    "e1",
    f"""SELECT *, coalesce(stated_date, dd[1]) AS document_date,
    CASE WHEN coalesce(cgst, sgst, igst) IS NOT NULL THEN printf('%.2f', {_part('cgst')} + {_part('sgst')} + {_part('igst')}) END AS total_tax
    FROM e0""",
    "e0",
)
_has = lambda *xs: " + ".join(f"(coalesce({x}, '') <> '')::int" for x in xs)
cte(
    "ext",
    f"""SELECT *, total_tax AS tax_amount, g[1] AS seller_gstin, p[1] AS seller_pan, ee[1] AS seller_email, pp[1] AS seller_phone,
    CASE WHEN family = 'invoice' THEN g[2] END AS buyer_gstin, CASE WHEN family = 'invoice' THEN p[2] END AS buyer_pan,
    CASE family WHEN 'invoice' THEN items + {_has('document_number', 'document_date', 'subtotal', 'grand_total', 'cgst', 'sgst', 'igst', 'total_tax')}
    WHEN 'order' THEN items + {_has('document_number', 'document_date', 'grand_total')}
    WHEN 'receipt' THEN {_has('document_date', 'grand_total')} WHEN 'bank' THEN items
    WHEN 'salary' THEN items + CASE WHEN len(p) > 0 THEN 1 ELSE 0 END
    ELSE items + len(g) + len(dd) END AS fields_count FROM e1""",
    "e1",
)
cte(
    "item_text",
    """SELECT document_id, string_agg(concat_ws('~', item_number, coalesce(description, '?'), coalesce(quantity, '?'),
    coalesce(unit_price, '?'), coalesce(amount, '?')), ';' ORDER BY item_number) AS items_text FROM items GROUP BY document_id""",
    "items",
)
for _name, _family in (
    ("c10_invoices", "invoice"), ("c11_orders", "order"), ("c12_bank_statements", "bank"),
    ("c13_receipts", "receipt"), ("c14_salary_slips", "salary"), ("c15_generic_documents", "generic"),
):
    SQL[_name] = query(
        f"SELECT document_id, {', '.join(Q.FIELDS)}, coalesce(items_text, '') AS items FROM ext LEFT JOIN item_text USING (document_id) WHERE family = '{_family}'",
        "ext", "item_text",
    )
SQL["c16_family_router"] = query("SELECT document_type, family, count(*) AS documents FROM fam GROUP BY ALL", "fam")
SQL["c17_line_items"] = query(
    """SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY item_number) - 1 AS position,
    item_number, description, quantity, unit_price, amount FROM items""",
    "items",
)
SQL["c18_tax_roll_up"] = query("SELECT document_id, total_tax, tax_amount FROM ext WHERE total_tax IS NOT NULL", "ext")
SQL["c19_field_counts"] = query("SELECT document_type, fields_count, count(*) AS documents FROM ext GROUP BY ALL", "ext")

# --- D: readings -----------------------------------------------------------------------
SQL["d1_normalized_strings"] = query(
    f"SELECT c_custkey, nullif({strip('raw')}, '') AS clean FROM (SELECT *, {Q.ODD_TEXT['raw']} AS raw FROM customer)"
)
amount = lambda x: f"try_cast(regexp_replace({x}, '[^0-9.-]', '', 'g') AS double)"
SQL["d2_amounts"] = f"""
SELECT coalesce(raw, 'null') AS raw, n, coalesce({amount('raw')}, -0.5) AS amount,
coalesce({amount("regexp_replace(raw, '^(Rs[.]?|INR)', '')")}, -0.5) AS strict_amount
FROM (SELECT raw, count(*) AS n FROM (SELECT {Q.AMOUNT_TEXT['raw']} AS raw FROM lineitem) GROUP BY raw)
"""
_FORMATS = ("%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%d %b %Y", "%d %B %Y", "%Y/%m/%d", "%d.%m.%Y")
_SHAPE = r"^([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}|[0-9]{1,2} [A-Za-z]+ [0-9]{4})$"


def parsed_date(x: str) -> str:
    tries = ", ".join(f"try_strptime({strip(x)}, '{f}')" for f in _FORMATS)
    return f"CASE WHEN regexp_matches({strip(x)}, '{_SHAPE}') THEN coalesce({tries})::date END"


SQL["d3_dates"] = query(
    f"SELECT o_orderkey, ({parsed_date('raw')})::varchar AS parsed FROM (SELECT *, {Q.DATE_TEXT['raw']} AS raw FROM orders)"
)
_FORMS = {
    "gstin": "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$",
    "pan": "^[A-Z]{5}[0-9]{4}[A-Z]$",
    "ifsc": "^[A-Z]{4}0[A-Z0-9]{6}$",
}
valid = lambda x, form: f"coalesce(regexp_matches(upper({strip(x)}), '{_FORMS[form]}'), false)"
for _n, _form in (("d4", "gstin"), ("d5", "pan"), ("d6", "ifsc")):
    _col = f"{_form}_text"
    SQL[f"{_n}_{_form}_format"] = query(
        f"SELECT c_custkey, {valid(_col, _form)} AS valid FROM (SELECT *, {Q.ID_TEXT[_col]} AS {_col} FROM customer)"
    )

# --- D: rules ------------------------------------------------------------------------------
cte("genuine", "SELECT *, 'INR' AS currency, 1 AS keep_items FROM ext", "ext")
_replaced = {p.split(".")[1] if p.startswith(("header", "totals")) else p.replace(".", "_"): s for p, s in X.TAMPER_SQL.items()}
cte(
    "faulted",
    "SELECT * REPLACE (" + ", ".join(f"{s.format(x=n)} AS {n}" for n, s in _replaced.items())
    + f", CASE WHEN {X.TAMPER_NO_ITEMS} THEN 0 ELSE items END AS items"
    + f", CASE WHEN {X.TAMPER_NO_ITEMS} THEN 0 ELSE 1 END AS keep_items) FROM genuine",
    "genuine",
)
cte(
    "item_sums",
    f"SELECT document_id, sum({amount('amount')}) AS line_sum FROM items WHERE {amount('amount')} IS NOT NULL GROUP BY document_id",
    "items",
)
_clean = lambda x: f"nullif({strip(x)}, '')"


def judged(name: str, source: str) -> None:
    """CTEs <name>_v (typed values) and <name> (one row per finding, with its order)."""
    cte(
        f"{name}_v",
        f"""SELECT *, coalesce(sub_a, line_sum) AS eff_sub, coalesce(tax_a, tax_sum) AS eff_tax FROM (
        SELECT *, cg + sg + ig AS tax_sum FROM (
        SELECT s.*, {_clean('document_number')} AS no_, {_clean('document_date')} AS date_, {parsed_date('document_date')} AS dt,
        {_clean('seller_gstin')} AS sgn, {_clean('buyer_gstin')} AS bgn, {_clean('seller_pan')} AS spn, {_clean('buyer_pan')} AS bpn,
        {_clean('currency')} AS cur, {amount('subtotal')} AS sub_a, {amount('tax_amount')} AS tax_a, {amount('grand_total')} AS tot_a,
        coalesce({amount('cgst')}, 0) AS cg, coalesce({amount('sgst')}, 0) AS sg, coalesce({amount('igst')}, 0) AS ig,
        CASE WHEN keep_items = 1 THEN coalesce(i.line_sum, 0) ELSE 0 END AS line_sum,
        keep_items = 1 AND i.line_sum IS NOT NULL AS any_amount
        FROM {source} s LEFT JOIN item_sums i USING (document_id)))""",
        source, "item_sums",
    )
    head = "document_type IN ('Sales Invoice', 'Purchase Invoice', 'GST Invoice', 'Purchase Order', 'Quotation', 'Sales Order', 'Delivery Challan')"
    tax = "document_type IN ('GST Invoice', 'Sales Invoice', 'Purchase Invoice')"
    two = lambda x: f"printf('%.2f', {x})"
    # Rule ids, severities, fields and messages.
    rules = [
        ("VAL_HDR_001", "ERROR", "header.document_number", f"{head} AND no_ IS NULL", "'Document number is missing or blank.'"),
        ("VAL_HDR_002", "ERROR", "header.document_date", f"{head} AND date_ IS NULL", "'Document issuance date is missing or invalid.'"),
        ("VAL_HDR_003", "WARNING", "header.document_date", f"{head} AND date_ IS NOT NULL AND dt IS NULL", "concat('Document date ''', date_, ''' is not in a recognized date format.')"),
        ("VAL_PRT_001", "WARNING", "seller.gstin", f"{tax} AND sgn IS NULL", "concat('Seller GSTIN is required for ', document_type, ' but missing.')"),
        ("VAL_PRT_002", "ERROR", "seller.gstin", f"sgn IS NOT NULL AND NOT {valid('sgn', 'gstin')}", "concat('Seller GSTIN ''', sgn, ''' is invalid.')"),
        ("VAL_PRT_003", "ERROR", "buyer.gstin", f"bgn IS NOT NULL AND NOT {valid('bgn', 'gstin')}", "concat('Buyer GSTIN ''', bgn, ''' is invalid.')"),
        ("VAL_PRT_004", "WARNING", "seller.pan", f"spn IS NOT NULL AND NOT {valid('spn', 'pan')}", "concat('Seller PAN ''', spn, ''' is invalid.')"),
        ("VAL_PRT_005", "WARNING", "buyer.pan", f"bpn IS NOT NULL AND NOT {valid('bpn', 'pan')}", "concat('Buyer PAN ''', bpn, ''' is invalid.')"),
        ("VAL_ITM_001", "ERROR", "line_items", "family = 'invoice' AND items = 0", "concat('At least one line item is required for ', document_type, '.')"),
        ("VAL_CUR_001", "WARNING", "totals.currency", "upper(cur) NOT IN ('INR', 'USD', 'EUR', 'GBP', 'AED')", "concat('Unrecognized or unsupported currency code ''', cur, '''.')"),
        ("VAL_MTH_001", "WARNING", "totals.subtotal", "any_amount AND abs(line_sum - sub_a) > 0.05", f"concat('Subtotal mismatch: Calculated line items sum (', {two('line_sum')}, ') does not equal stated subtotal (', {two('sub_a')}, ').')"),
        ("VAL_MTH_002", "WARNING", "totals.tax_amount", "(cg > 0 OR sg > 0 OR ig > 0) AND abs(tax_sum - tax_a) > 0.05", f"concat('Tax total mismatch: Calculated sum of CGST/SGST/IGST (', {two('tax_sum')}, ') does not equal stated tax amount (', {two('tax_a')}, ').')"),
        ("VAL_MTH_003", "ERROR", "totals.grand_total", "(eff_sub > 0 OR eff_tax > 0) AND abs(eff_sub + eff_tax - tot_a) > 0.05", f"concat('Grand total mismatch: Stated total (', {two('tot_a')}, ') does not equal Subtotal + Taxes (', {two('eff_sub + eff_tax')}, ').')"),
    ]
    cte(
        name,
        " UNION ALL ".join(
            f"SELECT document_id, document_type, {n} AS rule_order, '{r}' AS rule_id, '{sev}' AS severity, '{field}' AS field, {msg} AS message FROM {name}_v WHERE {cond}"
            for n, (r, sev, field, cond, msg) in enumerate(rules)
        ),
        f"{name}_v",
    )
    cte(
        f"{name}_status",
        f"""SELECT document_id, document_type, e = 0 AS is_valid, e AS error_count, w AS warning_count, rules,
        CASE WHEN e > 0 THEN 'INVALID' WHEN w > 0 THEN 'VALID_WITH_WARNINGS' ELSE 'VALID' END AS status FROM (
        SELECT s.document_id, s.document_type, count(*) FILTER (WHERE severity = 'ERROR') AS e,
        count(*) FILTER (WHERE severity = 'WARNING') AS w, coalesce(string_agg(rule_id, ',' ORDER BY rule_order), '') AS rules
        FROM {source} s LEFT JOIN {name} f USING (document_id) GROUP BY s.document_id, s.document_type)""",
        source, name,
    )


judged("fjudged", "faulted")
judged("gjudged", "genuine")
for _name, _ids in Q.RULE_QUERIES.items():
    SQL[_name] = query(
        f"SELECT document_id, rule_id, severity, field, message FROM fjudged WHERE list_contains({words(_ids)}, rule_id)", "fjudged"
    )
SQL["d15_line_sums"] = query(
    "SELECT document_id, round(coalesce(line_sum, 0), 2) AS line_sum, line_sum IS NOT NULL AS any_amount FROM ext LEFT JOIN item_sums USING (document_id)",
    "ext", "item_sums",
)
SQL["d19_status"] = query(
    "SELECT document_id, document_type, is_valid, status, error_count, warning_count, rules FROM fjudged_status", "fjudged_status"
)
SQL["d20_issue_report"] = query(
    "SELECT document_type, rule_id, severity, count(*) AS issues FROM gjudged GROUP BY ALL", "gjudged"
)
SQL["d21_valid_only"] = query(
    "SELECT document_id, document_type, CASE WHEN is_valid THEN 'chunking' ELSE 'stopped' END AS sink FROM gjudged_status", "gjudged_status"
)
