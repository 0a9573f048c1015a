"""Classification, extraction and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf import constants as K
from ledgerleaf.functions import text, values
from ledgerleaf.operators import classify as C
from ledgerleaf.operators import extract as E
from ledgerleaf.operators import validate as V
from ledgerleaf.plans import reports
from ledgerleaf.sources import corpus
from ledgerleaf.sources.corpus import read, texts, with_exprs
from queries import fixtures as X


# --- B: classification --------------------------------------------------------------
def b1_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.normalized(X.documents(spark, sf_dir)).select("document_id", "corpus_upper", "headers_upper")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rule_scores(X.documents(spark, sf_dir))


def b2_vetoed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).filter("vetoed").select("document_id", "rule_no")


def b3_weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).filter("points > 0").select(
        "document_id", "rule_no", (F.col("points") / F.lit(100.0)).alias("score")
    )


def b4_best_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _scores(spark, sf_dir).filter("points > 0").groupBy("document_id").agg(
        F.max(F.struct("points", (-F.col("rule_no")).alias("order"), "document_type")).alias("best")
    )
    return best.select("document_id", F.col("best.document_type").alias("document_type"), F.col("best.points").alias("points"))


def b5_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify(X.plain_documents(spark, sf_dir)).select("document_id", "document_type", "confidence", "reason")


def b6_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.classified(spark, sf_dir).select(
        "document_id", "document_type", F.array_join("matched_rules", "|").alias("matched_rules"), "reason"
    )


def b7_user_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    key = F.col("n_nationkey").cast("string")
    rules = read(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 1).alias("rule_no"),
        F.col("n_name").alias("doc_type"),
        F.array(F.concat(F.lit("USER"), key), F.concat(F.lit("N00000"), key)).alias("primary"),
        F.array(F.concat(F.lit("-"), F.lpad(key, 2, "0"), F.lit("-"))).alias("secondary"),
        F.when(F.col("n_nationkey") % 2 == 1, F.array(F.lit("QTY"))).otherwise(empty).alias("headers"),
        F.array(F.concat(F.lit("0"), key, F.lit("7"))).alias("negative"),
    )
    return C.classify(X.documents(spark, sf_dir), rules).select(
        "document_id", "document_type", "confidence", F.array_join("matched_rules", "|").alias("matched_rules")
    )


def b7_customer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule for each customer: as many rules as the table has rows."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    key = F.col("c_custkey")
    rules = read(spark, sf_dir, "customer").select(
        (key + 1).alias("rule_no"),
        F.col("c_name").alias("doc_type"),
        F.array(F.concat(F.lit("N"), F.lpad(key.cast("string"), 8, "0"))).alias("primary"),
        F.array(F.concat(two(F.col("c_nationkey")), F.lit("/"))).alias("secondary"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("QTY"))).alias("headers"),
        F.array(F.concat(F.lit("9"), two(key % 100), F.lit("."))).alias("negative"),
    )
    return C.classify(X.documents(spark, sf_dir), rules).select(
        "document_id", "document_type", "confidence", F.array_join("matched_rules", "|").alias("matched_rules")
    )


def b8_type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.type_distribution(X.classified(spark, sf_dir))


# --- C: extraction --------------------------------------------------------------------
def _body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.documents(spark, sf_dir).withColumn("body", text.corpus(F.col("pages")))


def c1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _body(spark, sf_dir).select(
        "document_id", F.posexplode(text.lines(F.col("body"))).alias("line_no", "line")
    )


def _look_up(spark: SparkSession, sf_dir: str, whole: bool) -> DataFrame:
    cands = _body(spark, sf_dir).withColumn("cands", text.candidates(text.lines(F.col("body"))))
    found = lambda ks: text.keyword_value(F.col("cands"), ks, whole_words=whole)
    return cands.select(
        "document_id",
        found(K.INVOICE_NO_KEYWORDS).alias("invoice_no"),
        found(K.PO_NO_KEYWORDS).alias("po_no"),
        found(K.DATE_KEYWORDS).alias("date_text"),
        found(K.DUE_DATE_KEYWORDS).alias("due_date"),
        found(K.SUBTOTAL_KEYWORDS).alias("subtotal"),
        found(K.TOTAL_KEYWORDS).alias("total"),
        found(K.TAX_KEYWORDS).alias("tax"),
    )


def c2_whole_word_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _look_up(spark, sf_dir, True)


def c3_substring_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _look_up(spark, sf_dir, False)


def c4_nth_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _body(spark, sf_dir).withColumns(
        {"g": text.mentions(F.col("body"), text.GSTIN), "p": text.mentions(F.col("body"), text.PAN)}
    )
    return found.select(
        "document_id",
        text.nth(F.col("g"), 0).alias("first_gstin"), text.nth(F.col("g"), 1).alias("second_gstin"),
        text.nth(F.col("p"), 0).alias("first_pan"), text.nth(F.col("p"), 1).alias("second_pan"),
    )


def _mentions(df: DataFrame, key: str, column: str, pattern: str, group: int = 0) -> DataFrame:
    return df.select(key, F.posexplode(text.mentions(F.col(column), pattern, group)).alias("n", "mention"))


def c5_date_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(_body(spark, sf_dir), "document_id", "body", text.DATE)


def c6_email_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(texts(spark, sf_dir), "doc_id", "text", text.EMAIL)


def c7_phone_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(texts(spark, sf_dir), "doc_id", "text", text.PHONE)


def c8_money_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(_body(spark, sf_dir), "document_id", "body", text.MONEY, 1)


FIELDS = {
    "document_number": "header.document_number",
    "document_date": "header.document_date",
    "due_date": "header.due_date",
    "seller_gstin": "seller.gstin",
    "seller_pan": "seller.pan",
    "seller_email": "seller.email",
    "seller_phone": "seller.phone",
    "buyer_gstin": "buyer.gstin",
    "buyer_pan": "buyer.pan",
    "cgst": "taxes.cgst",
    "sgst": "taxes.sgst",
    "igst": "taxes.igst",
    "total_tax": "taxes.total_tax",
    "subtotal": "totals.subtotal",
    "tax_amount": "totals.tax_amount",
    "grand_total": "totals.grand_total",
    "fields_count": "extraction.extracted_fields_count",
    "tables_extracted": "extraction.tables_extracted",
}


def _items_text(items: str) -> Column:
    return F.array_join(
        F.transform(
            items,
            lambda x: F.concat_ws(
                "~", x["item_number"].cast("string"), F.coalesce(x["description"], F.lit("?")),
                F.coalesce(x["quantity"], F.lit("?")), F.coalesce(x["unit_price"], F.lit("?")),
                F.coalesce(x["amount"], F.lit("?")),
            ),
        ),
        ";",
    )


def _family(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    mine = X.classified(spark, sf_dir).filter(E.family(F.col("document_type")) == name)
    return E.extract(mine).select(
        "document_id", *(F.col(path).alias(n) for n, path in FIELDS.items()), _items_text("line_items").alias("items")
    )


def c10_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, E.INVOICE)


def c11_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, E.ORDER)


def c12_bank_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, E.BANK)


def c13_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, E.RECEIPT)


def c14_salary_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, E.SALARY)


def c15_generic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, E.GENERIC)


def c16_family_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.classified(spark, sf_dir).groupBy(
        "document_type", E.family(F.col("document_type")).alias("family")
    ).agg(F.count("*").alias("documents"))


def c17_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.line_item_rows(X.extracted(spark, sf_dir)).select(
        "document_id", "position", "item_number", "description", "quantity", "unit_price", "amount"
    )


def c18_tax_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extracted(spark, sf_dir).filter("taxes.total_tax is not null").select(
        "document_id", F.col("taxes.total_tax").alias("total_tax"), F.col("totals.tax_amount").alias("tax_amount")
    )


def c19_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extracted(spark, sf_dir).groupBy(
        "document_type", F.col("extraction.extracted_fields_count").alias("fields_count")
    ).agg(F.count("*").alias("documents"))


def c20_structured_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.structured_document(X.extracted(spark, sf_dir)).select("document_id", F.to_json("document").alias("document"))


# --- D: validation ------------------------------------------------------------------------
ODD_TEXT = {
    "raw": (
        "CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN concat(chr(9), c_name, chr(160), ' ') WHEN 1 THEN concat('  ', chr(8195)) "
        "WHEN 2 THEN '' WHEN 3 THEN NULL ELSE c_mktsegment END"
    )
}


def d1_normalized_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = ODD_TEXT["raw"].replace("chr(160)", "'\\u00a0'").replace("chr(8195)", "'\\u2003'")
    return with_exprs(read(spark, sf_dir, "customer"), {"raw": raw}).select(
        "c_custkey", text.blank_to_null(F.col("raw")).alias("clean")
    )


_N = "cast(cast(round(l_extendedprice * 100) as bigint) as string)"
AMOUNT_TEXT = {
    "raw": (
        f"CASE CAST((l_orderkey + l_linenumber) % 14 AS INT) WHEN 0 THEN concat('Rs. ', {_N}, '.50') "
        f"WHEN 1 THEN concat('INR ', {_N}) WHEN 2 THEN concat('-', {_N}, '.25') WHEN 3 THEN concat({_N}, '-') "
        f"WHEN 4 THEN concat('1,', {_N}, '.') WHEN 5 THEN concat('.', {_N}) WHEN 6 THEN concat({_N}, '.1.2') "
        f"WHEN 7 THEN 'n/a' WHEN 8 THEN '' WHEN 9 THEN '-' WHEN 10 THEN concat('(', {_N}, ')') "
        f"WHEN 11 THEN concat('Rs ', {_N}, '/-') WHEN 12 THEN NULL ELSE concat({_N}, ' approx 5') END"
    )
}


def d2_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_exprs(read(spark, sf_dir, "lineitem"), AMOUNT_TEXT).groupBy("raw").agg(
        F.count("*").alias("n")
    ).select(
        F.coalesce("raw", F.lit("null")).alias("raw"), "n",
        F.coalesce(values.amount(F.col("raw")), F.lit(-0.5)).alias("amount"),
        F.coalesce(values.amount(F.col("raw"), "strict_currency"), F.lit(-0.5)).alias("strict_amount"),
    )


_Y, _M, _D = "cast(year(o_orderdate) as string)", "cast(month(o_orderdate) as string)", "cast(day(o_orderdate) as string)"
_MON = f"substr('{corpus.MONTHS}', cast(month(o_orderdate) as int) * 3 - 2, 3)"
DATE_TEXT = {
    "raw": (
        f"CASE CAST(o_orderkey % 15 AS INT) WHEN 0 THEN concat({_Y}, '-', {_M}, '-', {_D}) "
        f"WHEN 1 THEN concat({_D}, '/', {_M}, '/', {_Y}) WHEN 2 THEN concat({_D}, '-', {_M}, '-', {_Y}) "
        f"WHEN 3 THEN concat({_D}, ' ', {_MON}, ' ', {_Y}) WHEN 4 THEN concat({_Y}, '/', {_M}, '/', {_D}) "
        f"WHEN 5 THEN concat({_D}, '.', {_M}, '.', {_Y}) WHEN 6 THEN concat('31/2/', {_Y}) "
        f"WHEN 7 THEN concat({_Y}, '-13-01') WHEN 8 THEN concat({_D}, '/', {_M}, '/99') "
        f"WHEN 9 THEN concat('  ', {_D}, ' ', upper({_MON}), ' ', {_Y}, ' ') WHEN 10 THEN 'soon' "
        f"WHEN 11 THEN concat({_D}, ' January ', {_Y}) WHEN 12 THEN concat({_Y}, '-', {_M}, '-', {_D}, ' 10:00') "
        f"WHEN 13 THEN NULL ELSE concat({_D}, ' may ', {_Y}) END"
    )
}


def d3_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_exprs(read(spark, sf_dir, "orders"), DATE_TEXT).select(
        "o_orderkey", values.date(F.col("raw")).cast("string").alias("parsed")
    )


ID_TEXT = {
    "gstin_text": (
        f"CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN concat(' ', {corpus.gstin('c_custkey')}) WHEN 1 THEN lower({corpus.gstin('c_custkey')}) "
        f"WHEN 2 THEN concat({corpus.gstin('c_custkey')}, '0') WHEN 3 THEN NULL WHEN 4 THEN ' ' "
        f"ELSE replace({corpus.gstin('c_custkey')}, 'Z', 'Y') END"
    ),
    "pan_text": (
        f"CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN {corpus.pan('c_custkey')} WHEN 1 THEN lower({corpus.pan('c_custkey')}) "
        f"WHEN 2 THEN substr({corpus.pan('c_custkey')}, 2, 9) WHEN 3 THEN concat({corpus.pan('c_custkey')}, ' x') ELSE NULL END"
    ),
    "ifsc_text": (
        "CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN concat('ABCD0', lpad(cast(c_custkey as string), 6, '0')) "
        "WHEN 1 THEN concat('abcd0', lpad(cast(c_custkey as string), 6, 'x')) "
        "WHEN 2 THEN concat('ABCD1', lpad(cast(c_custkey as string), 6, '0')) ELSE 'ABCD0' END"
    ),
}


def _id_format(spark: SparkSession, sf_dir: str, column: str, pattern: str) -> DataFrame:
    return with_exprs(read(spark, sf_dir, "customer"), ID_TEXT).select(
        "c_custkey", values.has_format(F.col(column), pattern).alias("valid")
    )


def d4_gstin_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id_format(spark, sf_dir, "gstin_text", values.GSTIN_FORMAT)


def d5_pan_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id_format(spark, sf_dir, "pan_text", values.PAN_FORMAT)


def d6_ifsc_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id_format(spark, sf_dir, "ifsc_text", values.IFSC_FORMAT)


RULE_QUERIES = {
    "d7_missing_number": ("VAL_HDR_001",),
    "d8_missing_date": ("VAL_HDR_002",),
    "d9_unreadable_date": ("VAL_HDR_003",),
    "d10_missing_seller_gstin": ("VAL_PRT_001",),
    "d11_malformed_gstin": ("VAL_PRT_002", "VAL_PRT_003"),
    "d12_malformed_pan": ("VAL_PRT_004", "VAL_PRT_005"),
    "d13_missing_items": ("VAL_ITM_001",),
    "d14_unknown_currency": ("VAL_CUR_001",),
    "d16_subtotal_mismatch": ("VAL_MTH_001",),
    "d17_tax_mismatch": ("VAL_MTH_002",),
    "d18_total_mismatch": ("VAL_MTH_003",),
}


def _rule_query(ids: tuple[str, ...]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return V.issue_rows(X.checked(spark, sf_dir)).filter(F.col("rule_id").isin(*ids)).select(
            "document_id", "rule_id", "severity", "field", "message"
        )

    return run


def d15_line_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.typed_values(X.extracted(spark, sf_dir)).select(
        "document_id", F.round("checked.line_sum", 2).alias("line_sum"), F.col("checked.has_line_amounts").alias("any_amount")
    )


def d19_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.checked(spark, sf_dir).select(
        "document_id", "document_type", "is_valid", "status", "error_count", "warning_count",
        F.array_join(F.transform("issues", lambda i: i["rule_id"]), ",").alias("rules"),
    )


def d20_issue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.issue_report(V.issue_rows(X.validated(spark, sf_dir)))


def d21_valid_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.validated(spark, sf_dir).select("document_id", "document_type", V.sink().alias("sink"))


QUERIES = {n: f for n, f in list(globals().items()) if n[:1] in "bcd" and n[1:2].isdigit()}
QUERIES |= {n: _rule_query(ids) for n, ids in RULE_QUERIES.items()}
