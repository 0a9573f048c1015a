"""Classification, extraction, validation."""

import pytest
from helpers import GOLDEN, parsed
from pyspark.sql import functions as F

from ledgerleaf.operators import validate as V
from ledgerleaf.operators.classify import classify
from ledgerleaf.operators.extract import extract, structured_document
from ledgerleaf.rules import Rule


def classes(df, rules=None):
    return {r.document_id: r for r in classify(df, rules).collect()}


def test_classification_vetoes_threshold_and_ties(spark):
    got = classes(
        parsed(
            spark,
            ("po", "Purchase Order\nOrder date"),
            ("po-inv", "Purchase order for invoice 7"),
            ("weak", "please pay the charges"),
            ("none", "hello"),
            ("headers", "x", [["1"]], ["Item Description", "Unit Price", "Total"]),
            ("quoted", "we quoted him"),
        )
    )
    assert (got["po"].document_type, got["po"].confidence) == ("Purchase Order", 0.55)
    assert got["po"].matched_rules == ["Primary: 'PURCHASE ORDER'", "Secondary: 'ORDER DATE'"]
    assert got["po-inv"].document_type == "Unknown Document" and got["po-inv"].confidence == 0.0
    assert got["weak"].document_type == "Unknown Document"
    assert got["weak"].reason == "Confidence score (0.15) was below minimum threshold (0.35)."
    assert got["weak"].matched_rules == ["Secondary: 'CHARGES'"]
    assert got["none"].matched_rules == []
    # 3 x 0.2 for both invoice rules: the one that comes first wins.
    assert got["headers"].document_type == "Sales Invoice" and got["headers"].confidence == 0.6
    assert got["quoted"].document_type == "Quotation"


def test_user_rules_in_slices(spark, monkeypatch):
    import ledgerleaf.operators.classify as C

    monkeypatch.setattr(C, "RULES_PER_PASS", 2)
    rules = [Rule(f"T{i}", primary=(f"W{i}",)) for i in range(5)] + [Rule("T0b", primary=("W0",))]
    got = classes(parsed(spark, ("a", "w4 and w3"), ("b", "w0"), ("c", "w9")), rules)
    assert {k: r.document_type for k, r in got.items()} == {"a": "T3", "b": "T0", "c": "Unknown Document"}
    table = spark.createDataFrame(
        [(i, r.doc_type, list(r.primary), [], [], []) for i, r in enumerate(rules)],
        "rule_no int, doc_type string, primary array<string>, secondary array<string>, headers array<string>, negative array<string>",
    )
    again = classes(parsed(spark, ("a", "w4 and w3"), ("b", "w0")), table)
    assert again["a"].document_type == "T3" and again["b"].document_type == "T0"


def test_golden_invoice(spark):
    doc = parsed(spark, ("g", GOLDEN)).withColumn("document_type", F.lit("Sales Invoice"))
    r = extract(doc).first()
    assert (r.totals.subtotal, r.totals.grand_total, r.totals.tax_amount) == ("102000.00", "120360.00", "18360.00")
    assert (r.taxes.cgst, r.taxes.sgst, r.taxes.igst, r.taxes.total_tax) == ("9180.00", "9180.00", None, "18360.00")
    assert r.header.document_number == "INV-2026-001"
    nested = structured_document(extract(doc)).first().document
    assert nested.metadata.document_type == "Sales Invoice"


ROWS = [["a", "1", "2", "3"], ["b", "1", "2"], [], ["c"]]


@pytest.mark.parametrize(
    "kind, expected",
    [
        ("Credit Note", [(1, "a", "1", "2", "3"), (2, "b", "1", "2", None), (4, "c", None, None, None)]),
        ("Quotation", [(1, "a", "1", None, "3"), (2, "b", "1", None, "2"), (4, "c", None, None, None)]),
        ("Bank Statement", [(1, "a | 1 | 2 | 3", None, None, "3"), (2, "b | 1 | 2", None, None, "2"), (4, "c", None, None, "c")]),
        ("Salary Slip", [(1, "a", None, None, "3"), (2, "b", None, None, "2"), (4, "c", None, None, None)]),
        ("GST Return", [(1, "a | 1 | 2 | 3", None, None, None), (2, "b | 1 | 2", None, None, None), (4, "c", None, None, None)]),
        ("Receipt", []),
    ],
)
def test_line_items_by_family(spark, kind, expected):
    doc = parsed(spark, ("d", "x", ROWS)).withColumn("document_type", F.lit(kind))
    items = extract(doc).first().line_items
    assert [(i.item_number, i.description, i.quantity, i.unit_price, i.amount) for i in items] == expected


def issues(spark, body, rows=(), kind="Sales Invoice", **fields):
    doc = parsed(spark, ("d", body, list(rows))).withColumn("document_type", F.lit(kind))
    df = extract(doc)
    for path, value in fields.items():
        column, field = path.split("__")
        df = df.withColumn(column, F.col(column).withField(field, F.lit(value)))
    r = V.validate(df).first()
    return r, {i.rule_id for i in r.issues}


def test_each_rule_fires_and_a_clean_document_passes(spark):
    item = [["part", "1", "102000", "102000.00"]]
    gstin = {"seller__gstin": "27ABCDE1234F1Z5"}
    r, found = issues(spark, GOLDEN, item, **gstin)
    assert (found, r.status, r.is_valid) == (set(), "VALID", True)
    assert issues(spark, GOLDEN, item)[1] == {"VAL_PRT_001"}
    assert issues(spark, GOLDEN, **gstin)[1] == {"VAL_ITM_001"}
    assert issues(spark, GOLDEN, item, seller__gstin="bad", buyer__gstin="bad")[1] == {"VAL_PRT_002", "VAL_PRT_003"}
    assert issues(spark, GOLDEN, item, seller__pan="x", buyer__pan="y", **gstin)[1] == {"VAL_PRT_004", "VAL_PRT_005"}
    assert issues(spark, GOLDEN, item, totals__currency="XYZ", **gstin)[1] == {"VAL_CUR_001"}
    assert issues(spark, GOLDEN, item, header__document_number=" ", **gstin)[1] == {"VAL_HDR_001"}
    assert issues(spark, GOLDEN, item, header__document_date=None, **gstin)[1] == {"VAL_HDR_002"}
    assert issues(spark, GOLDEN, item, header__document_date="soon", **gstin)[1] == {"VAL_HDR_003"}
    assert issues(spark, GOLDEN, [["p", "1", "2", "5"]], **gstin)[1] == {"VAL_MTH_001"}
    r, found = issues(spark, GOLDEN, item, totals__tax_amount="18360.10", **gstin)
    assert found == {"VAL_MTH_002", "VAL_MTH_003"} and r.status == "INVALID"
    assert "(120360.00) does not equal Subtotal + Taxes (120360.10)" in r.issues[-1].message
    assert issues(spark, GOLDEN, item, totals__tax_amount="18360.04", **gstin)[1] == set()
    assert issues(spark, "x", item, kind="Salary Slip")[1] == set()


def test_filters_on_verdicts_do_not_repeat_the_work(spark):
    df = V.validate(extract(classify(parsed(spark, ("g", GOLDEN))))).filter("is_valid").select("document_id")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    first = next(line for line in plan.splitlines() if "Filter" in line)
    assert "is_valid" in first and len(first) < 200
