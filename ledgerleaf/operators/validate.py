"""Validation rules over extracted documents, as one narrow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf import constants as K
from ledgerleaf.functions import text, values
from ledgerleaf.functions.session import once
from ledgerleaf.functions.stages import counted

ERROR, WARNING = "ERROR", "WARNING"


def _issue(when: Column, rule_id: str, severity: str, field: str, *message: Column | str) -> Column:
    parts = [F.lit(m) if isinstance(m, str) else m for m in message]
    return F.when(
        F.coalesce(when, F.lit(False)),
        F.struct(
            F.lit(rule_id).alias("rule_id"),
            F.lit(severity).alias("severity"),
            F.lit(field).alias("field"),
            F.concat(*parts).alias("message"),
        ),
    )


def _typed_steps(amount_mode: str) -> list[dict[str, Column]]:
    """Columns that follow one another up to ``checked``."""
    def money(name: str) -> Column:
        return values.amount(F.col(name), amount_mode)

    amounts = F.transform("line_items", lambda x: values.amount(x["amount"], amount_mode))
    first = {
        "_amounts": F.filter(amounts, lambda a: a.isNotNull()),
        "_typed": F.struct(
            text.blank_to_null(F.col("header.document_number")).alias("number"),
            text.blank_to_null(F.col("header.document_date")).alias("date_text"),
            values.date(F.col("header.document_date")).alias("document_dt"),
            text.blank_to_null(F.col("seller.gstin")).alias("seller_gstin"),
            text.blank_to_null(F.col("buyer.gstin")).alias("buyer_gstin"),
            text.blank_to_null(F.col("seller.pan")).alias("seller_pan"),
            text.blank_to_null(F.col("buyer.pan")).alias("buyer_pan"),
            text.blank_to_null(F.col("totals.currency")).alias("currency"),
            money("totals.subtotal").alias("subtotal_amt"),
            money("totals.tax_amount").alias("tax_amt"),
            money("totals.grand_total").alias("total_amt"),
            F.coalesce(money("taxes.cgst"), F.lit(0.0)).alias("cgst_amt"),
            F.coalesce(money("taxes.sgst"), F.lit(0.0)).alias("sgst_amt"),
            F.coalesce(money("taxes.igst"), F.lit(0.0)).alias("igst_amt"),
        ),
    }
    t = F.col("_typed")
    # Folded in item order, so that the float result does not depend on the plan.
    line_sum = F.aggregate("_amounts", F.lit(0.0), lambda acc, a: acc + a)
    second = {
        "_typed": F.struct(
            "_typed.*",
            line_sum.alias("line_sum"),
            (F.size("_amounts") > 0).alias("has_line_amounts"),
            (t["cgst_amt"] + t["sgst_amt"] + t["igst_amt"]).alias("tax_sum"),
        ),
    }
    subtotal = F.coalesce(t["subtotal_amt"], t["line_sum"])
    tax = F.coalesce(t["tax_amt"], t["tax_sum"])
    third = {
        "checked": F.struct(
            "_typed.*",
            subtotal.alias("effective_subtotal"),
            tax.alias("effective_tax"),
            (subtotal + tax).alias("expected_total"),
        ),
    }
    return [first, second, third]


@once
def _plain_steps() -> list[dict[str, Column]]:
    return _typed_steps("plain")


def typed_values(df: DataFrame, amount_mode: str = "plain") -> DataFrame:
    """Add ``checked``: the cleaned and typed values that the rules compare."""
    for step in _plain_steps() if amount_mode == "plain" else _typed_steps(amount_mode):
        df = df.withColumns(step)
    return df.drop("_typed", "_amounts")


def _rules(kind: Column, v: Column, item_count: Column) -> list[Column]:
    """All rules in report order. Ids, fields and messages are fixed values."""
    two = values.two_decimals
    header_needed = kind.isin(*K.HEADER_REQUIRED)
    off = lambda a, b: F.abs(a - b) > K.AMOUNT_TOLERANCE
    bad = lambda name, fmt: v[name].isNotNull() & ~values.has_format(v[name], fmt)
    return [
        _issue(
            header_needed & v["number"].isNull(),
            "VAL_HDR_001", ERROR, "header.document_number",
            "Document number is missing or blank.",
        ),
        _issue(
            header_needed & v["date_text"].isNull(),
            "VAL_HDR_002", ERROR, "header.document_date",
            "Document issuance date is missing or invalid.",
        ),
        _issue(
            header_needed & v["date_text"].isNotNull() & v["document_dt"].isNull(),
            "VAL_HDR_003", WARNING, "header.document_date",
            "Document date '", v["date_text"], "' is not in a recognized date format.",
        ),
        _issue(
            kind.isin(*K.TAX_REQUIRED) & v["seller_gstin"].isNull(),
            "VAL_PRT_001", WARNING, "seller.gstin",
            "Seller GSTIN is required for ", kind, " but missing.",
        ),
        _issue(
            bad("seller_gstin", values.GSTIN_FORMAT),
            "VAL_PRT_002", ERROR, "seller.gstin",
            "Seller GSTIN '", v["seller_gstin"], "' is invalid.",
        ),
        _issue(
            bad("buyer_gstin", values.GSTIN_FORMAT),
            "VAL_PRT_003", ERROR, "buyer.gstin",
            "Buyer GSTIN '", v["buyer_gstin"], "' is invalid.",
        ),
        _issue(
            bad("seller_pan", values.PAN_FORMAT),
            "VAL_PRT_004", WARNING, "seller.pan",
            "Seller PAN '", v["seller_pan"], "' is invalid.",
        ),
        _issue(
            bad("buyer_pan", values.PAN_FORMAT),
            "VAL_PRT_005", WARNING, "buyer.pan",
            "Buyer PAN '", v["buyer_pan"], "' is invalid.",
        ),
        _issue(
            kind.isin(*K.INVOICE_FAMILY) & (item_count == 0),
            "VAL_ITM_001", ERROR, "line_items",
            "At least one line item is required for ", kind, ".",
        ),
        _issue(
            ~F.upper(v["currency"]).isin(*K.SUPPORTED_CURRENCIES),
            "VAL_CUR_001", WARNING, "totals.currency",
            "Unrecognized or unsupported currency code '", v["currency"], "'.",
        ),
        _issue(
            v["has_line_amounts"] & off(v["line_sum"], v["subtotal_amt"]),
            "VAL_MTH_001", WARNING, "totals.subtotal",
            "Subtotal mismatch: Calculated line items sum (", two(v["line_sum"]),
            ") does not equal stated subtotal (", two(v["subtotal_amt"]), ").",
        ),
        _issue(
            (F.greatest(v["cgst_amt"], v["sgst_amt"], v["igst_amt"]) > 0)
            & off(v["tax_sum"], v["tax_amt"]),
            "VAL_MTH_002", WARNING, "totals.tax_amount",
            "Tax total mismatch: Calculated sum of CGST/SGST/IGST (", two(v["tax_sum"]),
            ") does not equal stated tax amount (", two(v["tax_amt"]), ").",
        ),
        _issue(
            ((v["effective_subtotal"] > 0) | (v["effective_tax"] > 0))
            & off(v["expected_total"], v["total_amt"]),
            "VAL_MTH_003", ERROR, "totals.grand_total",
            "Grand total mismatch: Stated total (", two(v["total_amt"]),
            ") does not equal Subtotal + Taxes (", two(v["expected_total"]), ").",
        ),
    ]


@once
def _verdict() -> list[dict[str, Column]]:
    rules = _rules(F.col("document_type"), F.col("checked"), F.size("line_items"))

    def count(severity: str) -> Column:
        return F.size(F.filter("issues", lambda i: i["severity"] == severity))

    return [
        {"issues": F.array_compact(F.array(*rules))},
        {"error_count": count(ERROR), "warning_count": count(WARNING)},
        {
            "is_valid": F.col("error_count") == 0,
            "status": F.when(F.col("error_count") > 0, "INVALID")
            .when(F.col("warning_count") > 0, "VALID_WITH_WARNINGS")
            .otherwise("VALID"),
        },
    ]


def validate(df: DataFrame, amount_mode: str = "plain") -> DataFrame:
    """Add issues, counts, is_valid and status to extracted documents; edits nothing."""
    done = typed_values(df, amount_mode)
    for step in _verdict():
        done = done.withColumns(step)
    return counted(done, "validate", valid=F.col("is_valid"))


def issue_rows(df: DataFrame) -> DataFrame:
    """Long issue table of validated documents."""
    keys = [k for k in ("workspace_id", "document_id", "document_type") if k in df.columns]
    return df.select(*keys, F.posexplode("issues").alias("issue_no", "issue")).select(
        *keys, (F.col("issue_no") + 1).alias("issue_no"), "issue.*"
    )


def sink() -> Column:
    """Where a validated document goes: ``chunking`` or ``stopped``."""
    return F.when(F.col("is_valid"), "chunking").otherwise("stopped")


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that may go on to chunking, and those that stop here."""
    return df.filter("is_valid"), df.filter(~F.col("is_valid"))
