"""Field extraction: one projection for all document families."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf import constants as K
from ledgerleaf.functions import text, values
from ledgerleaf.functions.session import once
from ledgerleaf.functions.stages import counted

INVOICE, ORDER, BANK, RECEIPT, SALARY, GENERIC = (
    "invoice", "order", "bank", "receipt", "salary", "generic",
)


@dataclass(frozen=True)
class RowLayout:
    """How a family reads the cells of a table row.

    A cell is read only if the row has more cells than the number given; ``None``
    means never. ``whole_row`` joins all cells to the description.
    """

    quantity_over: int | None = None
    price_over: int | None = None
    amount_over: int | None = None
    whole_row: bool = False


ROW_LAYOUTS = {
    INVOICE: RowLayout(quantity_over=1, price_over=2, amount_over=3),
    ORDER: RowLayout(quantity_over=1, amount_over=2),
    BANK: RowLayout(amount_over=0, whole_row=True),
    SALARY: RowLayout(amount_over=1),
    GENERIC: RowLayout(whole_row=True),
}
_NEVER = 2**31 - 1


def family(document_type: Column) -> Column:
    return (
        F.when(document_type.isin(*K.INVOICE_FAMILY), INVOICE)
        .when(document_type.isin(*K.ORDER_FAMILY), ORDER)
        .when(document_type == K.BANK_STATEMENT, BANK)
        .when(document_type.isin(*K.RECEIPT_FAMILY), RECEIPT)
        .when(document_type == K.SALARY_SLIP, SALARY)
        .otherwise(GENERIC)
    )


def _over(kind: Column, field: str) -> Column:
    limit = None
    for name, layout in ROW_LAYOUTS.items():
        value = getattr(layout, field)
        number = F.lit(_NEVER if value is None else value)
        limit = F.when(kind == name, number) if limit is None else limit.when(kind == name, number)
    return limit.otherwise(_NEVER)


def row_limits(kind: Column) -> dict[str, Column]:
    """The row layout of a family as columns, so that it is looked up once per document."""
    whole = kind.isin(*(n for n, layout in ROW_LAYOUTS.items() if layout.whole_row))
    fields = ("quantity_over", "price_over", "amount_over")
    return {f"_{f}": _over(kind, f) for f in fields} | {"_whole_row": whole, "_has_items": kind != RECEIPT}


def line_items(tables: Column) -> Column:
    """Items of all tables, by the columns of :func:`row_limits`.

    Numbering restarts per table; empty rows are skipped but keep their number.
    """
    c = F.col
    none = F.lit(None).cast("string")

    def item(row: Column, i: Column) -> Column:
        n = F.size(row)
        return F.struct(
            (i + 1).alias("item_number"),
            F.when(c("_whole_row"), F.array_join(row, " | ")).otherwise(F.get(row, F.lit(0))).alias("description"),
            none.alias("hsn_sac"),
            F.when(n > c("_quantity_over"), F.get(row, F.lit(1))).alias("quantity"),
            F.when(n > c("_price_over"), F.get(row, F.lit(2))).alias("unit_price"),
            F.when(n > c("_amount_over"), F.get(row, n - 1)).alias("amount"),
        )

    def items_of(table: Column) -> Column:
        numbered = F.transform(table["rows"], lambda r, i: F.when(F.size(r) > 0, item(r, i)))
        return F.filter(numbered, lambda x: x.isNotNull())

    return F.flatten(F.transform(F.filter(tables, lambda t: c("_has_items")), items_of))


def _pick(kind: Column, branches: dict[str, Column]) -> Column:
    """Value of the branch of this document's family; null for the others."""
    out = None
    for name, value in branches.items():
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out


def _count(*cols: Column) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + text.has_text(c).cast("int")
    return total


@once
def _steps() -> tuple[list[dict[str, Column]], list[str]]:
    """Columns that follow one another, and the names of those that are only steps."""
    c = F.col
    kind = c("_kind")
    body = c("_text")
    base = {"_kind": family(c("document_type")), "_text": text.corpus(c("pages"))}
    limits = row_limits(kind)

    by_lines = kind.isin(INVOICE, ORDER, RECEIPT)
    found = {
        "_cands": F.when(by_lines, text.candidates(text.lines(body))),
        "_gstins": F.when(kind.isin(INVOICE, ORDER, GENERIC), text.mentions(body, text.GSTIN)),
        "_pans": F.when(kind.isin(INVOICE, SALARY, GENERIC), text.mentions(body, text.PAN)),
        "_emails": F.when(kind == GENERIC, text.mentions(body, text.EMAIL)),
        "_phones": F.when(kind == GENERIC, text.mentions(body, text.PHONE)),
        "line_items": line_items(c("tables")),
    }

    def words(keywords) -> Column:
        return text.keyword_value(c("_cands"), keywords, whole_words=True)

    def inside(keywords) -> Column:
        return text.keyword_value(c("_cands"), keywords, whole_words=False)

    fields = {
        "_number": _pick(kind, {INVOICE: words(K.INVOICE_NO_KEYWORDS), ORDER: inside(K.PO_NO_KEYWORDS)}),
        "_stated_date": _pick(
            kind,
            {
                INVOICE: words(K.DATE_KEYWORDS),
                ORDER: inside(K.DATE_KEYWORDS),
                RECEIPT: inside(K.DATE_KEYWORDS),
            },
        ),
        "_due": F.when(kind == INVOICE, words(K.DUE_DATE_KEYWORDS)),
        "_subtotal": F.when(kind == INVOICE, words(K.SUBTOTAL_KEYWORDS)),
        "_total": _pick(
            kind,
            {
                INVOICE: words(K.TOTAL_KEYWORDS),
                ORDER: inside(K.TOTAL_KEYWORDS),
                RECEIPT: inside(K.TOTAL_KEYWORDS),
            },
        ),
        "_cgst": F.when(kind == INVOICE, words(("CGST",))),
        "_sgst": F.when(kind == INVOICE, words(("SGST",))),
        "_igst": F.when(kind == INVOICE, words(("IGST",))),
    }
    # The date mentions are a regular expression over the whole text: only the
    # generic family and invoices without a stated date pay for it.
    wants_dates = (kind == GENERIC) | ((kind == INVOICE) & c("_stated_date").isNull())
    dated = {"_dates": F.when(wants_dates, text.mentions(body, text.DATE))}
    parts = [c("_cgst"), c("_sgst"), c("_igst")]
    any_part = F.coalesce(*parts).isNotNull()
    summed = {
        "_date": F.coalesce("_stated_date", text.nth(c("_dates"), 0)),
        "_tax": F.when(
            any_part,
            values.two_decimals(sum((values.tax_part(p) for p in parts), F.lit(0.0))),
        ),
    }

    none = F.lit(None).cast("string")
    items = F.size("line_items")
    size = lambda name: F.coalesce(F.size(c(name)), F.lit(0))
    fields_count = _pick(
        kind,
        {
            INVOICE: items + _count(
                c("_number"), c("_date"), c("_subtotal"), c("_total"), *parts, c("_tax")
            ),
            ORDER: items + _count(c("_number"), c("_date"), c("_total")),
            BANK: items,
            RECEIPT: _count(c("_date"), c("_total")),
            SALARY: items + F.least(size("_pans"), F.lit(1)),
            GENERIC: items + F.greatest(size("_gstins"), F.lit(0)) + F.greatest(size("_dates"), F.lit(0)),
        },
    )
    second = kind == INVOICE
    done = {
        "header": F.struct(
            c("_number").alias("document_number"),
            c("_date").alias("document_date"),
            c("_due").alias("due_date"),
            none.alias("reference_number"),
            none.alias("place_of_supply"),
        ),
        "seller": F.struct(
            none.alias("name"),
            text.nth(c("_gstins"), 0).alias("gstin"),
            text.nth(c("_pans"), 0).alias("pan"),
            none.alias("address"),
            text.nth(c("_emails"), 0).alias("email"),
            text.nth(c("_phones"), 0).alias("phone"),
        ),
        "buyer": F.struct(
            none.alias("name"),
            F.when(second, text.nth(c("_gstins"), 1)).alias("gstin"),
            F.when(second, text.nth(c("_pans"), 1)).alias("pan"),
            none.alias("address"),
            none.alias("email"),
            none.alias("phone"),
        ),
        "taxes": F.struct(
            c("_cgst").alias("cgst"),
            c("_sgst").alias("sgst"),
            c("_igst").alias("igst"),
            c("_tax").alias("total_tax"),
        ),
        "payment": F.struct(
            none.alias("mode"), none.alias("bank_account"),
            none.alias("ifsc_code"), none.alias("transaction_id"),
        ),
        "totals": F.struct(
            c("_subtotal").alias("subtotal"),
            c("_tax").alias("tax_amount"),
            c("_total").alias("grand_total"),
            F.lit(K.DEFAULT_CURRENCY).alias("currency"),
        ),
        "additional_fields": F.create_map().cast("map<string,string>"),
        "extraction": F.struct(
            c("document_type").alias("document_type"),
            fields_count.alias("extracted_fields_count"),
            F.size("tables").alias("tables_extracted"),
        ),
    }
    passing = [
        *limits, "_kind", "_text", "_cands", "_gstins", "_pans", "_emails", "_phones", "_dates", "_number",
        "_stated_date", "_date", "_due", "_subtotal", "_total", "_cgst", "_sgst", "_igst", "_tax",
    ]
    return [base, limits, found, fields, dated, summed, done], passing


def extract(df: DataFrame) -> DataFrame:
    """Add the structured-document columns to classified documents.

    Needs ``pages``, ``tables`` and ``document_type``. Adds ``header``, ``seller``,
    ``buyer``, ``line_items``, ``taxes``, ``payment``, ``totals``,
    ``additional_fields`` and ``extraction``. Regular expressions run only in the
    branches of the families that need them. Narrow: no shuffle.
    """
    steps, passing = _steps()
    for step in steps:
        df = df.withColumns(step)
    return counted(df.drop(*passing), "extract")


def structured_document(df: DataFrame) -> DataFrame:
    """Nest the extracted columns to one ``document`` struct per document."""
    return df.select(
        "document_id",
        F.struct(
            "document_id", "header", "seller", "buyer", "line_items", "taxes", "payment",
            "totals", "additional_fields", F.col("extraction").alias("metadata"),
        ).alias("document"),
    )


def line_item_rows(df: DataFrame) -> DataFrame:
    """Long line-item table of extracted documents."""
    keys = [k for k in ("workspace_id", "document_id", "document_type") if k in df.columns]
    return df.select(*keys, F.posexplode("line_items").alias("position", "item")).select(
        *keys, "position", "item.*"
    )
