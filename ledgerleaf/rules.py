"""Built-in classification rules, in evaluation order."""

from __future__ import annotations

from dataclasses import dataclass

from ledgerleaf import constants as K


@dataclass(frozen=True)
class Rule:
    doc_type: str
    primary: tuple[str, ...] = ()
    secondary: tuple[str, ...] = ()
    headers: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()


# The order decides ties, the words decide the score.
BUILTIN_RULES = (
    Rule(
        K.GST_INVOICE,
        primary=("TAX INVOICE", "GST INVOICE", "GSTIN", "CGST", "SGST", "IGST"),
        secondary=("HSN/SAC", "HSN CODE", "BILL TO", "SHIP TO", "TAXABLE VALUE", "PLACE OF SUPPLY"),
        headers=("HSN", "SAC", "RATE", "TAXABLE VALUE", "CGST", "SGST", "IGST"),
    ),
    Rule(
        K.SALES_INVOICE,
        primary=("SALES INVOICE", "INVOICE", "BILL OF SUPPLY"),
        secondary=("INVOICE NUMBER", "INVOICE DATE", "DUE DATE", "BILL TO", "TOTAL AMOUNT"),
        headers=("ITEM", "DESCRIPTION", "QUANTITY", "QTY", "PRICE", "AMOUNT"),
        negative=("PURCHASE ORDER", "BANK STATEMENT"),
    ),
    Rule(
        K.PURCHASE_INVOICE,
        primary=("PURCHASE INVOICE", "VENDOR INVOICE", "SUPPLIER INVOICE"),
        secondary=("VENDOR GSTIN", "PO NUMBER", "BILLING ADDRESS", "PAYMENT TERMS"),
        headers=("ITEM DESCRIPTION", "UNIT PRICE", "TOTAL"),
    ),
    Rule(
        K.PURCHASE_ORDER,
        primary=("PURCHASE ORDER", "PO NUMBER", "P.O. NO"),
        secondary=("ORDER DATE", "DELIVERY DATE", "VENDOR NAME", "SHIP TO ADDRESS", "TERMS & CONDITIONS"),
        headers=("ITEM CODE", "QTY ORDERED", "UNIT PRICE", "NET AMOUNT"),
        negative=("INVOICE",),
    ),
    Rule(
        K.QUOTATION,
        primary=("QUOTATION", "PROFORMA INVOICE", "QUOTE", "ESTIMATE"),
        secondary=("VALID UNTIL", "QUOTE NUMBER", "PROPOSAL", "TERMS OF PAYMENT"),
        headers=("SPECIFICATION", "UNIT RATE", "TOTAL ESTIMATE"),
    ),
    Rule(
        K.SALES_ORDER,
        primary=("SALES ORDER", "SO NUMBER", "ORDER CONFIRMATION"),
        secondary=("CUSTOMER PO", "BOOKING DATE", "DISPATCH THROUGH"),
        headers=("ORDERED QTY", "RATE", "AMOUNT"),
    ),
    Rule(
        K.CREDIT_NOTE,
        primary=("CREDIT NOTE", "CREDIT MEMO"),
        secondary=("ORIGINAL INVOICE NO", "REASON FOR CREDIT", "ADJUSTMENT AMOUNT"),
        negative=("DEBIT NOTE",),
    ),
    Rule(
        K.DEBIT_NOTE,
        primary=("DEBIT NOTE", "DEBIT MEMO"),
        secondary=("ORIGINAL INVOICE NO", "REASON FOR DEBIT", "CHARGES"),
        negative=("CREDIT NOTE",),
    ),
    Rule(
        K.DELIVERY_CHALLAN,
        primary=("DELIVERY CHALLAN", "DISPATCH CHALLAN", "WAYBILL"),
        secondary=("VEHICLE NO", "DRIVER NAME", "MODE OF TRANSPORT", "NOT FOR SALE"),
        headers=("DISPATCHED QTY", "PACKAGES"),
    ),
    Rule(
        K.GOODS_RECEIPT_NOTE,
        primary=("GOODS RECEIPT NOTE", "GRN", "MATERIAL RECEIPT"),
        secondary=("RECEIVED BY", "INSPECTED BY", "PO REF", "ACCEPTED QTY", "REJECTED QTY"),
    ),
    Rule(
        K.RECEIPT,
        primary=("RECEIPT", "PAYMENT RECEIPT", "MONEY RECEIPT"),
        secondary=("RECEIVED WITH THANKS", "MODE OF PAYMENT", "CHEQUE NO", "TRANSACTION ID"),
    ),
    Rule(
        K.PAYMENT_VOUCHER,
        primary=("PAYMENT VOUCHER", "DEBIT VOUCHER"),
        secondary=("PAID TO", "BEING THE PAYMENT OF", "ACCOUNT HEAD", "APPROVED BY"),
    ),
    Rule(
        K.EXPENSE_BILL,
        primary=("EXPENSE BILL", "PETTY CASH VOUCHER", "REIMBURSEMENT"),
        secondary=("EMPLOYEE NAME", "EXPENSE TYPE", "CLAIM AMOUNT"),
    ),
    Rule(
        K.BANK_STATEMENT,
        primary=("BANK STATEMENT", "STATEMENT OF ACCOUNT", "ACCOUNT STATEMENT"),
        secondary=("ACCOUNT NUMBER", "IFS CODE", "OPENING BALANCE", "CLOSING BALANCE", "WITHDRAWAL", "DEPOSIT"),
        headers=("DATE", "PARTICULARS", "CHQ NO", "WITHDRAWAL", "DEPOSIT", "BALANCE"),
    ),
    Rule(
        K.GST_RETURN,
        primary=("GSTR-1", "GSTR-3B", "GST RETURN", "ACKNOWLEDGEMENT NUMBER"),
        secondary=("TAX PERIOD", "ARN", "FILED DATE", "TURNOVER"),
    ),
    Rule(
        K.SALARY_SLIP,
        primary=("SALARY SLIP", "PAYSLIP", "PAY SLIP"),
        secondary=("EMPLOYEE ID", "DESIGNATION", "PAN NUMBER", "BASIC SALARY", "PF NO", "NET PAY", "GROSS EARNINGS"),
        headers=("EARNINGS", "DEDUCTIONS", "AMOUNT"),
    ),
)
