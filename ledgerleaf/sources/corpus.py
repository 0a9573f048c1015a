"""Business documents made from order tables, for tests, benchmarks and demos.

One document per order, of one of 17 kinds, with planted faults. The texts are plain
SQL expressions that more than one engine can run, so a checker can make the same
documents and compare what the operators read from them with the source numbers.

An order with line numbers above ``MAX_LINES`` is issued as several documents: the line
number alone says which, so the outcome doesn't depend on the layout of the files, and
no count over the lines is needed. Ids of later parts name the part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf import schemas
from ledgerleaf.functions.stages import counted

MAX_LINES = 1000
PART = f"cast(floor((l_linenumber - 1) / {MAX_LINES}) as int)"
PART_SUFFIX = "CASE WHEN part > 0 THEN concat('-', cast(part as string)) ELSE '' END"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def _letter(k: str) -> str:
    return f"substr('{LETTERS}', cast(({k}) % 26 as int) + 1, 1)"


def pan(k: str) -> str:
    letters = ", ".join(_letter(f"{k} * {m} + {a}") for m, a in ((1, 0), (3, 7), (5, 1), (7, 3), (11, 5)))
    return f"concat({letters}, lpad(cast({k} % 10000 as string), 4, '0'), {_letter(f'{k} * 17')})"


def gstin(k: str) -> str:
    return (
        f"concat(cast(10 + {k} % 28 as string), {pan(k)}, cast(1 + {k} % 9 as string), 'Z', "
        f"cast({k} % 10 as string))"
    )


def _whole(cents: str) -> str:
    return f"cast(floor({cents} / 100) as bigint)"


def money(cents: str) -> str:
    """Two decimals; a comma before the last three digits of the whole part."""
    whole = _whole(cents)
    fraction = f"lpad(cast({cents} % 100 as string), 2, '0')"
    thousands = f"cast(cast(floor({cents} / 100000) as bigint) as string)"
    return (
        f"CASE WHEN {cents} >= 100000 THEN concat({thousands}, ',', lpad(cast({whole} % 1000 as string), 3, '0'), '.', {fraction}) "
        f"ELSE concat(cast({whole} as string), '.', {fraction}) END"
    )


def plain_money(cents: str) -> str:
    return f"concat(cast({_whole(cents)} as string), '.', lpad(cast({cents} % 100 as string), 2, '0'))"


# One line of an order: its cents and its table row.
LINE_COLUMNS = {
    "cents": "cast(round(l_extendedprice * 100) as bigint)",
    "units": "cast(l_quantity as bigint)",
}
CELLS = (
    "concat('Part ', cast(l_partkey as string))",
    "cast(units as string)",
    plain_money("cast(floor(cents / units) as bigint)"),
    money("cents"),
)
SHORT_ROW = "l_linenumber = 5 AND l_returnflag = 'R'"  # three cells
EMPTY_ROW = "l_linenumber = 6 AND l_returnflag = 'R'"  # no cell
LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus",
)

# Columns of a document, from: key, part, custkey, orderdate, status, subtotal_cents, n_lines.
_DAY = "lpad(cast(day(orderdate) as string), 2, '0')"
_MONTH = "lpad(cast(month(orderdate) as string), 2, '0')"
_YEAR = "cast(year(orderdate) as string)"
_SHORT_MONTH = f"substr('{MONTHS}', cast(month(orderdate) as int) * 3 - 2, 3)"
DOCUMENT_COLUMNS = {
    "document_id": (
        "concat('doc-', lpad(cast(key as string), 12, '0'), "
        "CASE WHEN part > 0 THEN concat('-', cast(part as string)) ELSE '' END)"
    ),
    "workspace_id": "concat('ws-', lpad(cast(custkey % 20 as string), 2, '0'))",
    "kind": "cast(key % 17 as int)",
    "doc_no": "CASE WHEN key % 11 = 3 THEN NULL ELSE concat('N', lpad(cast(key as string), 9, '0')) END",
    "doc_date": (
        "CASE WHEN key % 13 = 5 THEN 'to be agreed' WHEN key % 13 = 6 THEN NULL "
        f"WHEN key % 7 = 0 THEN concat({_YEAR}, '/', {_MONTH}, '/', {_DAY}) "
        f"WHEN key % 7 = 1 THEN concat({_DAY}, '/', {_MONTH}, '/', {_YEAR}) "
        f"WHEN key % 7 = 2 THEN concat({_DAY}, '.', {_MONTH}, '.', {_YEAR}) "
        f"WHEN key % 7 = 3 THEN concat({_DAY}, ' ', {_SHORT_MONTH}, ' ', {_YEAR}) "
        f"ELSE concat({_YEAR}, '-', {_MONTH}, '-', {_DAY}) END"
    ),
    "seller_gstin": f"CASE WHEN key % 9 = 2 THEN NULL ELSE {gstin('(custkey * 7 + 3)')} END",
    "buyer_gstin": f"CASE WHEN key % 4 = 1 THEN NULL ELSE {gstin('(custkey * 13 + 5)')} END",
    "seller_pan": f"CASE WHEN key % 5 = 1 THEN NULL ELSE {pan('(custkey * 7 + 3)')} END",
    "tax_cents": "cast(floor(subtotal_cents * 9 / 100) as bigint)",
    "total_fault": "CASE WHEN key % 19 = 4 THEN 100 ELSE 0 END",
    "mark": "CASE WHEN key % 31 = 2 THEN 'Rs. ' WHEN key % 31 = 3 THEN 'INR ' ELSE '' END",
    "line_end": "CASE WHEN key % 29 = 1 THEN concat(chr(13), chr(10)) ELSE chr(10) END",
    "sub_text": money("subtotal_cents"),
    "tax_text": money("tax_cents"),
    "igst_text": money("(2 * tax_cents)"),
    "total_text": f"mark || ({money('(subtotal_cents + 2 * tax_cents + total_fault)')})",
    "net_text": f"mark || ({money('(subtotal_cents + total_fault)')})",
    "issued_on": f"concat('Issued on ', {_DAY}, '-', {_MONTH}, '-', {_YEAR})",
    "year_end": f"concat({_YEAR}, '-12-31')",
    "contact": (
        "concat('Contact user', cast(custkey as string), '@mail.example.com or +91 ', "
        "lpad(cast(custkey % 1000 as string), 3, '2'), '-555-', lpad(cast(key % 10000 as string), 4, '0'))"
    ),
    "no_table": "key % 23 = 7 OR kind IN (9, 10, 11, 13, 14, 15)",
}


def _line(label: str, *parts: str) -> str:
    """A labelled line; null when a part is null."""
    return f"('{label}' || " + " || ".join(f"({p})" for p in parts) + ")"


_NO = lambda label: _line(label, "doc_no")
_DATE = _line("DATE: ", "doc_date")
_SELLER = [_line("SELLER GSTIN: ", "seller_gstin"), _line("SELLER PAN: ", "seller_pan")]
_BUYER = [_line("BUYER GSTIN: ", "buyer_gstin")]
_SUB = _line("SUBTOTAL: ", "mark", "sub_text")
_CGST = _line("CGST: ", "tax_text")
_SGST = _line("SGST = ", "tax_text")
_IGST = _line("IGST: ", "igst_text")
_TOTAL = _line("TOTAL: ", "total_text")
_NET = _line("Net Amount - ", "net_text")
_MAIL, _ON = "contact", "issued_on"

# Kind number -> (lines of the first half, lines of the second half, table headers).
KINDS = (
    (["'TAX INVOICE'", _NO("Invoice No: "), _DATE, *_SELLER, *_BUYER, "'Place of Supply: KA'"], [_SUB, _CGST, _SGST, _TOTAL], ("Description", "HSN", "Rate", "Amount")),
    (["'SALES INVOICE'", _NO("INVOICE NUMBER: "), _DATE, _line("DUE DATE: ", "year_end"), *_BUYER], [_SUB, _IGST, _TOTAL], ("Item", "Qty", "Price", "Amount")),
    (["'PURCHASE INVOICE'", "'VENDOR INVOICE'", _NO("BILL NO: "), _DATE, "'PAYMENT TERMS net 30'", _line("Vendor ", "seller_gstin")], [_SUB, _TOTAL], ("Item Description", "Qty", "Unit Price", "Total")),
    (["'PURCHASE ORDER'", _NO("PO NUMBER: "), _DATE, "'Delivery Date as agreed'", _line("Vendor Name / ", "seller_gstin")], [_NET], ("Item Code", "Qty Ordered", "Unit Price", "Net Amount")),
    (["'QUOTATION'", _NO("QUOTE NUMBER: "), _NO("Our PO NO: "), _line("Valid Until: ", "doc_date"), *_SELLER[:1]], [_NET], ("Specification", "Units", "Unit Rate", "Total Estimate")),
    (["'SALES ORDER'", "'ORDER CONFIRMATION'", _NO("SO NUMBER / PO REF = "), _line("BOOKING DATE: ", "doc_date")], [_TOTAL], ("Part", "Ordered Qty", "Rate", "Amount")),
    (["'CREDIT NOTE'", "'CREDIT MEMO'", _NO("Original Invoice No: "), _DATE, "'REASON FOR CREDIT: damaged'", *_SELLER], [_SUB, _CGST, _SGST, _TOTAL], ("Part", "Units", "Each", "Value")),
    (["'DEBIT NOTE'", "'DEBIT MEMO'", _NO("Bill No - "), _DATE, "'REASON FOR DEBIT: short paid'", *_BUYER], [_SUB, _TOTAL], ("Part", "Units", "Each", "Value")),
    (["'BANK STATEMENT'", "'ACCOUNT NUMBER 00112233'", "'OPENING BALANCE 0.00'", _ON], ["'CLOSING BALANCE 0.00'"], ("Date", "Particulars", "Withdrawal", "Balance")),
    (["'PAYMENT RECEIPT'", "'RECEIVED WITH THANKS'", _DATE, _NO("CHEQUE NO ")], [_TOTAL], ()),
    (["'PAYMENT VOUCHER'", "'DEBIT VOUCHER'", "'PAID TO bearer'", _DATE], [_line("Grand Total = ", "sub_text")], ()),
    (["'EXPENSE BILL'", "'REIMBURSEMENT'", "'EMPLOYEE NAME: A. Person'", _line("Bill date ", "doc_date")], [_line("CLAIM AMOUNT TOTAL: ", "sub_text")], ()),
    (["'SALARY SLIP'", "'PAYSLIP'", "'EMPLOYEE ID 7'", _line("PAN NUMBER ", "seller_pan"), "'BASIC SALARY'"], ["'NET PAY'"], ("Earnings", "Days", "Deductions", "Amount")),
    (["'DELIVERY CHALLAN'", "'WAYBILL'", "'VEHICLE NO KA01'", _ON, _MAIL], ["'NOT FOR SALE'"], ()),
    (["'GOODS RECEIPT NOTE'", "'GRN'", "'RECEIVED BY stores'", _line("Supplier ", "seller_gstin"), _ON], ["'ACCEPTED QTY all'"], ()),
    (["'GSTR-1'", "'GST RETURN'", "'TAX PERIOD'", "'ACKNOWLEDGEMENT NUMBER'", *_SELLER, _ON], ["'TURNOVER'"], ()),
    (["'Memo to all staff'", _line("Please file every quote for ", "coalesce(doc_no, 'none')"), _MAIL, _ON], ["'Thank you.'"], ("Topic", "Count", "Share", "Note")),
)


def _by_kind(choose) -> str:
    return "CASE kind " + " ".join(f"WHEN {n} THEN {choose(k)}" for n, k in enumerate(KINDS)) + " END"


TEXT_COLUMNS = {
    "first_half": _by_kind(lambda k: f"concat_ws(line_end, {', '.join(k[0])})"),
    "second_half": _by_kind(lambda k: f"concat_ws(line_end, {', '.join(k[1])})"),
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order lines, keyed by order and document part, and order heads, keyed by order."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER, F.expr(PART).alias("part"))
    heads = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderdate").alias("orderdate"),
    )
    # Raw numbers are shuffled, and the cells are written behind the shuffle.
    return lines.repartition("l_orderkey", "part"), heads


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input that has fewer splits than the session has cores.

    Large tables have more splits than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prose table."""
    return spread(read(spark, sf_dir, "documents"))


def with_exprs(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    for name, sql in columns.items():
        df = df.withColumn(name, F.expr(sql))
    return df


def business_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed documents with workspace_id, plus the source numbers they were made from."""
    cells = [F.expr(c) for c in CELLS]
    row = (
        F.when(F.expr(EMPTY_ROW), F.array().cast("array<string>"))
        .when(F.expr(SHORT_ROW), F.array(*cells[:3]))
        .otherwise(F.array(*cells))
    )
    lines, heads = order_lines(spark, sf_dir)
    rows = with_exprs(lines, LINE_COLUMNS).withColumn("row", row)
    grouped = rows.groupBy("l_orderkey", "part").agg(
        F.sum("cents").alias("subtotal_cents"),
        F.count("*").alias("n_lines"),
        F.sort_array(F.collect_list(F.struct(*LINE_ORDER, "row"))).alias("lines"),
    )
    docs = grouped.join(heads, "l_orderkey").withColumnRenamed("l_orderkey", "key")
    docs = with_exprs(with_exprs(docs, DOCUMENT_COLUMNS), TEXT_COLUMNS)

    def page(number: int, body) -> object:
        return F.struct(F.lit(number).alias("page_number"), body.alias("text"))

    one = F.array(page(1, F.concat_ws("\n", "first_half", "second_half")))
    two = F.array(page(1, F.col("first_half")), page(2, F.col("second_half")))
    headers = F.expr(_by_kind(lambda k: "array(" + ", ".join(f"'{h}'" for h in k[2]) + ")" if k[2] else "cast(array() as array<string>)"))
    table = F.struct(
        F.lit(0).alias("table_index"),
        F.lit(1).alias("page_number"),
        headers.alias("headers"),
        F.transform("lines", lambda x: x["row"]).alias("rows"),
    )
    made = docs.select(
        "document_id", "workspace_id", "key", "kind", "doc_no", "doc_date", "seller_gstin",
        "subtotal_cents", "tax_cents", "total_fault", "n_lines",
        F.when(F.col("key") % 3 == 0, two).otherwise(one).cast(schemas.PAGES).alias("pages"),
        F.when(F.col("no_table"), F.array().cast(schemas.TABLES))
        .otherwise(F.array(table).cast(schemas.TABLES))
        .alias("tables"),
    )
    return counted(made, "corpus")
