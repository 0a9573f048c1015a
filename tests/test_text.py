import re

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions import text, values

SAMPLES = [
    "  a b  ", "", " \t\n", "x\x1cy\r\nz\x0b\x0c", "one\ntwo\r\n\r\nthree four\x85five\n",
    "Größe: 5\nInvoice No - 7=8", "a@b.com;éa@b.com .c@d.org", "call +91 222-555-1234 or (123) 456.7890x",
    "12/08/2026 é13/08/2026 3 August 26 5 may 2026x 2026-1-2", "27ABCDE1234F1Z5 x27ABCDE1234F1Z5 abcde1234f éABCDE1234F",
    "\x1d\x1e tail \x1f", "١٢/٠٨/٢٠٢٦",
]
# The entity patterns that the engine's own forms must equal.
PATTERNS = {
    text.GSTIN: r"(?i)\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b",
    text.PAN: r"(?i)\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    text.EMAIL: r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    text.PHONE: r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    text.DATE: r"(?i)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4})\b",
}


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, t string")


def collected(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_strip_and_lines_follow_python(samples):
    assert collected(samples, text.strip(F.col("t"))) == [s.strip() for s in SAMPLES]
    expected = [[x.strip() for x in s.splitlines() if x.strip()] for s in SAMPLES]
    assert collected(samples, text.lines(F.col("t"))) == expected
    assert collected(samples, text.line_count(F.col("t"))) == [len(s.splitlines()) for s in SAMPLES]


@pytest.mark.parametrize("ours", list(PATTERNS))
def test_mentions_follow_unicode_boundaries(samples, ours):
    expected = [[m.group(0) for m in re.finditer(PATTERNS[ours], s)] for s in SAMPLES]
    assert collected(samples, text.mentions(F.col("t"), ours)) == expected


def test_mentions_on_test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for ours, theirs in PATTERNS.items():
        got = dict(docs.select("doc_id", text.mentions(F.col("text"), ours)).collect())
        want = {r.doc_id: [m.group(0) for m in re.finditer(theirs, r.text)] for r in docs.collect()}
        assert got == want


def test_keyword_values(spark):
    body = "Sub Total: 5\nSUBTOTAL: 7\nDue Date:\nDUE DATE = 1-2\nINVOICE-NO: 7\nTotals: 9\nTOTAL 8"
    df = spark.createDataFrame([(body,)], "t string").select(text.candidates(text.lines(F.col("t"))).alias("c"))
    get = lambda ks, whole: df.select(text.keyword_value(F.col("c"), ks, whole)).first()[0]
    assert get(["SUBTOTAL"], True) == "7"
    assert get(["TOTAL"], True) == "5"
    assert get(["TOTALS"], False) == "9"
    assert get(["DUE DATE"], True) == "1-2"
    assert get(["INVOICE"], True) == "NO: 7"
    assert get(["MISSING"], True) is None


AMOUNTS = {
    "Rs. 1,234.50": None, "Rs. 500": 0.5, "INR 1,234.50": 1234.5, "-": None, "5-": None, "1.": 1.0, ".5": 0.5,
    "": None, "(12)": 12.0, "-3.25": -3.25, "१२३": 123.0, "n/a": None,
}


def test_amounts(spark):
    df = spark.createDataFrame([(k,) for k in AMOUNTS], "t string")
    assert dict(df.select("t", values.amount(F.col("t"))).collect()) == AMOUNTS
    strict = dict(df.select("t", values.amount(F.col("t"), "strict_currency")).collect())
    assert strict["Rs. 1,234.50"] == 1234.5 and strict["Rs. 500"] == 500.0


DATES = {
    "2026-08-20": "2026-08-20", "1/2/2026": "2026-02-01", "01-02-2026": "2026-02-01", "3 AUG 2026": "2026-08-03",
    "3  August\t2026": "2026-08-03", "2026/1/9": "2026-01-09", "9.1.2026": "2026-01-09", "31/02/2026": None,
    "2026-13-01": None, "1/2/26": None, "soon": None, " ": None, "20-08-2026 10:00": None,
}


def test_dates(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "t string")
    assert dict(df.select("t", values.date(F.col("t")).cast("string")).collect()) == DATES
