"""Small documents for the tests."""

from pyspark.sql import DataFrame, SparkSession

from ledgerleaf import schemas

PARSED = "document_id string, workspace_id string, pages {}, tables {}".format(
    schemas.PAGES.simpleString(), schemas.TABLES.simpleString()
)

GOLDEN = "INVOICE NO: INV-2026-001\nDATE: 2026-08-20\nSUBTOTAL: 102000.00\nCGST: 9180.00\nSGST: 9180.00\nTOTAL: 120360.00\n"


def parsed(spark: SparkSession, *docs: tuple) -> DataFrame:
    """Parsed documents from (id, text or list of page texts, rows[, headers])."""
    rows = []
    for d in docs:
        name, body, *rest = d
        pages = body if isinstance(body, list) else [body]
        tables = []
        if rest:
            tables = [(0, 1, list(rest[1]) if len(rest) > 1 else [], rest[0])]
        rows.append((name, "ws-1", [(i, t) for i, t in enumerate(pages, 1)], tables))
    return spark.createDataFrame(rows, PARSED)
