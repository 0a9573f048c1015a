"""Parsed documents from relations of cells, paragraphs and pages.

Decoders of worksheet, word and paged formats deliver their content in long form,
one row per cell, paragraph or page. Here the rows of a document become its pages
and tables. How large a file may be is decided at admission, by its own size; what it
decodes to is not judged again. Columns are numbered from zero, and a cell that is not
delivered leaves its place empty, so a row never shifts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf import schemas
from ledgerleaf.functions import text

def _placed(df: DataFrame) -> DataFrame:
    """Rows placed by document: one exchange serves every later grouping by document, table and row."""
    return df.repartition("document_id")


def _ordered(order: str, *fields: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(order, *fields)))


def _table_rows(cells: DataFrame, *keys: str) -> DataFrame:
    """Cells to rows of ``(col_no, value)``, and the last column of each row; null cells become empty strings."""
    value = F.coalesce(text.strip(F.col("value").cast("string")), F.lit(""))
    return (
        cells.withColumns({"value": value, "col_no": F.col("col_no").cast("int")})
        .groupBy("document_id", *keys, "row_no")
        .agg(_ordered("col_no", "value").alias("row"), F.max("col_no").alias("last_col"))
    )


def _grid(row: Column, last_col: Column) -> Column:
    """Values of a row in their columns."""
    at = lambda i: F.get(F.filter(row, lambda c: c["col_no"] == i), F.lit(0))["value"]
    return F.transform(F.sequence(F.lit(0), last_col), lambda i: F.coalesce(at(i), F.lit("")))


def _table_grids(rows: DataFrame, *keys: str) -> DataFrame:
    """Tables as full grids, rows in order."""
    tables = rows.groupBy("document_id", *keys).agg(_ordered("row_no", "row").alias("r"), F.max("last_col").alias("last_col"))
    return tables.withColumn("rows", F.transform("r", lambda r: _grid(r["row"], F.col("last_col")))).drop("r")


def _table(rows: Column, index: Column, page: Column) -> Column:
    return F.struct(
        index.cast("int").alias("table_index"),
        page.cast("int").alias("page_number"),
        F.get(rows, F.lit(0)).alias("headers"),
        F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))).alias("rows"),
    )


def _by_number(structs: Column, number: str) -> Column:
    return F.array_sort(structs, lambda a, b: a[number] - b[number])


def _finish(df: DataFrame) -> DataFrame:
    """Parsed-document columns."""
    return df.select(
        "document_id",
        F.col("page_count").cast("int"),
        F.coalesce("pages", F.array()).cast(schemas.PAGES).alias("pages"),
        F.coalesce("tables", F.array()).cast(schemas.TABLES).alias("tables"),
        F.lit(None).cast(schemas.IMAGE).alias("image_metadata"),
        F.col("metadata").cast(schemas.METADATA),
        F.lit("SUCCESS").alias("parsing_status"),
        F.lit(None).cast("string").alias("parse_error"),
    )


def worksheets(cells: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """Workbooks from ``cells(document_id, sheet_no, sheet_name, row_no, col_no, value)``.

    Rows without any text are dropped, and so are sheets without rows; the other
    sheets keep their ordinal. ``sheets(document_id, sheet_no, sheet_name)`` lists
    the sheets for the metadata, including empty ones; without it the sheets are
    those that occur in ``cells``.
    """
    if sheets is not None:
        # A listed sheet counts as one row without text.
        empty = sheets.select("document_id", "sheet_no", "sheet_name", F.lit(-1).alias("row_no"), F.lit(0).alias("col_no"))
        cells = cells.unionByName(empty, allowMissingColumns=True)
    rows = _table_rows(_placed(cells), "sheet_no", "sheet_name")
    shown = F.when(F.exists("row", lambda x: x["value"] != ""), F.struct("row_no", "row"))
    sheet = rows.groupBy("document_id", "sheet_no", "sheet_name").agg(
        F.sort_array(F.collect_list(shown)).alias("r"), F.max("last_col").alias("last_col")
    ).withColumn("rows", F.transform("r", lambda r: _grid(r["row"], F.col("last_col"))))
    title = F.concat(F.lit("--- Worksheet: "), "sheet_name", F.lit(" ---"))
    body = F.concat_ws("\n", title, F.transform("rows", lambda r: F.array_join(r, " | ")))
    number, filled = F.col("sheet_no"), F.size("rows") > 0
    page = F.struct(number.cast("int").alias("page_number"), body.alias("text"))
    books = sheet.groupBy("document_id").agg(
        F.sort_array(F.collect_list(F.when(filled, page))).alias("pages"),
        _by_number(F.collect_list(F.when(filled, _table(F.col("rows"), number - 1, number))), "table_index").alias("tables"),
        F.transform(_ordered("sheet_no", "sheet_name"), lambda s: s["sheet_name"]).alias("names"),
    )
    done = books.withColumns(
        {
            "page_count": F.size("pages"),
            "metadata": F.create_map(
                F.lit("sheet_names"), F.array_join("names", ", "),
                F.lit("total_sheets"), F.size("names").cast("string"),
            ),
        }
    )
    return _finish(done)


def _properties(properties: DataFrame | None, keys: tuple[str, ...]) -> Column:
    """Metadata map with every key; missing values become empty strings."""
    found = F.col("properties") if properties is not None else F.create_map().cast(schemas.METADATA)
    pairs = [x for k in keys for x in (F.lit(k), F.coalesce(F.try_element_at(found, F.lit(k)), F.lit("")))]
    return F.create_map(*pairs)


def word_documents(
    paragraphs: DataFrame, cells: DataFrame | None = None, properties: DataFrame | None = None
) -> DataFrame:
    """Word documents from ``paragraphs(document_id, para_no, text)`` and
    ``cells(document_id, table_no, row_no, col_no, value)``.

    Non-blank paragraphs are joined by blank lines to one page. ``properties`` holds
    document_id and a map of core properties.
    """
    shown = _placed(paragraphs).withColumn("text", text.strip(F.col("text")))
    whole = shown.groupBy("document_id").agg(
        F.filter(F.transform(_ordered("para_no", "text"), lambda p: p["text"]), lambda x: x != "").alias("parts")
    )
    if cells is not None:
        rows = _table_rows(_placed(cells), "table_no")
        table = _table_grids(rows, "table_no")
        tables = table.groupBy("document_id").agg(
            _by_number(F.collect_list(_table(F.col("rows"), F.col("table_no"), F.lit(1))), "table_index").alias("tables")
        )
        whole = whole.join(tables, "document_id", "full")
    else:
        whole = whole.withColumn("tables", F.lit(None).cast(schemas.TABLES))
    if properties is not None:
        whole = whole.join(properties.select("document_id", "properties"), "document_id", "left")
    body = F.coalesce(F.array_join("parts", "\n\n"), F.lit(""))
    done = whole.withColumns(
        {
            "page_count": F.lit(1),
            "pages": F.array(F.struct(F.lit(1).alias("page_number"), body.alias("text"))),
            "metadata": _properties(properties, ("author", "title", "subject", "created", "modified")),
        }
    )
    return _finish(done)


def paged_documents(
    pages: DataFrame, cells: DataFrame | None = None, properties: DataFrame | None = None
) -> DataFrame:
    """Paged documents from ``pages(document_id, page_number, text)`` and
    ``cells(document_id, page_number, table_no, row_no, col_no, value)``.

    Tables are numbered across the pages of a document.
    """
    page = F.struct(F.col("page_number").cast("int").alias("page_number"), text.strip(F.col("text")).alias("text"))
    whole = _placed(pages).groupBy("document_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    if cells is not None:
        rows = _table_rows(_placed(cells), "page_number", "table_no")
        table = _table_grids(rows, "page_number", "table_no")
        ordered = F.sort_array(F.collect_list(F.struct("page_number", "table_no", "rows")))
        numbered = F.transform(ordered, lambda t, i: _table(t["rows"], i, t["page_number"]))
        whole = whole.join(table.groupBy("document_id").agg(numbered.alias("tables")), "document_id", "left")
    else:
        whole = whole.withColumn("tables", F.lit(None).cast(schemas.TABLES))
    if properties is not None:
        whole = whole.join(properties.select("document_id", "properties"), "document_id", "left")
    done = whole.withColumns(
        {
            "page_count": F.size("pages"),
            "metadata": _properties(properties, ("author", "title", "subject", "creator", "producer")),
        }
    )
    return _finish(done)
