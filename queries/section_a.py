"""Scans, admission and assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import text
from ledgerleaf.sources import admit, assemble, corpus, decode
from ledgerleaf.sources.corpus import read, texts, with_exprs
from queries import fixtures as X


def a1_scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = admit.scan_files(spark, sf_dir, "*.parquet")
    found = files.select(admit.base_name(F.col("path")).alias("name"), "length", F.lit(None).cast("string").alias("error"))
    asked = read(spark, sf_dir, "region").select(
        F.concat(F.lit(f"file:{sf_dir}/"), F.lower("r_name"), F.lit(".parquet")).alias("path")
    )
    lost = admit.missing_files(asked, files).select(
        admit.base_name(F.col("path")).alias("name"), F.lit(0).cast("bigint").alias("length"), "error"
    )
    return found.unionByName(lost)


def a2_sanitize_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.manifest(spark, sf_dir).select("doc_id", admit.sanitize(F.col("filename")).alias("clean_name"))


def a3_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admit.checked(X.manifest(spark, sf_dir)).select(
        "doc_id", "original_filename", "file_extension", "reject_reason"
    )


def a4_guess_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = admit.base_name(F.col("filename"))
    return X.manifest(spark, sf_dir).select("doc_id", admit.guess_mime(name).alias("guessed"))


def a5_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = admit.suffix(admit.sanitize(F.col("filename")))
    return X.manifest(spark, sf_dir).select("doc_id", admit.category(ext).alias("category"))


def a6_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = X.manifest(spark, sf_dir).withColumn("content", F.encode("text", "UTF-8"))
    good, _ = admit.split_admitted(files)
    return admit.catalog(good).select(
        "document_id", "workspace_id", "path", "original_filename", "stored_filename", "file_extension",
        "mime_type", "technical_file_category", "file_size", "upload_status", "processing_status",
        "validation_status",
    )


def a7_parser_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = admit.suffix(admit.sanitize(F.col("filename")))
    return X.manifest(spark, sf_dir).select(
        "doc_id",
        admit.parser_kind(ext).alias("parser"),
        admit.routing_error(ext, F.col("length")).alias("error"),
    )


def _text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose as file bytes: Latin-1 for every other document that can be written so."""
    latin = F.expr("doc_id % 2 = 1") & F.col("text").rlike("^[\\x00-\\xff]*$")
    body = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return texts(spark, sf_dir).select(
        "doc_id",
        F.col("doc_id").cast("string").alias("document_id"),
        F.lit("ws").alias("workspace_id"),
        F.concat(F.lit("store/"), F.col("doc_id").cast("string")).alias("storage_path"),
        F.lit(".txt").alias("file_extension"),
        F.lit("text/plain").alias("mime_type"),
        body.alias("content"),
    )


def a8_text_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = decode.parse_text(_text_files(spark, sf_dir))
    return parsed.select(
        "document_id",
        F.get("pages", F.lit(0))["text"].alias("text"),
        F.col("metadata")["character_count"].cast("bigint").alias("character_count"),
        F.col("metadata")["line_count"].cast("bigint").alias("line_count"),
        "page_count",
    )


CSV_ROW = (
    "concat(' Part ', cast(l_partkey as string), ' ,', cast(cast(l_quantity as bigint) as string), "
    "',\"', l_returnflag, ', \"\"', l_linestatus, '\"\"\n second line\"')"
)


def _csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV file per order, with quotes, line ends inside cells, and empty rows."""
    lines, _ = corpus.order_lines(spark, sf_dir)
    rows = lines.withColumn("csv_row", F.expr(CSV_ROW.replace("\n", "\\n")))
    files = rows.groupBy("l_orderkey", "part").agg(
        F.sort_array(F.collect_list(F.struct(*corpus.LINE_ORDER, "csv_row"))).alias("r")
    )
    body = F.concat(
        F.lit("\nName , Qty,Flags\n,,\n"), F.array_join(F.transform("r", lambda x: x["csv_row"]), "\n\n"), F.lit("\n")
    )
    return files.select(
        F.concat(F.lit("csv-"), F.col("l_orderkey").cast("string"), F.expr(corpus.PART_SUFFIX)).alias("document_id"),
        F.lit("ws").alias("workspace_id"),
        F.lit("store/x.csv").alias("storage_path"),
        F.lit(".csv").alias("file_extension"),
        F.lit("text/csv").alias("mime_type"),
        F.encode(body, "UTF-8").alias("content"),
    )


def a9_csv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = decode.parse_csv(_csv_files(spark, sf_dir))
    table = F.get("tables", F.lit(0))
    return parsed.select(
        "document_id",
        F.get("pages", F.lit(0))["text"].alias("text"),
        F.array_join(table["headers"], "/").alias("headers"),
        F.size(table["rows"]).alias("data_rows"),
        F.col("metadata")["total_rows"].cast("bigint").alias("total_rows"),
    )


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as worksheet cells; rows are dealt to three sheets."""
    lines, _ = corpus.order_lines(spark, sf_dir)
    files = lines.groupBy("l_orderkey", "part").agg(
        F.sort_array(F.collect_list(F.struct(*corpus.LINE_ORDER))).alias("r")
    )
    rows = files.select("l_orderkey", "part", F.posexplode("r").alias("row_no", "x"))
    blank = F.expr("x.l_quantity > 45")
    value = lambda c: F.when(~blank, c)
    cells = F.array(
        value(F.concat(F.lit(" Part "), F.col("x.l_partkey").cast("string"))),
        value(F.col("x.l_quantity").cast("bigint").cast("string")),
        F.lit(None).cast("string"),
        value(F.col("x.l_returnflag")),
    )
    sheet = F.expr("cast(1 + row_no % 3 as int)")
    return rows.select(
        F.concat(F.lit("wb-"), F.col("l_orderkey").cast("string"), F.expr(corpus.PART_SUFFIX)).alias("document_id"),
        sheet.alias("sheet_no"),
        F.concat(F.lit("Sheet "), sheet.cast("string")).alias("sheet_name"),
        "row_no",
        F.posexplode(cells).alias("col_no", "value"),
    )


def a10_worksheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = assemble.worksheets(_cells(spark, sf_dir))
    table = lambda t: F.concat(
        t["table_index"].cast("string"), F.lit(":"), F.array_join(t["headers"], "/"),
        F.lit("+"), F.size(t["rows"]).cast("string"),
    )
    return books.select(
        "document_id",
        F.array_join(F.transform("pages", lambda p: F.concat(p["page_number"].cast("string"), F.lit("="), p["text"])), "\n").alias("pages"),
        F.array_join(F.transform("tables", table), ";").alias("tables"),
        F.col("metadata")["sheet_names"].alias("sheet_names"),
        "page_count",
    )


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select(
        "doc_id",
        F.concat(F.lit("w-"), F.col("doc_id").cast("string")).alias("document_id"),
        F.posexplode(F.split("text", "\n")).alias("para_no", "text"),
    )


def _label_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as two tables per document; values keep odd spaces, one column is empty."""
    rows = F.array(
        *(
            F.struct(F.lit(t).alias("table_no"), F.lit(r).alias("row_no"), F.lit(c).alias("col_no"), v.alias("value"))
            for t, r, c, v in (
                (0, 0, 0, F.lit(" quality ")), (0, 0, 1, F.lit("toxic")),
                (0, 1, 0, F.col("quality").cast("string")), (0, 1, 1, F.concat(F.lit(" "), F.col("toxic").cast("string"))),
                (1, 0, 0, F.lit("only head")), (1, 0, 1, F.lit(None).cast("string")),
            )
        )
    )
    return read(spark, sf_dir, "labels").select(
        F.concat(F.lit("w-"), F.col("doc_id").cast("string")).alias("document_id"),
        F.expr("cast(1 + doc_id % 2 as int)").alias("page_number"),
        F.inline(rows),
    )


def _table_text(tables) -> object:
    row = lambda r: F.array_join(r, "/")
    return F.array_join(
        F.transform(
            tables,
            lambda t: F.concat(
                t["table_index"].cast("string"), F.lit("@"), t["page_number"].cast("string"), F.lit(":"),
                row(t["headers"]), F.lit("+"), F.array_join(F.transform(t["rows"], row), "+"),
            ),
        ),
        ";",
    )


def a11_word_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _label_cells(spark, sf_dir)
    made = assemble.word_documents(_paragraphs(spark, sf_dir).drop("doc_id"), cells.drop("page_number"))
    return made.select(
        "document_id", F.get("pages", F.lit(0))["text"].alias("text"), _table_text(F.col("tables")).alias("tables"),
        F.col("metadata")["author"].alias("author"),
    )


def a12_paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _paragraphs(spark, sf_dir).select(
        "document_id", (F.col("para_no") + 1).alias("page_number"), F.concat(F.lit(" "), "text").alias("text")
    )
    made = assemble.paged_documents(pages, _label_cells(spark, sf_dir))
    return made.select(
        "document_id", "page_count",
        F.array_join(F.transform("pages", lambda p: F.concat(p["page_number"].cast("string"), F.lit("="), p["text"])), "|").alias("pages"),
        _table_text(F.col("tables")).alias("tables"),
    )


def _image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    hex_of = lambda sql, n: F.lpad(F.hex(F.expr(sql)), n, "0")
    w, h = "1 + n_chars % 4000", "1 + doc_id % 3000"
    png = F.concat(
        F.lit("89504E470D0A1A0A0000000D49484452"), hex_of(w, 8), hex_of(h, 8), F.lit("0806000000")
    )
    jpeg = F.concat(
        F.lit("FFD8FFE000104A46494600010100000100010000FFDB0004AAAAFFC0001108"), hex_of(h, 4), hex_of(w, 4),
        F.lit("03011100021100031100FFD9"),
    )
    body = F.when(F.expr("doc_id % 7 = 0"), F.lit("00112233")).when(F.expr("doc_id % 3 = 1"), jpeg).otherwise(png)
    ext = F.when(F.expr("doc_id % 3 = 1"), ".jpg").otherwise(".png")
    return texts(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.lit("ws").alias("workspace_id"),
        F.lit("store/x").alias("storage_path"),
        ext.alias("file_extension"),
        F.when(F.expr("doc_id % 3 = 1"), "image/jpeg").otherwise("image/png").alias("mime_type"),
        F.unhex(body).alias("content"),
    )


def a13_image_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("image_metadata")
    return decode.parse_image(_image_files(spark, sf_dir)).select(
        "document_id",
        F.coalesce(i["width"], F.lit(0)).alias("width"),
        F.coalesce(i["height"], F.lit(0)).alias("height"),
        i["format"].alias("format"),
        F.coalesce(i["size_bytes"], F.lit(0)).alias("size_bytes"),
        F.get("pages", F.lit(0))["text"].alias("page"),
        "parsing_status", "parse_error",
    )


def a14_parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = X.manifest(spark, sf_dir).withColumns(
        {
            "file_extension": admit.suffix(admit.sanitize(F.col("filename"))),
            "document_id": F.col("doc_id").cast("string"),
            "content": F.when(F.expr("doc_id % 17 = 0"), F.encode(F.lit(""), "UTF-8")).otherwise(F.encode("text", "UTF-8")),
        }
    )
    made = assemble.paged_documents(
        files.filter("doc_id % 14 = 0 and doc_id % 3 <> 0").select("document_id", F.lit(1).alias("page_number"), "text")
    )
    return decode.parse_files(files, made).select(
        "document_id", "file_extension", "page_count", F.size("tables").alias("tables"), "parsing_status", "parse_error"
    )


def a15_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.documents(spark, sf_dir).select("document_id", text.corpus(F.col("pages")).alias("body"))


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] == "a" and name[1:2].isdigit()}
