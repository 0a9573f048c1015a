"""Parsed documents from file content: text, CSV and image headers."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf import constants as K
from ledgerleaf import schemas
from ledgerleaf.functions import text
from ledgerleaf.sources import admit

_KEYS = ("document_id", "workspace_id", "storage_path", "file_extension", "mime_type")


def decoded(content: Column) -> Column:
    """Text of file bytes: UTF-8 where valid, Latin-1 otherwise."""
    # Codes 128-159 of Latin-1 are control characters, as the charset defines them.
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.decode(content, "ISO-8859-1")
    )


def _page(body: Column) -> Column:
    return F.array(F.struct(F.lit(1).alias("page_number"), body.alias("text"))).cast(schemas.PAGES)


def _parsed(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows in the shape of the parsed-document table."""
    empty = {
        "page_count": F.lit(0),
        "pages": F.array().cast(schemas.PAGES),
        "tables": F.array().cast(schemas.TABLES),
        "image_metadata": F.lit(None).cast(schemas.IMAGE),
        "metadata": F.create_map().cast(schemas.METADATA),
        "parse_error": F.lit(None).cast("string"),
    }
    values = empty | columns
    values["parsing_status"] = F.when(values["parse_error"].isNull(), "SUCCESS").otherwise("FAILED")
    kept = ("reject_reason",) if "reject_reason" in df.columns else ()
    return df.select(*_KEYS, *kept, *(values[f.name].cast(f.dataType).alias(f.name) for f in schemas.PARSED if f.name not in _KEYS))


# One CSV field: quoted with what follows its closing quote, or bare; then what ends it. All
# repetitions are possessive, so a field of any length is matched without going back.
_FIELD = r'(?:"([^"]*+(?:""[^"]*+)*+)"?+([^,\r\n]*+)|((?!")[^,\r\n]*+))(,|\r*+\n|\r*+\z)'


def csv_rows(body: Column) -> Column:
    """Rows of a CSV text that hold any character, as arrays of fields; null for a text that can't be read.

    A quote counts at the start of a field only, is doubled inside, and may stay open up to the
    end of the text. Quoted fields keep line ends and commas; rows may differ in length. A
    carriage return in front of anything but a line end is an error. Null gives null, an empty
    text no rows.
    """
    # Bound once, whatever reads it.
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    part = lambda t, n: F.regexp_extract(t, _FIELD, n)
    quoted = lambda t: F.concat(F.replace(part(t, 1), F.lit('""'), F.lit('"')), part(t, 2))
    value = lambda t: F.when(F.startswith(t, F.lit('"')), quoted(t)).otherwise(part(t, 3))

    def fields(tokens: Column) -> Column:
        """Fields, and the numbers of those that end a row; null where characters are left over."""
        ends = F.transform(tokens, lambda t, i: F.when(part(t, 4) != ",", i + 1))
        cells = F.struct(F.transform(tokens, value).alias("cells"), F.filter(ends, lambda i: i.isNotNull()).alias("ends"))
        return F.when(F.length(F.array_join(tokens, "")) == F.length(body), cells)

    def rows(f: Column) -> Column:
        begin = lambda i: F.coalesce(F.get(f["ends"], i - 1), F.lit(0))
        cut = F.transform(f["ends"], lambda end, i: F.slice(f["cells"], begin(i) + 1, end - begin(i)))
        return F.filter(cut, lambda r: F.exists(r, lambda v: v != ""))

    return once(once(F.regexp_extract_all(body, F.lit(_FIELD), F.lit(0)), fields), rows)


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Width and height in the first frame header of a JPEG."""
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + (0 if 0xD0 <= marker <= 0xD8 or marker == 1 else struct.unpack(">H", data[at + 2 : at + 4])[0])
    return None


@F.pandas_udf(schemas.IMAGE_SIZE)
def _jpeg_sizes(contents: pd.Series) -> pd.DataFrame:
    found = [(c is not None and _jpeg_size(c)) or (None, None) for c in contents]
    return pd.DataFrame(found, columns=["width", "height"]).astype("Int32")


def image_header(content: Column) -> Column:
    """Width, height and format, read from the header alone; null for anything else.

    Only JPEG files go to Python, as their sizes stand behind a chain of segments.
    """
    start = lambda digits: F.substring(content, 1, len(digits) // 2) == F.unhex(F.lit(digits))
    big = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("bigint")
    little = lambda at, n: sum(big(at + i, 1) * 256**i for i in range(n))
    signed = lambda c: F.when(c >= 2**31, c - 2**32).otherwise(c)
    jpeg = _jpeg_sizes(F.when(start("FFD8"), content))
    size = F.length(content)
    shapes = {
        "PNG": (start("89504E470D0A1A0A") & (F.substring(content, 13, 4) == F.unhex(F.lit("49484452"))) & (size >= 24), big(17, 4), big(21, 4)),
        "JPEG": (jpeg["width"].isNotNull(), jpeg["width"], jpeg["height"]),
        "GIF": ((start("474946383761") | start("474946383961")) & (size >= 10), little(7, 2), little(9, 2)),
        "BMP": (start("424D") & (size >= 26), signed(little(19, 4)), F.abs(signed(little(23, 4)))),
    }
    found = F.lit(None).cast(schemas.IMAGE_HEADER)
    for name, (fits, width, height) in reversed(shapes.items()):
        sizes = width.try_cast("int"), height.try_cast("int")
        header = F.struct(sizes[0].alias("width"), sizes[1].alias("height"), F.lit(name).alias("format"))
        found = F.when(fits & sizes[0].isNotNull() & sizes[1].isNotNull(), header).otherwise(found)
    return found


def _read(files: DataFrame, kinds: tuple[str, ...], kind: Column, error: Column) -> DataFrame:
    """Parsed rows of files of the given kinds, in one projection over one scan.

    Rows with an error, and rows of other kinds (``not_decoded``), come without pages.
    """
    is_kind = {k: error.isNull() & kind.eqNullSafe(k) for k in kinds}
    is_a = lambda *names: sum((is_kind[k].cast("int") for k in names if k in kinds), F.lit(0)) > 0
    steps: list[dict[str, Column]] = [{}, {}, {}]
    if "IMAGE" in kinds:
        steps[0]["_image"] = image_header(F.when(is_kind["IMAGE"], F.col("content")))
    if "TXT" in kinds or "CSV" in kinds:
        steps[0]["_text"] = F.when(is_a("TXT", "CSV"), decoded(F.col("content")))
    if "CSV" in kinds:
        steps[1]["_raw"] = csv_rows(F.when(is_kind["CSV"], F.col("_text")))
        # The size limit of admission bounds the cells of a file.
        steps[2]["_rows"] = F.transform("_raw", lambda r: F.transform(r, text.strip))
    for columns in steps:
        files = files.withColumns(columns) if columns else files
    no_map = F.create_map().cast(schemas.METADATA)
    body, tables, image, meta = F.lit(None).cast("string"), F.array().cast(schemas.TABLES), F.lit(None).cast(schemas.IMAGE), no_map
    bad = F.when(~is_a(*kinds), F.lit("not_decoded"))
    if "TXT" in kinds:
        here = is_kind["TXT"]
        counts = (F.lit("character_count"), F.length("_text").cast("string"), F.lit("line_count"), text.line_count(F.col("_text")).cast("string"))
        body, meta = F.when(here, F.col("_text")).otherwise(body), F.when(here, F.create_map(*counts)).otherwise(meta)
    if "CSV" in kinds:
        here, rows = is_kind["CSV"], F.col("_rows")
        table = F.struct(
            F.lit(0).alias("table_index"),
            F.lit(1).alias("page_number"),
            F.get(rows, F.lit(0)).alias("headers"),
            F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))).alias("rows"),
        )
        body = F.when(here, F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")).otherwise(body)
        tables = F.when(here & (F.size(rows) > 0), F.array(table).cast(schemas.TABLES)).otherwise(tables)
        total = F.when(rows.isNull(), 0).otherwise(F.size(rows))
        meta = F.when(here, F.create_map(F.lit("total_rows"), total.cast("string"))).otherwise(meta)
        bad = F.when(here & rows.isNull(), "corrupted_csv").otherwise(bad)
    if "IMAGE" in kinds:
        here, seen = is_kind["IMAGE"] & F.col("_image").isNotNull(), F.col("_image")
        width, height = seen["width"].cast("string"), seen["height"].cast("string")
        label = F.concat(F.lit("[IMAGE FILE: "), seen["format"], F.lit(" ("), width, F.lit("x"), height, F.lit("px)]"))
        body = F.when(here, label).otherwise(body)
        size = F.length("content").cast("bigint").alias("size_bytes")
        image = F.when(here, F.struct(seen["width"].alias("width"), seen["height"].alias("height"), seen["format"].alias("format"), size))
        known = F.create_map(F.lit("width"), width, F.lit("height"), height, F.lit("format"), seen["format"])
        meta = F.when(here, known).otherwise(meta)
        bad = F.when(is_kind["IMAGE"] & seen.isNull(), "corrupted_image").otherwise(bad)
    return _parsed(
        files,
        page_count=F.when(body.isNotNull(), 1).otherwise(0),
        pages=F.when(body.isNotNull(), _page(body)).otherwise(F.array().cast(schemas.PAGES)),
        tables=tables, image_metadata=image, metadata=meta,
        parse_error=F.coalesce(error, bad),
    )


def parse_text(files: DataFrame) -> DataFrame:
    """Text files as one page each."""
    return _read(files, ("TXT",), F.lit("TXT"), F.lit(None).cast("string"))


def parse_csv(files: DataFrame) -> DataFrame:
    """CSV files as one page and one table each; the first non-empty row is the header."""
    return _read(files, ("CSV",), F.lit("CSV"), F.lit(None).cast("string"))


def parse_image(files: DataFrame) -> DataFrame:
    """Image metadata and a placeholder page; pixels are never decoded."""
    return _read(files, ("IMAGE",), F.lit("IMAGE"), F.lit(None).cast("string"))


def parse_files(catalog: DataFrame, assembled: DataFrame | None = None) -> DataFrame:
    """Parsed-document table of a catalog with content.

    Text, CSV and images are read here, all in one projection over one scan. PDF, Word and
    worksheet files come as relations of their cells and pages: ``assembled`` holds the parsed
    documents made from them (see :mod:`ledgerleaf.sources.assemble`). Every catalog row gives
    one row. Rows with a ``reject_reason``, where the catalog has that column, fail with it
    and are not read.
    """
    kind = admit.parser_kind(F.col("file_extension"))
    # Routing by the size that the listing gives: a branch without content doesn't read any.
    size = F.col("file_size") if "file_size" in catalog.columns else F.length("content")
    error = admit.routing_error(F.col("file_extension"), size)
    if "storage_path" not in catalog.columns:
        catalog = catalog.withColumnRenamed("path", "storage_path")
    refused = "reject_reason" in catalog.columns
    if refused:
        error = F.coalesce("reject_reason", error)
    files = catalog.withColumns({"_kind": kind, "_error": error})
    made = F.col("_error").isNull() & F.col("_kind").isin("PDF", "DOCX", "EXCEL")
    here = files if assembled is None else files.filter(~F.coalesce(made, F.lit(False)))
    out = _read(here, ("TXT", "CSV", "IMAGE"), F.col("_kind"), F.col("_error"))
    if refused:
        out = out.withColumn("parse_error", F.when(F.col("reject_reason").isNull(), F.col("parse_error")))
    if assembled is None:
        return out
    columns = [f.name for f in schemas.PARSED if f.name not in _KEYS]
    keys = [*_KEYS, "reject_reason"] if refused else _KEYS
    joined = files.filter(made).select(*keys).join(assembled.select("document_id", *columns), "document_id", "left")
    lost = F.col("parsing_status").isNull()
    joined = joined.withColumns(
        {
            "parse_error": F.when(lost, "not_decoded").otherwise(F.col("parse_error")),
            "parsing_status": F.coalesce("parsing_status", F.lit("FAILED")),
            "pages": F.coalesce("pages", F.array().cast(schemas.PAGES)),
            "tables": F.coalesce("tables", F.array().cast(schemas.TABLES)),
            "page_count": F.coalesce("page_count", F.lit(0)),
        }
    )
    return out.unionByName(joined)
