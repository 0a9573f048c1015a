"""File scan, admission checks and the document catalog."""

from __future__ import annotations

import fnmatch
import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf import constants as K
from ledgerleaf.functions import ids, text
from ledgerleaf.functions.session import once

# Types and encodings that Python itself knows, whatever the machine adds to them.
_KNOWN = mimetypes.MimeTypes(filenames=())
MIME_BY_EXTENSION = {
    ext: kind for ext, kind in _KNOWN.types_map[True].items() if ext not in _KNOWN.encodings_map
}
ENCODED_EXTENSIONS = tuple(_KNOWN.encodings_map)
PACKED_EXTENSIONS = dict(_KNOWN.suffix_map)


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, null for other keys."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def scan_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of every file below ``path``.

    Filters on length and modificationTime prune before any content is read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def empty_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files of zero length below ``path``, in the columns of :func:`scan_files`.

    Spark's file sources skip such files, but admission has to report them. Names are
    read one by one from the file system's own iterator; only empty files are kept.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    found = []
    while files.hasNext():
        f = files.next()
        if f.getLen() == 0 and fnmatch.fnmatch(f.getPath().getName(), glob):
            found.append((f.getPath().toString(), f.getModificationTime()))
    listed = spark.createDataFrame(found, "path string, at bigint")
    return listed.select(
        "path", F.timestamp_millis("at").alias("modificationTime"), F.lit(0).cast("bigint").alias("length"),
        F.lit(b"").alias("content"),
    )


def missing_files(requested: DataFrame, files: DataFrame) -> DataFrame:
    """Requested paths without a file, as failed documents rather than a crash."""
    return requested.join(files.select("path"), "path", "left_anti").withColumn(
        "error", F.lit("file_not_found")
    )


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)[^/]*$", 0)


def sanitize(filename: Column) -> Column:
    """File name without folders, NUL and unsafe characters; never empty or hidden."""
    safe = F.regexp_replace(F.regexp_replace(base_name(filename), "\x00", ""), r"[^a-zA-Z0-9._-]", "_")
    shown = F.regexp_replace(safe, r"^\.+", "")
    return F.when(shown == "", "unnamed_file").otherwise(shown)


def suffix(name: Column) -> Column:
    """Last extension in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def suffixes(name: Column) -> Column:
    """All extensions in lower case; none for a name that ends in a dot."""
    parts = F.split(F.regexp_replace(F.lower(name), r"^\.+", ""), r"\.")
    dotted = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.lit("."), p))
    return F.when(F.endswith(name, F.lit(".")), F.array().cast("array<string>")).otherwise(dotted)


def guess_mime(name: Column) -> Column:
    """MIME type by extension; compressed files are typed by the name below."""
    ext = suffix(name)
    packed = lookup(PACKED_EXTENSIONS, ext)
    full = F.when(packed.isNotNull(), F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), packed)).otherwise(name)
    inner = F.when(
        suffix(full).isin(*ENCODED_EXTENSIONS), F.regexp_replace(full, r"\.[^.]+$", "")
    ).otherwise(full)
    return F.coalesce(lookup(MIME_BY_EXTENSION, suffix(inner)), F.lit(K.DEFAULT_MIME))


def category(ext: Column) -> Column:
    return F.coalesce(lookup(K.TECHNICAL_CATEGORY, F.lower(ext)), F.lit("UNKNOWN"))


def reject_reason(length: Column, clean_name: Column, mime_type: Column) -> Column:
    """Message of the first failing admission check, or null. Messages are fixed values."""
    ext = suffix(clean_name)
    mime = F.lower(text.strip(mime_type))
    blocked = F.filter(suffixes(clean_name), lambda s: s.isin(*K.BLOCKED_EXTENSIONS))
    pairs = [mime.eqNullSafe(m) & ext.isin(*exts) for m, exts in K.MIME_EXTENSIONS.items()]
    matches = pairs[0]
    for p in pairs[1:]:
        matches = matches | p
    limit = K.MAX_FILE_BYTES / (1024 * 1024)
    return (
        F.when(length <= 0, "Uploaded file is empty.")
        .when(length > K.MAX_FILE_BYTES, f"File size exceeds maximum allowed limit of {limit:.1f} MB.")
        .when(ext == "", "File missing extension.")
        .when(
            F.size(blocked) > 0,
            F.concat(F.lit("Forbidden dangerous extension detected: '"), F.get(blocked, F.lit(0)), F.lit("'")),
        )
        .when(
            ~ext.isin(*K.ALLOWED_EXTENSIONS),
            F.concat(F.lit("Unsupported file extension: '"), ext, F.lit("'")),
        )
        .when(
            ~mime.isin(*K.MIME_EXTENSIONS), F.concat(F.lit("Unsupported MIME type: '"), mime, F.lit("'"))
        )
        .when(
            ~matches,
            F.concat(
                F.lit("MIME type '"), mime, F.lit("' does not match file extension '"), ext, F.lit("'.")
            ),
        )
    )


@once
def _checks() -> list[dict[str, Column]]:
    name = F.col("original_filename")
    return [
        {"original_filename": sanitize(F.col("filename"))},
        {"file_extension": suffix(name), "reject_reason": reject_reason(F.col("length"), name, F.col("mime_type"))},
    ]


def checked(files: DataFrame) -> DataFrame:
    """Add original_filename, file_extension and reject_reason.

    Needs filename, length and mime_type. One expression; the first failing check wins.
    """
    for step in _checks():
        files = files.withColumns(step)
    return files


def split_admitted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    done = checked(files)
    return done.filter("reject_reason is null"), done.filter("reject_reason is not null")


@once
def document_id() -> Column:
    """Name-based UUID over workspace, path and content digest, so that a rerun gives the same document the same id."""
    # Lengths in front keep the parts apart: no two inputs share a name.
    part = lambda c: F.concat(F.length(c).cast("string"), F.lit("|"), c)
    name = F.concat(part(F.col("workspace_id")), part(F.col("path")), F.sha2("content", 256))
    return ids.name_uuid(name)


def catalog(admitted: DataFrame) -> DataFrame:
    """Catalog rows of admitted files. Needs workspace_id, path, content and the columns of :func:`checked`."""
    return admitted.withColumn("document_id", document_id()).select(
        "document_id",
        "workspace_id",
        "path",
        "original_filename",
        F.concat("document_id", "file_extension").alias("stored_filename"),
        "file_extension",
        F.lower(text.strip(F.col("mime_type"))).alias("mime_type"),
        category(F.col("file_extension")).alias("technical_file_category"),
        F.col("length").alias("file_size"),
        F.lit("SUCCESS").alias("upload_status"),
        F.lit("UNPROCESSED").alias("processing_status"),
        F.lit("VALID").alias("validation_status"),
        F.current_timestamp().alias("upload_timestamp"),
        "content",
    )


def parser_kind(ext: Column) -> Column:
    return lookup(K.PARSER_KIND, F.lower(ext))


def routing_error(ext: Column, length: Column) -> Column:
    """Why an admitted file cannot be parsed, or null."""
    return F.when(
        parser_kind(ext).isNull(),
        F.concat(F.lit("Unsupported document extension for parsing: '"), F.lower(ext), F.lit("'")),
    ).when(F.coalesce(length, F.lit(0)) <= 0, "empty_document")
