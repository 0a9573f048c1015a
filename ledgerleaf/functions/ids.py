"""Name-based identifiers as built-in expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerleaf.constants import DNS_NAMESPACE_HEX
from ledgerleaf.functions.text import strip


def name_uuid(name: Column) -> Column:
    """Version-5 UUID of a name in the DNS namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE_HEX)), F.encode(name, "UTF-8")))
    part = lambda start, n: F.substring(digest, start, n)
    # RFC 4122: the top two bits of the variant digit are fixed to 10.
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(
        part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"),
        variant, part(18, 3), F.lit("-"), part(21, 12),
    )


def chunk_id(document_id: Column, chunk_index: Column) -> Column:
    return name_uuid(F.concat(document_id, F.lit("_chunk_"), chunk_index.cast("string")))


def record_id(workspace_id: Column, document_id: Column, chunk: Column) -> Column:
    return F.concat_ws(":", strip(workspace_id), strip(document_id), strip(chunk))
