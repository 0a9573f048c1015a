"""Spark types of the document model."""

from pyspark.sql import types as T

S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


PAGE = _struct(page_number=T.IntegerType(), text=S)
PAGES = T.ArrayType(PAGE)
TABLE = _struct(
    table_index=T.IntegerType(),
    page_number=T.IntegerType(),
    headers=T.ArrayType(S),
    rows=T.ArrayType(T.ArrayType(S)),
)
TABLES = T.ArrayType(TABLE)
IMAGE = _struct(width=T.IntegerType(), height=T.IntegerType(), format=S, size_bytes=T.LongType())
METADATA = T.MapType(S, S)
PARSED = _struct(
    document_id=S,
    workspace_id=S,
    storage_path=S,
    file_extension=S,
    mime_type=S,
    page_count=T.IntegerType(),
    pages=PAGES,
    tables=TABLES,
    image_metadata=IMAGE,
    metadata=METADATA,
    parsing_status=S,
    parse_error=S,
)
LINE_ITEM = _struct(
    item_number=T.IntegerType(),
    description=S,
    hsn_sac=S,
    quantity=S,
    unit_price=S,
    amount=S,
)
ISSUE = _struct(rule_id=S, severity=S, field=S, message=S)
IMAGE_HEADER = _struct(width=T.IntegerType(), height=T.IntegerType(), format=S)
IMAGE_SIZE = _struct(width=T.IntegerType(), height=T.IntegerType())
