"""Fixed values. They define the results and must not change."""

# --- Fixed values: document types -------------------------------------------
SALES_INVOICE = "Sales Invoice"
PURCHASE_INVOICE = "Purchase Invoice"
PURCHASE_ORDER = "Purchase Order"
QUOTATION = "Quotation"
SALES_ORDER = "Sales Order"
CREDIT_NOTE = "Credit Note"
DEBIT_NOTE = "Debit Note"
DELIVERY_CHALLAN = "Delivery Challan"
GOODS_RECEIPT_NOTE = "Goods Receipt Note"
RECEIPT = "Receipt"
PAYMENT_VOUCHER = "Payment Voucher"
EXPENSE_BILL = "Expense Bill"
BANK_STATEMENT = "Bank Statement"
GST_INVOICE = "GST Invoice"
GST_RETURN = "GST Return"
SALARY_SLIP = "Salary Slip"
UNKNOWN = "Unknown Document"

# --- Fixed values: document type groups -------------------------------------
INVOICE_FAMILY = (SALES_INVOICE, PURCHASE_INVOICE, GST_INVOICE, CREDIT_NOTE, DEBIT_NOTE)
ORDER_FAMILY = (PURCHASE_ORDER, QUOTATION, SALES_ORDER)
RECEIPT_FAMILY = (RECEIPT, PAYMENT_VOUCHER, EXPENSE_BILL)
HEADER_REQUIRED = (SALES_INVOICE, PURCHASE_INVOICE, GST_INVOICE) + ORDER_FAMILY + (DELIVERY_CHALLAN,)
TAX_REQUIRED = (GST_INVOICE, SALES_INVOICE, PURCHASE_INVOICE)

# --- Fixed values: scoring, in hundredths of a confidence point ---------------
PRIMARY_POINTS = 40
SECONDARY_POINTS = 15
HEADER_POINTS = 20
MAX_POINTS = 100
THRESHOLD_POINTS = 35

# --- Fixed values: keywords of the field look-ups -----------------------------
INVOICE_NO_KEYWORDS = ("INVOICE NO", "INVOICE NUMBER", "INV NO", "BILL NO", "INVOICE #")
PO_NO_KEYWORDS = ("PO NO", "PO NUMBER", "PURCHASE ORDER NO", "P.O. REF")
DATE_KEYWORDS = ("DATE", "INVOICE DATE", "BILL DATE", "DOCUMENT DATE", "STATEMENT DATE")
DUE_DATE_KEYWORDS = ("DUE DATE", "PAYMENT DUE")
TOTAL_KEYWORDS = ("TOTAL", "GRAND TOTAL", "NET AMOUNT", "NET PAYABLE", "BALANCE DUE")
SUBTOTAL_KEYWORDS = ("SUBTOTAL", "SUB TOTAL", "TAXABLE VALUE", "TAXABLE AMOUNT")
TAX_KEYWORDS = ("TAX AMOUNT", "TOTAL TAX", "GST AMOUNT", "CGST", "SGST", "IGST")

# --- Fixed values: validation ---------------------------------------------------
DEFAULT_CURRENCY = "INR"
SUPPORTED_CURRENCIES = ("INR", "USD", "EUR", "GBP", "AED")
AMOUNT_TOLERANCE = 0.05

# --- Fixed values: admission ----------------------------------------------------
MAX_FILE_BYTES = 10 * 1024 * 1024
TECHNICAL_CATEGORY = {
    ".pdf": "PDF",
    ".doc": "WORD",
    ".docx": "WORD",
    ".png": "IMAGE",
    ".jpg": "IMAGE",
    ".jpeg": "IMAGE",
    ".tiff": "IMAGE",
    ".bmp": "IMAGE",
    ".xlsx": "SPREADSHEET",
    ".xls": "SPREADSHEET",
    ".csv": "SPREADSHEET",
    ".txt": "TEXT",
}
ALLOWED_EXTENSIONS = tuple(TECHNICAL_CATEGORY)
MIME_EXTENSIONS = {
    "application/pdf": (".pdf",),
    "application/msword": (".doc",),
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": (".docx",),
    "image/png": (".png",),
    "image/jpeg": (".jpg", ".jpeg"),
    "image/tiff": (".tiff",),
    "image/bmp": (".bmp",),
    "application/vnd.ms-excel": (".xls",),
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": (".xlsx",),
    "text/csv": (".csv",),
    "text/plain": (".txt",),
}
BLOCKED_EXTENSIONS = (
    ".exe", ".bat", ".cmd", ".sh", ".bash", ".php", ".py", ".pl", ".rb",
    ".js", ".vbs", ".jar", ".ps1", ".msi", ".dll", ".so", ".com", ".scr",
    ".phtml", ".phar", ".asp", ".aspx", ".jsp", ".shtml",
)
DEFAULT_MIME = "application/octet-stream"
PARSER_KIND = {
    ".pdf": "PDF",
    ".docx": "DOCX",
    ".doc": "DOCX",
    ".xlsx": "EXCEL",
    ".xls": "EXCEL",
    ".csv": "CSV",
    ".txt": "TXT",
    ".png": "IMAGE",
    ".jpg": "IMAGE",
    ".jpeg": "IMAGE",
}

# --- Fixed values: rendering, chunking, embedding, retrieval ---------------------
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 150
MIN_BREAK = 100
DNS_NAMESPACE_HEX = "6ba7b8109dad11d180b400c04fd430c8"
MAX_EMBED_CHARS = 8000
EMBED_BATCH = 100
DEFAULT_DIMENSIONS = 768
DEFAULT_TOP_K = 5
MAX_TOP_K = 50
MAX_QUESTION_CHARS = 1000
NO_HIT_ANSWER = (
    "The available selected documents do not provide enough information to answer this question."
)

# --- Fixed values: stage names in audit rows and results ---------------------------
STAGES = (
    "upload_document",
    "parse_document",
    "classify_document",
    "extract_structured_data",
    "validate_document",
    "prepare_embedding_content",
    "generate_embeddings",
    "store_vectors",
)
QUERY_STAGE = "query_documents"
INGESTION_MODE = "DOCUMENT_INGESTION"
QUERY_MODE = "QUERY"
VALIDATION_HALT_MESSAGE = "Document validation failed due to business constraint violations."
BLANK_WORKSPACE_MESSAGE = "Mandatory field 'workspace_id' cannot be empty."
