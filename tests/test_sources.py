"""Files, assembly, whole runs and arrivals."""

import csv
import io
import random
import struct

import duckdb
import pytest
from helpers import GOLDEN, parsed
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import rows_of
from ledgerleaf.operators import embed, store
from ledgerleaf.plans import ingest
from ledgerleaf.sources import admit, assemble, corpus, decode
from ledgerleaf.streaming import arrivals

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480) + b"\x08\x06\0\0\0"
FILES = {
    "a.txt": "Größe\n5".encode(),
    "b.txt": "Größe".encode("latin-1"),
    "c.csv": b'Name , Qty\n\n"x, ""y""\nz",1,extra\n , \n,,\n',
    "d.png": PNG,
    "e.png": b"nothing",
    "f.exe.pdf": b"x",
    "g.tiff": b"x",
    "h.txt": b"",
    "i.pdf": b"%PDF",
}


@pytest.fixture()
def folder(tmp_path):
    for name, body in FILES.items():
        (tmp_path / name).write_bytes(body)
    return str(tmp_path)


def test_files_to_parsed_documents(spark, folder):
    found = admit.scan_files(spark, folder).unionByName(admit.empty_files(spark, folder, "*.txt"))
    files = arrivals.as_uploads(found, "ws")
    done = {r.filename: r.reject_reason for r in admit.checked(files).collect()}
    assert done["f.exe.pdf"] == "Forbidden dangerous extension detected: '.exe'"
    assert done["h.txt"] == "Uploaded file is empty."
    assert [k for k, v in done.items() if v is None].__len__() == 7
    good, _ = admit.split_admitted(files)
    cat = admit.catalog(good)
    got = {r.storage_path.rsplit("/", 1)[1]: r for r in decode.parse_files(cat).collect()}
    assert got["a.txt"].pages[0].text == "Größe\n5" and got["a.txt"].metadata["line_count"] == "2"
    assert got["b.txt"].pages[0].text == "Größe"
    assert got["c.csv"].tables[0].headers == ["Name", "Qty"]
    assert got["c.csv"].tables[0].rows == [['x, "y"\nz', "1", "extra"], ["", ""]]
    assert got["c.csv"].metadata["total_rows"] == "3"
    assert (got["d.png"].image_metadata.width, got["d.png"].image_metadata.height) == (640, 480)
    assert got["d.png"].pages[0].text == "[IMAGE FILE: PNG (640x480px)]"
    assert got["e.png"].parse_error == "corrupted_image"
    assert got["g.tiff"].parse_error == "Unsupported document extension for parsing: '.tiff'"
    assert got["i.pdf"].parse_error == "not_decoded"
    asked = spark.createDataFrame([(f"file:{folder}/a.txt",), (f"file:{folder}/zz.txt",)], "path string")
    assert [r.path[-6:] for r in admit.missing_files(asked, files).collect()] == ["zz.txt"]


def test_file_names(spark):
    names = ["../x/..evil.pdf", "a..pdf", "a.", "..", "", "ü.txt", "x.tar.GZ", "plain"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    clean = admit.sanitize(F.col("n"))
    got = df.select("n", clean, admit.suffix(clean), admit.suffixes(clean)).collect()
    assert [tuple(r)[1:] for r in got] == [
        ("evil.pdf", ".pdf", [".pdf"]), ("a..pdf", ".pdf", [".", ".pdf"]), ("a.", "", []),
        ("unnamed_file", "", []), ("unnamed_file", "", []), ("_.txt", ".txt", [".txt"]),
        ("x.tar.GZ", ".gz", [".tar", ".gz"]), ("plain", "", []),
    ]


def test_every_suffix_counts(spark):
    df = spark.createDataFrame([("a" + ".x" * 1001 + ".exe.pdf",)], "n string")
    reason = admit.reject_reason(F.lit(5), F.col("n"), F.lit("application/pdf"))
    assert "'.exe'" in df.select(reason).first()[0]


def test_sparse_cells_keep_their_columns(spark):
    rows = [("d", 1, "S", 0, 0, "h1"), ("d", 1, "S", 0, 1, "h2"), ("d", 1, "S", 0, 2, "h3"), ("d", 1, "S", 1, 0, "a"), ("d", 1, "S", 1, 2, "c"), ("d", 2, "T", 0, 0, None)]
    rows += [("big", 1, "S", i, 0, "x" * 5000) for i in range(3000)]
    cells = spark.createDataFrame(rows, "document_id string, sheet_no int, sheet_name string, row_no int, col_no int, value string")
    got = {r.document_id: r for r in assemble.worksheets(cells).collect()}
    assert [list(x) for x in got["d"].tables[0].rows] == [["a", "", "c"]] and got["d"].metadata["sheet_names"] == "S, T"
    assert got["big"].parse_error is None and len(got["big"].tables[0].rows) == 2999


def test_orders_with_many_line_numbers_become_several_documents(spark, tmp_path):
    line = ", ".join(
        f"{v} AS {n}" for n, v in (
            ("l_partkey", "7L"), ("l_suppkey", "1L"), ("l_linenumber", "cast(1 + id % 2500 as int)"), ("l_quantity", "2D"),
            ("l_extendedprice", "10.5D"), ("l_returnflag", "'A'"), ("l_linestatus", "'F'"),
        )
    )
    path = str(tmp_path)
    spark.sql(f"SELECT IF(id < 2500, 1L, 2L) AS l_orderkey, {line} FROM range(2503)").repartition(3).write.parquet(f"{path}/lineitem.parquet")
    spark.sql("SELECT id AS o_orderkey, id AS o_custkey, timestamp_ntz'2020-01-02 00:00:00' AS o_orderdate FROM range(5)").write.parquet(f"{path}/orders.parquet")
    docs = corpus.business_documents(spark, path).collect()
    assert sorted(d.n_lines for d in docs if d.key == 1) == [500, 1000, 1000]
    assert [d.n_lines for d in docs if d.key == 2] == [3] and len({d.document_id for d in docs}) == 4
    # The same table, checked against the SQL.
    db = duckdb.connect()
    for t in ("lineitem", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    for name in ("a9_csv_documents", "a10_worksheets", "a15_corpus", "i9_scoped_totals"):
        df, rel = entry.queries()[name](spark, path), db.sql(entry.oracle_sql()[name])
        assert rows_of(df.columns, df.collect()) == rows_of(list(rel.columns), rel.fetchall()), name


def run(spark, path, make=None, **columns):
    item = [["part", "1", "102000", "102000.00"]]
    docs = parsed(spark, ("good", GOLDEN, item), ("halt", "Invoice\n" + GOLDEN[26:]), ("lost", ""))
    docs = docs.withColumn("parse_error", F.when(F.col("document_id") == "lost", "corrupted_csv"))
    return ingest.ingest(docs, make or embed.hashing_embedder(8), dimensions=8, vector_path=path)


def test_ingestion_halts_per_document(spark, tmp_path):
    path = str(tmp_path / "v")
    out = run(spark, path)
    results = {r.document_id: r for r in out.results.collect()}
    assert {k: r.failed_stage for k, r in results.items()} == {
        "good": None, "halt": "validate_document", "lost": "parse_document",
    }
    assert results["lost"].error_message == "Pipeline stopped at stage 'parse_document': corrupted_csv"
    stages = {}
    for r in out.audit.collect():
        stages.setdefault(r.document_id, []).append((r.stage_no, r.tool_name, r.success))
    assert {k: len(v) for k, v in stages.items()} == {"good": 8, "halt": 5, "lost": 2}
    assert all(s for _, _, s in stages["halt"])
    before = store.table(spark, path).count()
    run(spark, path)
    assert store.table(spark, path).count() == before == out.chunks.count() > 0


def test_failed_embedding_stops_its_document_only(spark, tmp_path):
    def make():
        def broken(texts):
            raise RuntimeError("key=secret")

        return broken

    out = run(spark, str(tmp_path / "v"), make)
    good = next(r for r in out.results.collect() if r.document_id == "good")
    assert good.failed_stage == "generate_embeddings" and "secret" not in good.error_message
    assert out.vectors.count() == 0


def test_arrivals_are_taken_once(spark, folder, tmp_path_factory):
    base = tmp_path_factory.mktemp("stream")
    out, state = str(base / "out"), str(base / "state")

    def go():
        arrivals.ingest_arrivals(
            spark, folder, state, lambda docs, n: docs.write.mode("append").parquet(out), workspace_id="ws", max_files=4
        ).awaitTermination()
        return spark.read.parquet(out).count()

    # Refused files are rows with a reason.
    assert go() == 8 == go()
    assert spark.read.parquet(out).filter("reject_reason is not null").count() == 1


def test_a_field_may_be_as_long_as_a_file(spark, tmp_path):
    (tmp_path / "long.csv").write_text("Name,Text\na,\"" + "x\n" * 500_000 + "\"\n")
    files = arrivals.as_uploads(admit.scan_files(spark, str(tmp_path)), "ws")
    got = decode.parse_files(admit.catalog(admit.split_admitted(files)[0])).collect()
    assert [r.parse_error for r in got] == [None]
    assert len(got[0].tables[0].rows[0][1]) == 999_999


def test_csv_rows_equal_a_reader_of_the_format(spark):
    draw = random.Random(5)
    bodies = ["".join(draw.choice('ab",\n\r x"\n,é') for _ in range(draw.randrange(14))) for _ in range(2000)]
    # Lone carriage returns, open quotes, quotes within fields, long fields, many fields, no text.
    bodies += ['"a,"\rx"', "a\r", "a\r\r\nb", '"x,', "a,b,", 'a""b,"c"d"e"\n', '"' + '""' * 200_000 + 'z",1\n', "a," * 50_000, "", "\n"]

    def want(body):
        csv.field_size_limit(10**9)
        try:
            return [row for row in csv.reader(io.StringIO(body)) if any(row)]
        except csv.Error:
            return None

    df = spark.createDataFrame([*enumerate(bodies), (-1, None)], "n int, body string").repartition(4)
    got = {r.n: r.rows for r in df.select("n", decode.csv_rows(F.col("body")).alias("rows")).collect()}
    assert got.pop(-1) is None
    assert [n for n, body in enumerate(bodies) if got[n] != want(body)] == []


def test_image_headers(spark):
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xff\xc2\0\x11\x08" + struct.pack(">HH", 300, 70_000 % 65536) + b"\x03"
    files = {
        "png": (PNG, (640, 480, "PNG")),
        "huge": (PNG[:16] + b"\xff" * 8 + PNG[24:], None),
        "jpeg": (jpeg, (4464, 300, "JPEG")),
        "cut": (jpeg[:14], None),
        "gif": (b"GIF89a" + struct.pack("<HH", 300, 2), (300, 2, "GIF")),
        "bmp": (b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -7), (5, 7, "BMP")),
        "none": (None, None),
        "empty": (b"", None),
    }
    df = spark.createDataFrame([(k, bytearray(v[0]) if v[0] is not None else None) for k, v in files.items()], "k string, content binary")
    got = {r.k: r.i and tuple(r.i) for r in df.select("k", decode.image_header(F.col("content")).alias("i")).collect()}
    assert got == {k: v[1] for k, v in files.items()}


def test_parsing_reads_files_once(spark, folder):
    files = arrivals.as_uploads(admit.scan_files(spark, folder), "ws")
    plan = decode.parse_files(admit.catalog(admit.split_admitted(files)[0]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan binaryFile") == 1 and plan.count("ArrowEvalPython") == 1


def test_steps_of_a_run_are_counted(spark, tmp_path):
    out = run(spark, str(tmp_path / "v"))
    steps = {(r.step, r.counter): r.value for r in out.steps.collect()}
    assert steps.pop(("stored", None)) is None
    assert {k: v for k, v in steps.items() if v} == {
        ("reviewed", "rows"): 3, ("reviewed", "validate_document"): 1, ("reviewed", "parse_document"): 1,
        ("embedded", "rows"): out.chunks.count(),
    }
    assert out.steps.filter("ms <= 0 or started_at is null").isEmpty()
    none = ingest.ingest(parsed(spark, ("x", "")).limit(0), embed.hashing_embedder(8), dimensions=8)
    assert {r.value for r in none.steps.collect()} == {0}
