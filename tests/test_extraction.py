import pytest
from pyspark.sql import functions as F

from tallyweave import schemas as S
from tallyweave.operators import extraction, validation
from tallyweave.operators.extraction import extract_fields
from tests.helpers import record


def documents(spark, *all_lines):
    rows = [(i, lines, "\n".join(lines)) for i, lines in enumerate(all_lines)]
    return spark.createDataFrame(rows, "doc_id int, lines array<string>, text string")


INVOICE = [
    "Acme Cloud GmbH",
    "INVOICE",
    "Invoice No.: AB-INV-00017",
    "Invoice Date: 2026-03-05",
    "FX Rate: 1.0123",
    "Description Qty Unit Price Line Total",
    "Cloud platform support 9 112.14 € 1,009.26 €",
    "Subtotal 1,009.26 €",
    "Tax 0.00 €",
    "TOTAL DUE 1,009.26 €",
]


def test_whole_document(spark):
    row = extract_fields(documents(spark, INVOICE)).first()
    assert (row.invoice_id, row.invoice_date, row.vendor) == (
        "AB-INV-00017",
        "2026-03-05",
        "Acme Cloud GmbH",
    )
    assert (row.amount, row.currency, row.quantity, row.fx_rate) == (1009.26, "EUR", 9, 1.0123)


def test_nothing_to_read(spark):
    row = extract_fields(documents(spark, ["??"])).first()
    assert (row.invoice_id, row.invoice_date, row.vendor) == (
        S.NO_INVOICE_ID,
        S.NO_DATE,
        S.NO_VENDOR,
    )
    assert (row.amount, row.currency, row.quantity, row.fx_rate) == (0.0, "EUR", 1, 1.0)
    bare = extract_fields(documents(spark, ["??"]), sentinels=False).first()
    assert bare.invoice_id is None and bare.amount is None and bare.quantity is None


def test_total_line_choice(spark):
    docs = documents(
        spark,
        ["Subtotal 10.00", "TOTAL DUE 12.00", "TOTAL 99.00"],
        ["T0TAL DUE 55.10", "Subtotal 50.00", "Cash 60.00"],  # misread, only resembles
        ["Item 3.00", "Thing 7.25"],  # no total: largest amount
        ["TOTAL", "5.00"],  # the line that names it has no amount
        ["Total 5.00", "Total 7.00"],  # equal scores: last in text order
        [],
    )
    got = extraction.with_total(docs).orderBy("doc_id").collect()
    assert [r.amount for r in got] == [12.0, 55.1, 7.25, 5.0, 7.0, None]


def test_quantity(spark):
    docs = documents(
        spark,
        ["Description Qty Price", "Widget 4 3.50 14.00"],
        ["Description Quantity", "Widget 0 7", "TOTAL 8"],
        ["Description Qty", "Total 8", "Qty: 6"],
        ["QUANTITY = 12"],
        ["nothing"],
    )
    got = docs.select("doc_id", extraction.extract_quantity(F.col("lines")).alias("q"))
    assert [r.q for r in got.orderBy("doc_id").collect()] == [4, 7, 6, 12, None]


def test_fx_rate_and_vendor(spark):
    docs = documents(
        spark,
        ["INVOICE 7", "Date 1", "ab", "North Wind Ltd", "FX RATE 0,9611"],
        ["Exchange Rate: 5000", "Exchange Rate: 1.15049"],
    )
    rows = docs.select(
        "doc_id",
        extraction.extract_vendor(F.col("lines")).alias("v"),
        extraction.extract_fx_rate(F.col("lines")).alias("r"),
    ).orderBy("doc_id").collect()
    assert [(r.v, r.r) for r in rows] == [
        ("North Wind Ltd", 0.9611),
        ("Exchange Rate: 5000", 1.1505),
    ]


def test_invoice_ids(spark):
    texts = ["Invoice No.: LX-INV-00001", "BILL # 77/A-12", "see ABC-2020/17 here", "INV 12", "x"]
    docs = documents(spark, *[[t] for t in texts])
    got = docs.select("doc_id", extraction.extract_invoice_id(F.col("text")).alias("i"))
    assert [r.i for r in got.orderBy("doc_id").collect()] == [
        "LX-INV-00001",
        "77A-12",
        "ABC-202017",
        None,
        None,
    ]


def test_tokens_to_lines_and_text(spark):
    tokens = spark.createDataFrame(
        [
            (1, 0, "Total", 90.0, 1, 1, 1),
            (1, 1, " ", 99.0, 1, 1, 1),
            (1, 2, "9.00", 10.0, 1, 1, 1),
            (1, 3, "Thanks", 50.0, 1, 2, 1),
            (2, 0, "low", 5.0, 1, 1, 1),
        ],
        "doc_id int, pos int, text string, conf double, block_num int, par_num int, line_num int",
    )
    lines = extraction.assemble_lines(tokens).orderBy("doc_id", "par_num").collect()
    assert [r.line_text for r in lines] == ["Total 9.00", "Thanks", "low"]
    docs = extraction.documents_from_tokens(tokens).orderBy("doc_id").collect()
    assert [(r.text, r.n_words, r.mean_confidence) for r in docs] == [
        ("Total Thanks", 2, 70.0),
        ("", 0, 0.0),
    ]


def test_chunks_and_boxes(spark):
    df = spark.createDataFrame(
        [(list("abcdefghij"), [50, 20, 10, 2000], 100, 1000), ([], [0, 0, 1, 1], 0, 10)],
        "words array<string>, box array<int>, w int, h int",
    )
    rows = df.select(
        extraction.chunk_words(F.col("words")).alias("lines"),
        extraction.normalize_box(F.col("box"), F.col("w"), F.col("h")).alias("box"),
    ).collect()
    assert rows[0].lines == ["a b c d e f g h", "i j"] and rows[1].lines == []
    assert rows[0].box == [100, 20, 500, 1000] and rows[1].box is None


FIELDS = "invoice_id string, invoice_date string, vendor string, amount double, currency string, quantity int, fx_rate double"


def test_validation(spark):
    good = ("LX-INV-1", "2026-01-01", "Acme", 5.0, "EUR", 1, 1.0)
    bad = ("UNKNOWN-INVOICE-ID", "1/1/26", "UNKNOWN-VENDOR", 0.0, "CHF", 0, 0.001)
    none = (None,) * 7
    df = spark.createDataFrame([(0, *good), (1, *bad), (2, *none)], f"i int, {FIELDS}")
    flags = df.select("i", *[c.alias(n) for n, c in validation.validation_flags().items()])
    rows = [tuple(r)[1:] for r in flags.orderBy("i").collect()]
    assert rows == [(True,) * 7, (False,) * 7, (False,) * 7]


def test_fallback_only_for_three_fields(spark):
    first = spark.createDataFrame(
        [(1, "?", "1/1/26", "UNKNOWN-VENDOR", 0.0, "CHF", 0, 1.0)], f"doc_id int, {FIELDS}"
    )
    second = spark.createDataFrame(
        [(1, "LX-INV-1", "2026-01-01", "Acme", -1.0, "EUR", 5, 2.0)], f"doc_id int, {FIELDS}"
    )
    row = validation.with_fallback(first, second, "doc_id").first()
    assert (row.vendor, row.invoice_date, row.amount) == ("Acme", "2026-01-01", 0.0)
    assert (row.invoice_id, row.currency, row.quantity) == ("?", "CHF", 0)
    assert [f.field for f in row.fallbacks] == ["vendor", "invoice_date"]


def test_record_helper_is_complete():
    assert len(record()) == len(S.RECORD_FIELDS)


@pytest.mark.parametrize(
    "read", [extraction.detect_currency, extraction.norm_currency, extraction.extract_invoice_id]
)
def test_a_text_is_put_in_upper_case_once(spark, read):
    """As often as it is written in the plan it would be done for each row."""
    df = spark.createDataFrame([("x",)], "v string").select(read(F.col("v")).alias("out"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1


def test_a_line_is_normalised_once_to_find_the_end_of_items(spark):
    df = spark.createDataFrame([(["x"],)], "v array<string>").select(extraction.extract_quantity(F.col("v")).alias("out"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 2
