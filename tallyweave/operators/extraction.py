"""From token and document tables to the seven invoice fields.

Everything works on one row's arrays, so extraction needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave import schemas as S
from tallyweave.functions.arrays import let
from tallyweave.functions.dates import extract_date
from tallyweave.functions.fuzzy import best_similarities
from tallyweave.functions.money import HAS_MONEY_PATTERN, money_values, parse_amount, to_double
from tallyweave.functions.text import contains_any, first_of, letter_count, norm_line, strip
from tallyweave.operators.runs import runs

# Currency markers, tried in this order.
CURRENCY_MARKERS = {
    "EUR": ["EUR", "€", "EURO"],
    "USD": ["USD", "US$", "$"],
    "GBP": ["GBP", "£"],
    "PLN": ["PLN", "ZŁ", "ZL"],
    "MYR": ["MYR", "RM"],
}

# Where an invoice id may stand, tried in this order.
INVOICE_ID_PATTERNS = [
    r"(?iU)(?:INVOICE\s*(?:NO\.?|NUMBER|#|ID)?\s*[:#-]?\s*)([A-Z]{1,10}[-_][A-Z0-9_-]{3,})",
    r"(?iU)(?:INVOICE|INV|RECEIPT|BILL)\s*(?:NO\.?|NUMBER|#|ID)?\s*[:#-]?\s*"
    r"([A-Z0-9][A-Z0-9/_-]{2,})",
    r"(?iU)\b([A-Z]{2,12}(?:[-_/][A-Z0-9]{2,})+)\b",
]

# Words that name, or rule out, parts of a document.
TOTAL_KEYWORDS = [
    "TOTAL DUE",
    "GRAND TOTAL",
    "TOTAL AMOUNT",
    "AMOUNT DUE",
    "TOTAL",
    "NET TOTAL",
    "BALANCE DUE",
]
NOT_A_VENDOR = [
    "INVOICE",
    "RECEIPT",
    "DATE",
    "TOTAL",
    "TAX",
    "CASH",
    "VISA",
    "MASTERCARD",
    "THANK",
    "DESCRIPTION",
    "PAYMENT",
]
END_OF_ITEMS = ["SUBTOTAL", "TAX", "TOTAL", "PAYMENT", "PLEASE", "GENERATED"]

# Stand-alone quantities and labelled quantities and rates.
WHOLE_NUMBER = r"(?<![.\d])\b(\d{1,3})\b(?![.\d])"
LABELLED_QUANTITY = r"(?iU)\b(?:QTY|QUANTITY)\s*[:=]?\s*(\d{1,4})\b"
LABELLED_FX_RATE = r"(?iU)\b(?:FX\s*RATE|EXCHANGE\s*RATE)\s*[:=]?\s*(\d+(?:[.,]\d{1,6})?)\b"


def _by_marker(upper: Column, default: str) -> Column:
    found = F.coalesce(
        *[
            F.when(contains_any(upper, markers), F.lit(code))
            for code, markers in CURRENCY_MARKERS.items()
        ]
    )
    return F.coalesce(found, F.lit(default))


def detect_currency(text: Column, default: str = S.DEFAULT_CURRENCY) -> Column:
    """Currency of a document: a stand-alone code first, then any marker."""

    def read(upper: Column) -> Column:
        by_code = F.coalesce(
            *[F.when(upper.rlike(rf"(?U)\b{code}\b"), F.lit(code)) for code in S.CURRENCIES]
        )
        return F.coalesce(by_code, _by_marker(upper, default))

    return let(F.upper(text), read)


def norm_currency(text: Column, default: str = "MYR") -> Column:
    """Currency of a total's text span: any marker."""
    return let(F.upper(text), lambda upper: _by_marker(upper, default))


def extract_invoice_id(text: Column) -> Column:
    """First pattern whose cleaned match has four characters or more, or NULL."""

    def read(upper: Column) -> Column:
        tries = []
        for pattern in INVOICE_ID_PATTERNS:
            found = F.regexp_replace(F.regexp_extract(upper, pattern, 1), r"[^A-Z0-9_-]", "")
            tries.append(let(found, lambda v: F.when(F.length(v) >= 4, v)))
        return F.coalesce(*tries)

    return let(F.upper(text), read)


def extract_vendor(lines: Column) -> Column:
    """Header line, else the first plausible one of ten lines; NULL if none."""
    plausible = F.filter(
        F.transform(F.slice(lines, 1, 10), strip),
        lambda line: (F.length(line) >= 3)
        & ~contains_any(F.upper(line), NOT_A_VENDOR)
        & (letter_count(line) >= 3),
    )

    def header(first: Column) -> Column:
        is_name = (F.length(first) >= 3) & ~F.contains(F.upper(first), F.lit("INVOICE"))
        return F.when(is_name, first)

    name = F.coalesce(let(strip(first_of(lines)), header), first_of(plausible))
    return F.substring(name, 1, 120)


def _line_facts(line: Column) -> Column:
    """What a line says as a total: its amount, and its score apart from likeness."""

    def judged(upper: Column) -> Column:
        def points(term: str, value: float) -> Column:
            return F.when(F.contains(upper, F.lit(term)), F.lit(value)).otherwise(F.lit(0.0))

        extra = (
            F.lit(20.0)
            + points("TOTAL DUE", 100.0)
            + points("SUBTOTAL", -40.0)
            + points("TAX", -40.0)
        )
        return F.struct(
            line.alias("line"),
            parse_amount(F.try_element_at(money_values(line), F.lit(-1))).alias("amount"),
            extra.alias("extra"),
            contains_any(upper, TOTAL_KEYWORDS).alias("named"),
        )

    return let(norm_line(line), judged)


def _best_total(facts: Column, similar: Callable[[Column, Column], Column]) -> Column:
    """Amount of the best line; of equal ones the last in text order."""
    scored = F.transform(
        facts,
        lambda f, i: F.struct(
            (f["extra"] + F.when(f["named"], F.lit(100.0)).otherwise(similar(f, i))).alias("score"),
            f["line"].alias("line"),
            f["amount"].alias("amount"),
        ),
    )
    usable = F.filter(
        scored, lambda s: (s["score"] >= S.TOTAL_LINE_SCORE) & s["amount"].isNotNull()
    )
    return F.array_max(usable)["amount"]


def with_total(df: DataFrame, lines: str = "lines", out: str = "amount") -> DataFrame:
    """Add the document total: the amount of the line that looks most like one.

    Only lines with an amount count.  One that names a total literally, without
    being a subtotal or tax line, beats every line that only resembles one, so
    the similarity UDF sees just the unnamed amount lines of the documents that
    have no such line.
    """
    money_lines = F.filter(F.col(lines), lambda line: line.rlike(HAS_MONEY_PATTERN))
    facts = df.withColumn("_facts", F.transform(money_lines, _line_facts))
    decided = F.exists(
        "_facts", lambda f: f["named"] & (f["extra"] >= 20.0) & f["amount"].isNotNull()
    )
    open_lines = F.transform(
        "_facts", lambda f: F.when(~f["named"] & f["amount"].isNotNull(), norm_line(f["line"]))
    )
    likened = facts.withColumn(
        "_similar",
        best_similarities(
            F.when(~decided, open_lines),
            F.array(*[F.lit(k) for k in TOTAL_KEYWORDS]),
            # A line that names no total has 20 points at most, and is not usable below this likeness.
            F.lit(S.TOTAL_LINE_SCORE - 20.0),
        ),
    )
    largest = F.array_max(
        F.transform(F.flatten(F.transform(F.col(lines), money_values)), parse_amount)
    )
    total = F.coalesce(
        _best_total(
            F.col("_facts"),
            lambda f, i: F.coalesce(F.get(F.col("_similar"), i), F.lit(0.0)),
        ),
        largest,
    )
    return likened.withColumn(out, total).drop("_facts", "_similar")


def extract_quantity(lines: Column) -> Column:
    """Quantity of the first item row, else a labelled one; NULL if none."""
    is_header = F.transform(
        F.transform(lines, norm_line),
        lambda line: F.contains(line, F.lit("DESCRIPTION"))
        & contains_any(line, ["QTY", "QUANTITY"]),
    )

    def first_positive(values: Column) -> Column:
        numbers = F.transform(values, lambda v: v.try_cast("int"))
        return first_of(F.filter(numbers, lambda n: n > 0))

    def below(header: Column) -> Column:
        return F.when(header > 0, F.slice(lines, (header + 1).cast("int"), F.size(lines)))

    def above_end(rows: Column) -> Column:
        ends = F.transform(
            rows, lambda line: let(norm_line(line), lambda upper: contains_any(upper, END_OF_ITEMS))
        )
        return let(
            F.array_position(ends, True),
            lambda end: F.when(end > 0, F.slice(rows, F.lit(1), (end - 1).cast("int"))).otherwise(
                rows
            ),
        )

    items = let(let(F.array_position(is_header, True), below), above_end)
    whole = F.flatten(
        F.transform(items, lambda line: F.regexp_extract_all(line, F.lit(WHOLE_NUMBER), F.lit(1)))
    )
    labelled = F.transform(lines, lambda line: F.regexp_extract(line, LABELLED_QUANTITY, 1))
    return F.coalesce(first_positive(whole), first_positive(labelled))


def extract_fx_rate(lines: Column) -> Column:
    """First labelled exchange rate in range, four decimals; NULL if none."""
    rates = F.transform(
        lines,
        lambda line: to_double(F.translate(F.regexp_extract(line, LABELLED_FX_RATE, 1), ",", ".")),
    )
    return F.round(first_of(F.filter(rates, lambda r: r.between(0.01, 1000))), 4)


def chunk_words(words: Column, size: int = 8) -> Column:
    """Lines of ``size`` words, for documents that come without lines."""

    def chunked(w: Column) -> Column:
        starts = F.when(
            F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(size))
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " "))

    return let(words, chunked)


def extract_fields(
    documents: DataFrame, text: str = "text", lines: str = "lines", sentinels: bool = True
) -> DataFrame:
    """Add the seven record fields to a document table.

    Inside the engine an unreadable field is NULL; ``sentinels`` writes the
    fixed placeholder values instead.
    """
    found = with_total(
        documents.withColumns(
            {
                "invoice_id": extract_invoice_id(F.col(text)),
                "invoice_date": F.date_format(extract_date(F.col(text)), "yyyy-MM-dd"),
                "vendor": extract_vendor(F.col(lines)),
                "currency": detect_currency(F.col(text)),
                "quantity": extract_quantity(F.col(lines)),
                "fx_rate": extract_fx_rate(F.col(lines)),
            }
        ),
        lines=lines,
    )
    return with_sentinels(found) if sentinels else found


def with_sentinels(fields: DataFrame) -> DataFrame:
    """Write the placeholder for every absent field."""
    defaults = {
        "invoice_id": S.NO_INVOICE_ID,
        "invoice_date": S.NO_DATE,
        "vendor": S.NO_VENDOR,
        "amount": S.NO_AMOUNT,
        "currency": S.DEFAULT_CURRENCY,
        "quantity": S.DEFAULT_QUANTITY,
        "fx_rate": S.DEFAULT_FX_RATE,
    }
    return fields.withColumns(
        {name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()}
    )


def _in_order(words: str = "text") -> Column:
    """The words of a group of runs, by position."""
    entries = F.flatten(F.collect_list(F.arrays_zip("pos", words)))
    return F.array_join(F.transform(F.array_sort(entries), lambda w: w[words]), " ")


def assemble_lines(tokens: DataFrame) -> DataFrame:
    """One row per (document, block, paragraph, line) with its words in order.

    Blank words are dropped; confidence does not matter here.  Neighbouring
    words of a line are shuffled as one row; any order of tokens is right.
    """
    line = ["doc_id", "block_num", "par_num", "line_num"]
    words = tokens.withColumn("text", strip(F.col("text"))).filter(F.col("text") != "")
    found = runs(words.select(*line, "pos", "text"), line, ["pos", "text"])
    # Shuffled before it is grouped: collecting on the map side too would sort every run there.
    return found.repartition(*line).groupBy(*line).agg(_in_order().alias("line_text"))


def documents_from_tokens(
    tokens: DataFrame, min_confidence: float = S.MIN_WORD_CONFIDENCE
) -> DataFrame:
    """One row per document: text, word count and mean confidence of kept words.

    Neighbouring words of a document are shuffled as one row; any order of tokens is right.
    """
    text = strip(F.col("text"))
    kept = (text != "") & (F.coalesce(F.col("conf"), F.lit(-1.0)) >= min_confidence)
    marked = tokens.select(
        "doc_id", "pos", text.alias("text"), F.col("conf").cast("double").alias("conf"), kept.alias("kept")
    )
    found = runs(marked, ["doc_id"], ["pos", "text", "conf"], kept="kept").select(
        "doc_id",
        "pos",
        "text",
        F.size("text").alias("n"),
        F.size(F.array_compact("conf")).alias("rated"),
        F.aggregate("conf", F.lit(0.0), lambda total, c: total + F.coalesce(c, F.lit(0.0))).alias("conf"),
    )
    mean = F.try_divide(F.sum("conf"), F.sum("rated"))
    return found.repartition("doc_id").groupBy("doc_id").agg(
        _in_order().alias("text"),
        F.sum("n").alias("n_words"),
        F.coalesce(F.round(mean, 2), F.lit(0.0)).alias("mean_confidence"),
    )


def normalize_box(box: Column, width: Column, height: Column) -> Column:
    """Pixel corners on the 0..1000 grid, clamped, smaller corner first.

    NULL when the page has no positive size.
    """

    def scaled(place: int, size: Column) -> Column:
        value = (F.element_at(box, place) * 1000 / size).cast("int")
        return F.greatest(F.lit(0), F.least(F.lit(1000), value))

    x0, y0, x1, y1 = scaled(1, width), scaled(2, height), scaled(3, width), scaled(4, height)
    corners = F.array(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))
    return F.when((width > 0) & (height > 0), corners)
