"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave import schemas as S
from tallyweave.sources import views as V
from tallyweave.sources.views import pick, spread_table, table


def day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def order_key() -> Column:
    """The order behind a submission."""
    return F.floor(F.col("submission_id") / 2)


def pair(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Submissions and the ledger."""
    return V.submissions(spark, folder), V.ledger(spark, folder)


def misread(spark: SparkSession, folder: str) -> DataFrame:
    return V.corrupted(V.submissions(spark, folder))


def doubtful_misread(spark: SparkSession, folder: str) -> DataFrame:
    """Misread submissions that also lose their id, date, or several fields at once."""
    key = order_key()
    badly = key % 8 == 0

    def changed(name: str, when: Column, value: Column) -> Column:
        return F.when(when, value).otherwise(F.col(name))

    cents = F.round(F.col("amount") * 100) + 123450
    return misread(spark, folder).withColumns(
        {
            "invoice_id": changed("invoice_id", key % 2 == 0, F.replace("invoice_id", F.lit("INV-"), F.lit("INV-9"))),
            "invoice_date": changed("invoice_date", key % 3 == 0, F.date_add("invoice_date", 1)),
            "currency": changed("currency", badly, F.lit("MYR")),
            "quantity": changed("quantity", badly, F.col("quantity") + 50),
            "amount": changed("amount", badly, cents / 100),
            "fx_rate": changed("fx_rate", key % 16 == 0, F.lit(1.75)),
        }
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return V.invoice_text(V.submissions(spark, folder))


def raw_records(spark: SparkSession, folder: str) -> DataFrame:
    """Submissions as text columns, some of them unreadable or absent."""
    key = order_key()
    text = V.submissions(spark, folder).withColumns(
        {
            "invoice_date": day("invoice_date"),
            "amount": F.col("amount").cast("decimal(18,2)").cast("string"),
            "quantity": F.col("quantity").cast("string"),
            "fx_rate": F.col("fx_rate").cast("decimal(10,4)").cast("string"),
        }
    )

    def broken(name: str, every: int, value: Column) -> Column:
        return F.when(key % every == 0, value).otherwise(F.col(name))

    return text.withColumns(
        {
            "amount": broken("amount", 29, F.lit("n/a")),
            "quantity": broken("quantity", 31, F.lit("3.5")),
            "invoice_date": broken("invoice_date", 37, F.lit("someday")),
            "vendor": broken("vendor", 41, F.lit(None)),
        }
    )


def doubtful_records(spark: SparkSession, folder: str) -> DataFrame:
    """Submissions in which every field is implausible now and then."""
    key = order_key()

    def broken(name: str, every: int, value) -> Column:
        return F.when(key % every == 0, F.lit(value)).otherwise(F.col(name))

    return V.submissions(spark, folder).withColumns(
        {
            "invoice_id": broken("invoice_id", 17, "A1!"),
            "vendor": broken("vendor", 19, "4 u"),
            "invoice_date": F.when(key % 23 == 0, F.lit("2024/01/01")).otherwise(
                day("invoice_date")
            ),
            "amount": broken("amount", 29, 0.0),
            "currency": broken("currency", 31, "CHF"),
            "quantity": broken("quantity", 37, 20000),
            "fx_rate": broken("fx_rate", 41, 0.001),
        }
    )


def event_history(spark: SparkSession, folder: str) -> DataFrame:
    """The events as audit events: the user is the invoice, the type the vendor."""
    number = F.col("event_id")
    status = pick(number % 3, ["matched", "amount_mismatch", "unmatched"])
    told = pick(
        number % 3,
        [
            "{}",
            '{"root_cause":"amount_mismatch","severity":"high"}',
            '{"root_cause":"unmatched_invoice","severity":"medium"}',
        ],
    )
    return table(spark, folder, "events").select(
        F.concat(F.lit("evt-"), number.cast("string")).alias("audit_event_id"),
        F.col("ts").cast("timestamp").alias("event_timestamp"),
        F.concat(F.lit("run-"), (number % 10).cast("string")).alias("run_id"),
        F.concat(F.lit("INV-"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias(
            "invoice_id"
        ),
        F.col("ts").cast("date").alias("invoice_date"),
        F.col("event_type").alias("vendor"),
        F.col("value").alias("amount"),
        pick(F.col("user_id") % 4, ["EUR", "USD", "GBP", "PLN"]).alias("currency"),
        F.lit(1).alias("quantity"),
        F.lit(1.0).alias("fx_rate"),
        status.alias("reconciliation_status"),
        ((number % 101).cast("double") / 100).alias("confidence"),
        F.lit(None).cast("string").alias("best_match_invoice_id"),
        F.col("props").alias("discrepancy_details_json"),
        told.alias("investigation_json"),
        F.lit(None).cast("string").alias("dispute_letter_draft"),
    )


def ledger_history(spark: SparkSession, folder: str) -> DataFrame:
    """Every third ledger row as reconciled successfully before."""
    rows = V.ledger(spark, folder).filter(F.col("k") % 3 == 0)
    return rows.select(
        F.concat(F.lit("old-"), F.col("k").cast("string")).alias("audit_event_id"),
        F.col("invoice_date").cast("timestamp").alias("event_timestamp"),
        F.lit("run-0").alias("run_id"),
        "invoice_id",
        "vendor",
        "amount",
        "currency",
        F.lit("matched").alias("reconciliation_status"),
    )


def event_approvals(spark: SparkSession, folder: str) -> DataFrame:
    """The events as approval events."""
    number = F.col("event_id")
    return table(spark, folder, "events").select(
        F.concat(F.lit("apr-"), number.cast("string")).alias("approval_event_id"),
        F.col("ts").cast("timestamp").alias("approved_at"),
        F.concat(F.lit("reviewer-"), (F.col("user_id") % 7).cast("string")).alias("reviewer_id"),
        F.when(number % 2 == 0, F.lit(S.OPEN_REVIEW_ACTION))
        .otherwise(F.lit("closed"))
        .alias("action"),
        F.concat(F.lit("evt-"), number.cast("string")).alias("reconciliation_audit_event_id"),
        F.concat(F.lit("INV-"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias(
            "invoice_id"
        ),
        F.col("event_type").alias("reconciliation_status"),
        F.lit("draft").alias("final_draft"),
        F.when(number % 3 == 0, F.lit("prod")).otherwise(F.lit("local")).alias("environment"),
    )


def approval_requests(decided: DataFrame) -> DataFrame:
    """Requests to approve the mismatches, some twice, some with a blank draft."""
    key = order_key()
    times = F.when(key % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        decided.filter(F.col("status").endswith("_mismatch"))
        .withColumn("_n", F.explode(times))
        .select(
            (F.col("submission_id") * 2 + F.col("_n")).alias("request_id"),
            F.when(key % 17 == 0, F.lit("  ")).otherwise(F.lit(" please clarify ")).alias("draft"),
            F.when(key % 19 == 0, F.lit(""))
            .otherwise(F.concat(F.lit("evt-"), F.col("submission_id").cast("string")))
            .alias("audit_event_id"),
            F.concat(F.lit(" "), F.col("invoice_id")).alias("invoice_id"),
            F.col("status").alias("reconciliation_status"),
            F.concat(F.lit("reviewer-"), F.col("_n").cast("string")).alias("reviewer_id"),
            F.lit("local").alias("environment"),
        )
    )


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document with true labels, predicted labels and scores.

    Digits make a word a total, a capital a vendor, a full stop a date.
    Predictions forget every seventh word and invent every eleventh.
    """
    docs = spread_table(spark, folder, "documents", "doc_id", "lang", "text").select(
        "doc_id", F.col("lang").alias("split"), words_of(F.col("text")).alias("words")
    )

    def true_label(word: Column, i: Column) -> Column:
        kind = (
            F.when(word.rlike("[0-9]"), F.lit("TOTAL"))
            .when(word.rlike("^[A-Z]"), F.lit("VENDOR"))
            .when(word.endswith("."), F.lit("DATE"))
        )
        start = F.when(i % 3 == 0, F.lit("B-")).otherwise(F.lit("I-"))
        return F.coalesce(F.concat(start, kind), F.lit("O"))

    def predicted_label(word: Column, i: Column) -> Column:
        return (
            F.when(i % 7 == 0, F.lit("O"))
            .when(i % 11 == 0, F.lit("B-VENDOR"))
            .otherwise(true_label(word, i))
        )

    return docs.withColumns(
        {
            "labels": F.transform("words", true_label),
            "predicted": F.transform("words", predicted_label),
            "scores": F.transform("words", lambda w: (F.length(w) % 64).cast("double") / 64),
        }
    )


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as recognised words: ten words a line, four lines a paragraph."""
    return (
        spread_table(spark, folder, "documents", "doc_id", "text")
        .select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "text"))
        .select(
            "doc_id",
            "pos",
            "text",
            (((F.length("text") * 13 + F.col("pos")) % 101).cast("double")).alias("conf"),
            F.floor(F.col("pos") / 400).cast("int").alias("block_num"),
            (F.floor(F.col("pos") / 40) % 10).cast("int").alias("par_num"),
            (F.floor(F.col("pos") / 10) % 4).cast("int").alias("line_num"),
        )
    )


def entity_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Invoice documents as words, with the entities they are known to hold."""
    docs = documents(spark, folder).select("submission_id", "text")
    truth = V.submissions(spark, folder).select(
        "submission_id",
        F.col("vendor").alias("company"),
        F.date_format("invoice_date", "dd/MM/yyyy").alias("date"),
        F.col("amount").cast("decimal(18,2)").cast("string").alias("total"),
    )
    return docs.join(truth, "submission_id").select(
        "submission_id", words_of(F.col("text")).alias("words"), "company", "date", "total"
    )


def ledger_with_items(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger with line items in either spelling, or none."""
    cents = F.round(F.col("amount") * 100).cast("long")
    price = ((cents - cents % F.col("quantity")) / F.col("quantity")).cast("long") / 100
    short = F.to_json(
        F.array(
            F.struct(
                F.lit("Item A").alias("desc"), F.col("quantity").alias("qty"), price.alias("price")
            )
        )
    )
    long = F.to_json(
        F.array(
            F.struct(
                F.lit("Item B").alias("description"),
                F.col("quantity").alias("quantity"),
                price.alias("unit_price"),
            ),
            F.struct(
                F.lit("Fee").alias("description"),
                F.lit(1).alias("quantity"),
                F.lit(2.5).alias("unit_price"),
            ),
        )
    )
    return V.ledger(spark, folder).withColumn(
        "line_items", F.when(F.col("k") % 3 == 0, short).when(F.col("k") % 3 == 1, long)
    )


def noisy_values(spark: SparkSession, folder: str) -> DataFrame:
    """Dates and amounts of the ledger, written in many ways."""
    style = F.col("k") % 12
    d = F.col("invoice_date")
    formats = [
        "yyyy-MM-dd",
        "yyyy/M/d",
        "yyyy.MM.dd",
        "dd-MM-yyyy",
        "d/M/yyyy",
        "dd.MM.yyyy",
        "dd MMM yyyy",
        "d MMMM yyyy",
        "dd/MM/yy",
        "MMM d, yyyy",
        "MM/dd/yyyy",
    ]
    written = F
    for place, fmt in enumerate(formats):
        written = written.when(style == place, F.concat(F.lit("on "), F.date_format(d, fmt)))
    amount = F.col("amount")
    grouped = F.format_number(amount, 2)
    european = F.translate(F.translate(F.translate(grouped, ",", "_"), ".", ","), "_", ".")
    plain = F.format_string("%.2f", amount)
    return V.ledger(spark, folder).select(
        "k",
        written.otherwise(F.lit("no date 12-34")).alias("date_text"),
        F.when(style % 4 == 0, plain)
        .when(style % 4 == 1, grouped)
        .when(style % 4 == 2, european)
        .otherwise(F.concat(F.lit("about "), plain))
        .alias("amount_text"),
        F.concat(
            F.lit("ref 12.34 then "),
            F.when(style % 3 == 0, F.concat(F.lit("-"), plain)).otherwise(european),
            F.lit(" RM due"),
        ).alias("total_text"),
    )


def span_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Words of invoices in many ways of writing, labelled; some lack a type of entity.

    A cheaper total of no confidence stands in front of the right one.
    """
    rows = noisy_values(spark, folder).join(V.ledger(spark, folder).select("k", "vendor", "currency"), "k")

    def piece(text: Column, kind: str, absent: int, eighths: Column | int) -> list[Column]:
        words = words_of(text)
        label = F.when(F.col("k") % absent == 0, F.lit("O"))
        score = (F.lit(eighths) if isinstance(eighths, int) else eighths).cast("double") / 8
        return [
            words,
            F.transform(words, lambda _, i: label.otherwise(F.concat(F.when(i == 0, "B-").otherwise("I-"), F.lit(kind)))),
            F.transform(words, lambda _: score),
        ]

    def other(text: str | Column) -> list[Column]:
        words = words_of(F.lit(text) if isinstance(text, str) else text)
        return [words, F.transform(words, lambda _: F.lit("O")), F.transform(words, lambda _: F.lit(1.0))]

    parts = [
        piece(F.col("vendor"), "VENDOR", 5, F.col("k") % 4 + 4),
        other("dated"),
        piece(F.col("date_text"), "DATE", 7, 6),
        other("total"),
        piece(F.lit("99.99"), "TOTAL", 6, 0),
        other("no,"),
        piece(F.col("total_text"), "TOTAL", 6, F.col("k") % 3 + 1),
        other(F.concat(F.lit("paid in "), F.col("currency"))),
    ]
    columns = [F.concat(*column) for column in zip(*parts, strict=True)]
    labelled = rows.select("k", *[c.alias(n) for c, n in zip(columns, ["words", "labels", "scores"], strict=True)])
    return labelled.withColumn("text", F.array_join("words", " "))
