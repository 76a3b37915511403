"""Table schemas and the numeric limits every rule shares."""

from __future__ import annotations

from pyspark.sql import types as T

LINE_ITEM = T.StructType(
    [
        T.StructField("description", T.StringType()),
        T.StructField("qty", T.IntegerType()),
        T.StructField("price", T.DoubleType()),
    ]
)

#: The fields an invoice and a ledger row have in common, in output order.
RECORD_FIELDS = [
    "invoice_id",
    "invoice_date",
    "vendor",
    "amount",
    "currency",
    "quantity",
    "fx_rate",
]

RECORD = T.StructType(
    [
        T.StructField("invoice_id", T.StringType(), False),
        T.StructField("invoice_date", T.DateType(), False),
        T.StructField("vendor", T.StringType(), False),
        T.StructField("amount", T.DoubleType(), False),
        T.StructField("currency", T.StringType(), False),
        T.StructField("quantity", T.IntegerType(), False),
        T.StructField("fx_rate", T.DoubleType(), False),
    ]
)

LEDGER = T.StructType([*RECORD.fields, T.StructField("line_items", T.StringType())])

EVALUATION_LEDGER = T.StructType(
    [
        T.StructField("case_id", T.StringType(), False),
        T.StructField("scenario", T.StringType(), False),
        *LEDGER.fields,
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("scenario", T.StringType()),
        T.StructField("image_path", T.StringType()),
        T.StructField(
            "document_invoice",
            T.StructType([*RECORD.fields, T.StructField("line_items", T.ArrayType(LINE_ITEM))]),
        ),
        T.StructField(
            "ledger_record",
            T.StructType([*RECORD.fields, T.StructField("line_items", T.ArrayType(LINE_ITEM))]),
        ),
    ]
)

AUDIT_EVENT = T.StructType(
    [
        T.StructField("audit_event_id", T.StringType(), False),
        T.StructField("event_timestamp", T.TimestampType(), False),
        T.StructField("run_id", T.StringType(), False),
        T.StructField("invoice_id", T.StringType()),
        T.StructField("invoice_date", T.DateType()),
        T.StructField("vendor", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("fx_rate", T.DoubleType()),
        T.StructField("reconciliation_status", T.StringType(), False),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("best_match_invoice_id", T.StringType()),
        T.StructField("discrepancy_details_json", T.StringType()),
        T.StructField("investigation_json", T.StringType()),
        T.StructField("dispute_letter_draft", T.StringType()),
    ]
)

APPROVAL_EVENT = T.StructType(
    [
        T.StructField("approval_event_id", T.StringType(), False),
        T.StructField("approved_at", T.TimestampType(), False),
        T.StructField("reviewer_id", T.StringType(), False),
        T.StructField("action", T.StringType(), False),
        T.StructField("reconciliation_audit_event_id", T.StringType(), False),
        T.StructField("invoice_id", T.StringType()),
        T.StructField("reconciliation_status", T.StringType()),
        T.StructField("final_draft", T.StringType(), False),
        T.StructField("environment", T.StringType(), False),
    ]
)

#: Keys of the discrepancy details, as one wide nullable struct.  Alphabetical,
#: so that ``to_json`` writes sorted keys and simply leaves out the NULL ones.
DETAIL_FIELDS = {
    "amount_delta": "double",
    "best_score": "double",
    "best_semantic_score": "double",
    "candidate_invoice_id": "string",
    "candidate_vendor": "string",
    "input_invoice_id": "string",
    "input_vendor": "string",
    "invoice_amount": "double",
    "invoice_currency": "string",
    "invoice_fx_rate": "double",
    "invoice_quantity": "int",
    "ledger_amount": "double",
    "ledger_currency": "string",
    "ledger_fx_rate": "double",
    "ledger_quantity": "int",
    "prior_audit_event_id": "string",
    "prior_event_timestamp": "string",
    "prior_run_id": "string",
    "quantity_delta": "int",
    "reason": "string",
    "relative_fx_rate_difference": "double",
    "score_gap": "double",
    "second_score": "double",
}

# Limits that decide a status or a score.
AMOUNT_TOLERANCE = 0.02
FX_TOLERANCE = 0.005
MATCH_THRESHOLD = 0.75
AMBIGUITY_MARGIN = 0.03
EVAL_FX_TOLERANCE = 0.0001
POOL_REPORT = 60
RUNTIME_TOP_K = 3
EVALUATION_TOP_K = 5
HISTORY_LIMIT = 200
HISTORY_LIMIT_MAX = 500
MIN_WORD_CONFIDENCE = 30.0
VENDOR_SIMILARITY = 86.0
TOTAL_LINE_SCORE = 65.0
MAX_CLASS_WEIGHT = 25.0
HELDOUT_FRACTION = 0.30
SPLIT_SEED = 42
OPEN_REVIEW_ACTION = "draft_approved_no_email_sent"

# What an absent field is written as.
NO_INVOICE_ID = "UNKNOWN-INVOICE-ID"
NO_VENDOR = "UNKNOWN-VENDOR"
NO_DATE = "1970-01-01"
NO_AMOUNT = 0.0
DEFAULT_CURRENCY = "EUR"
DEFAULT_QUANTITY = 1
DEFAULT_FX_RATE = 1.0

# The statuses, the token labels and the currencies.
STATUSES = [
    "matched",
    "duplicate_charge",
    "fx_mismatch",
    "quantity_mismatch",
    "amount_mismatch",
    "currency_mismatch",
    "unmatched",
    "ambiguous",
]
HELDOUT_LABELS = [
    "matched",
    "amount_mismatch",
    "fx_mismatch",
    "quantity_mismatch",
    "duplicate_charge",
]
TOKEN_LABELS = ["O", "B-VENDOR", "I-VENDOR", "B-DATE", "I-DATE", "B-TOTAL", "I-TOTAL"]
ENTITY_TYPES = ["VENDOR", "DATE", "TOTAL"]
IGNORED_LABEL_ID = -100
CURRENCIES = ["EUR", "USD", "GBP", "PLN", "MYR"]
