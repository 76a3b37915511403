"""Quality rules: a ledger of failure bits and measurements, judged by versioned policies.

Every rule is evaluated once per document.  The ledger keeps what was measured
and one bit per failed rule; a policy is a mask of the rules that reject, so
another policy, or the question what a rule contributes, reads the ledger and
never the texts.

Defined results: a NULL or empty text has no words and fails ``few_words``;
repeated rows and ids stay as they are; columns of the input that are not asked
for are ignored, whatever their names; an empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.arrays import let
from tallyweave.llm.common import SPACES, split_words

SYMBOLS = "#*$%&|<>"
WINDOW = 3

#: Measurements, each a long.
MEASURES = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_letters",
    "n_bangs",
]

#: Rules in the order of their bits.  Written so that Spark and other SQL
#: engines read them alike; whole numbers only, so no rounding decides.
RULES = {
    "few_words": "n_words < 50",
    "repeat_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 25 * n_words",
    "dup_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "upper_case": "100 * n_upper > 40 * n_letters",
    "bangs": "100 * n_bangs > 25 * n_words",
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BITS[n] for n in names)


BASE = mask("few_words", "repeat_words")
#: A policy never changes once published; a new one gets a new version.
POLICIES = {
    "v1": BASE,
    "v2": mask(*RULES),
}
CURRENT = "v2"


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in ``words``, the first included.

    Windows are compared by their 64-bit hash.  Sorting hashes with their
    places brings equal ones together, so the work is n log n for any text.
    """

    def spans(w: Column) -> Column:
        last = F.size(w) - window
        hashes = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]),
        )
        return F.when(last >= 0, let(hashes, covered)).otherwise(0)

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(ordered, total))

    def total(s: Column) -> Column:
        same = lambda x, k: F.get(s, k)["h"] == x["h"]
        twice = F.filter(s, lambda x, k: F.coalesce(same(x, k - 1) | same(x, k + 1), same(x, k - 1), same(x, k + 1)))
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            F.sort_array(F.transform(twice, lambda x: x["i"])),
            start,
            lambda a, i: F.struct(
                i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n")
            ),
            lambda a: a["n"],
        )

    return let(words, spans)


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)


def ledger(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, the measurements and ``failed``, the bits of the rules a document fails."""
    clash = {*keep} & {*MEASURES, "failed"}
    if clash:
        raise ValueError(f"ledger columns cannot be kept: {sorted(clash)}")
    whole = F.coalesce(F.col(text), F.lit(""))
    kept = [F.col(f"`{c}`") for c in keep]
    split = docs.select(
        *kept,
        whole.alias("_text"),
        split_words(whole).alias("_words"),
        _lines(whole).alias("_lines"),
    )
    measures = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.translate("_text", SPACES, "")),
        "n_symbols": _without(F.col("_text"), SYMBOLS),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": repeated_words(F.col("_words")),
        "n_lines": F.size("_lines"),
        "n_upper": F.regexp_count("_text", F.lit(r"\p{Lu}")),
        "n_letters": F.regexp_count("_text", F.lit(r"\p{L}")),
        "n_bangs": _without(F.col("_text"), "!"),
    }
    measured = split.select(*kept, *[measures[m].cast("long").alias(m) for m in MEASURES])
    bits = [F.when(F.expr(rule), BITS[name]).otherwise(0) for name, rule in RULES.items()]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed)


def passes(failed: Column, version: str = CURRENT) -> Column:
    return failed.bitwiseAND(F.lit(POLICIES[version])) == 0


def judge(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """A ledger with ``kept`` by the policy of that version."""
    return entries.withColumn("kept", passes(F.col("failed"), version))


def ablations(entries: DataFrame, versions: list[str] | None = None) -> DataFrame:
    """Per policy and rule: documents failing it, and those only it rejects.

    A document is rejected by one rule alone if its failure bits under the
    policy are just that rule's.  Entries are first counted by failure bits, of
    which there are at most two to the number of rules, so one aggregation over
    the ledger answers for every policy and rule.
    """
    rules = F.explode(
        F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in BITS.items()])
    )
    policies = F.explode(
        F.array(
            *[
                F.struct(F.lit(v).alias("version"), F.lit(POLICIES[v]).alias("mask"))
                for v in versions or POLICIES
            ]
        )
    )
    under = F.col("failed").bitwiseAND(F.col("p.mask"))
    return (
        entries.groupBy("failed")
        .agg(F.count("*").alias("n"))
        .select("failed", "n", policies.alias("p"))
        .select("failed", "n", "p", rules.alias("r"))
        .groupBy(F.col("p.version").alias("version"), F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when(under == F.col("r.bit"), F.col("n")).otherwise(0)).alias("alone"),
            F.sum(F.when(under != 0, F.col("n")).otherwise(0)).alias("rejected"),
            F.bit_or(F.when(under != 0, under).otherwise(0)).alias("bits_seen"),
        )
    )


def well_formed(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """Documents that the policy keeps, with the columns they came with."""
    key = "_row"
    while key in docs.columns:
        key += "_"
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(key), "text")
    entries = ledger(packed, [key])
    return entries.where(passes(F.col("failed"), version)).select(f"{key}.*")
