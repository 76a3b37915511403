"""Scoring predicted against expected values, and splitting case tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave import schemas as S


def stateless_expectation(scenario: Column) -> Column:
    """Without history a duplicate charge cannot be told from a match."""
    return F.when(scenario == "duplicate_charge", F.lit("matched")).otherwise(scenario)


def accuracy(cases: DataFrame) -> DataFrame:
    """Total, correct and accuracy of ``expected`` against ``predicted``."""
    correct = F.col("expected") == F.col("predicted")
    return cases.agg(
        F.count("*").alias("total_cases"),
        F.count_if(correct).alias("correct_cases"),
        F.coalesce(F.round(F.avg(correct.cast("double")), 4), F.lit(0.0)).alias("accuracy"),
    )


def class_report(cases: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per label, with both averages.

    Cases are counted per pair of labels first; all that follows works on
    those few counts.  ``labels`` restricts and completes the label set.
    """
    sides = F.array(
        F.struct(
            F.col("expected").alias("label"),
            F.lit(0).alias("predicted"),
            F.lit(1).alias("support"),
            F.lit(0).alias("hit"),
        ),
        F.struct(
            F.col("predicted").alias("label"),
            F.lit(1).alias("predicted"),
            F.lit(0).alias("support"),
            (F.col("expected") == F.col("predicted")).cast("int").alias("hit"),
        ),
    )
    pairs = cases.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    sides_of_pairs = pairs.select("n", F.explode(sides).alias("s"))
    if labels is not None:
        zero = cases.sparkSession.range(1).select(
            F.lit(0).cast("long").alias("n"),
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(v).alias("label"),
                            F.lit(0).alias("predicted"),
                            F.lit(0).alias("support"),
                            F.lit(0).alias("hit"),
                        )
                        for v in labels
                    ]
                )
            ).alias("s"),
        )
        sides_of_pairs = sides_of_pairs.filter(F.col("s.label").isin(*labels)).unionByName(zero)
    counts = sides_of_pairs.groupBy(F.col("s.label").alias("label")).agg(
        F.sum(F.col("n") * F.col("s.hit")).alias("tp"),
        F.sum(F.col("n") * F.col("s.predicted")).alias("np"),
        F.sum(F.col("n") * F.col("s.support")).alias("support"),
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)

    scores = counts.select(
        "label",
        "support",
        ratio(F.col("tp"), F.col("np")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("np") + F.col("support")).alias("f1"),
    )
    measures = ["precision", "recall", "f1"]
    rolled = scores.rollup("label").agg(
        F.sum("support").alias("support"),
        *[F.avg(m).alias(m) for m in measures],
        *[
            ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}")
            for m in measures
        ],
    )

    def row(name: Column, prefix: str) -> Column:
        return F.struct(
            name.alias("label"), *[F.round(prefix + m, 4).alias(m) for m in measures]
        )

    rows = F.when(
        F.col("label").isNull(),
        F.array(row(F.lit("macro avg"), ""), row(F.lit("weighted avg"), "weighted_")),
    ).otherwise(F.array(row(F.col("label"), "")))
    return rolled.select("support", F.explode(rows).alias("r")).select(
        "r.label", *[f"r.{m}" for m in measures], "support"
    )


def confusion_matrix(cases: DataFrame, labels: list[str]) -> DataFrame:
    """One row per expected label, one ``as_<label>`` column per predicted one."""
    pairs = cases.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    counted = pairs.groupBy("expected").agg(
        *[
            F.sum(F.when(F.col("predicted") == label, F.col("n"))).alias(f"as_{label}")
            for label in labels
        ]
    )
    rows = cases.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(label) for label in labels])).alias("expected")
    )
    return rows.join(counted, "expected", "left").select(
        "expected",
        *[F.coalesce(f"as_{label}", F.lit(0)).alias(f"as_{label}") for label in labels],
    )


def label_universe(cases: DataFrame) -> DataFrame:
    """Every label that occurs as expected or predicted."""
    return (
        cases.groupBy("expected", "predicted")
        .count()
        .select(F.explode(F.array("expected", "predicted")).alias("label"))
        .distinct()
    )


def field_accuracy(checked: DataFrame, flags: list[str]) -> DataFrame:
    """Share of rows in which each flag holds, and in which all hold."""
    everything = F.lit(True)
    for flag in flags:
        everything = everything & F.col(flag)
    return checked.agg(
        F.count("*").alias("total_cases"),
        *[F.round(F.avg(F.col(f).cast("double")), 4).alias(f"accuracy_{f}") for f in flags],
        F.round(F.avg(everything.cast("double")), 4).alias("all_fields_exact_accuracy"),
    )


def wrong_fields(flags: list[str], prefix: str = "ok_") -> Column:
    """Names of the fields whose flag does not hold."""
    return F.array_compact(
        F.array(*[F.when(~F.col(f), F.lit(f.removeprefix(prefix))) for f in flags])
    )


def failed_cases(checked: DataFrame, flags: list[str]) -> DataFrame:
    """The rows with at least one wrong field."""
    return checked.withColumn("incorrect_fields", wrong_fields(flags)).filter(
        F.size("incorrect_fields") > 0
    )


def error_summary(checked: DataFrame, flags: list[str]) -> DataFrame:
    """Failures per field, and per scenario and field, with their rates.

    One pass: flags are counted per scenario, and the few counts are rolled up
    (scenario NULL stands for all scenarios).
    """
    per_scenario = checked.groupBy("scenario").agg(
        F.count("*").alias("cases"), *[F.count_if(~F.col(f)).alias(f) for f in flags]
    )
    rolled = per_scenario.rollup("scenario").agg(
        F.sum("cases").alias("cases"), *[F.sum(f).alias(f) for f in flags]
    )
    long = rolled.unpivot(["scenario", "cases"], flags, "field", "failures")
    return long.filter("failures > 0").select(
        F.coalesce("scenario", F.lit("ALL")).alias("scenario"),
        F.regexp_replace("field", "^ok_", "").alias("field"),
        "failures",
        F.round(F.col("failures") / F.col("cases"), 4).alias("failure_rate"),
    )


def worst_cases(cases: DataFrame, limit: int = 10) -> DataFrame:
    """The first ``limit`` wrong cases, least certain first."""
    return (
        cases.filter(F.col("expected") != F.col("predicted"))
        .orderBy("confidence", "submission_id")
        .limit(limit)
    )


def stratified_split(
    cases: DataFrame,
    stratum: str = "scenario",
    case_id: str = "submission_id",
    fraction: float = S.HELDOUT_FRACTION,
    seed: int = S.SPLIT_SEED,
) -> DataFrame:
    """Add ``split``: per stratum, a fixed share of the cases is held out.

    Cases are ordered by a seeded hash and the first
    ``max(1, round(n * fraction))`` of each stratum are held out.  A stratum
    may be most of the table, so it is never sorted as a whole: cases are
    counted per hash prefix, the counts say which prefixes lie before the cut,
    and only within a prefix are cases ranked.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    hashed = cases.withColumn(
        "_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(case_id).cast("string")))
    ).withColumn("_prefix", F.substring("_hash", 1, 4))
    whole = Window.partitionBy(stratum)
    running = whole.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        hashed.groupBy(stratum, "_prefix")
        .agg(F.count("*").alias("_n"))
        .select(
            stratum,
            "_prefix",
            F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"),
            F.greatest(
                F.lit(1), F.bround(F.sum("_n").over(whole) * fraction).cast("long")
            ).alias("_quota"),
        )
    )
    within = Window.partitionBy(stratum, "_prefix").orderBy("_hash", case_id)
    return (
        hashed.join(counts, [stratum, "_prefix"])
        .withColumn("_place", F.col("_before") + F.row_number().over(within))
        .withColumn(
            "split",
            F.when(F.col("_place") <= F.col("_quota"), F.lit("heldout")).otherwise(
                F.lit("development")
            ),
        )
        .drop("_hash", "_prefix", "_before", "_quota", "_place")
    )


def distribution(cases: DataFrame, *by: str) -> DataFrame:
    return cases.groupBy(*by).agg(F.count("*").alias("cases"))
