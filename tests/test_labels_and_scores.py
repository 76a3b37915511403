import math
import random

import pytest
from pyspark.sql import functions as F

from tallyweave import schemas as S
from tallyweave.operators import cases, evaluation, labeling
from tests.helpers import ledger, record


def docs(spark, *rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "doc_id int, words array<string>, labels array<string>, scores array<double>",
    )


def reference_spans(labels):
    """Spans by walking the labels one by one."""
    spans, start, kind = [], None, None
    for i, label in enumerate([*labels, "O"]):
        prefix, _, name = label.partition("-")
        if label != "O" and not name:
            prefix, name = "B", label
        begins = label != "O" and (prefix != "I" or name != kind)
        if start is not None and (label == "O" or begins):
            spans.append((kind, start, i - 1))
            start = kind = None
        if begins:
            start, kind = i, name
    return spans


def test_spans_like_a_walk(spark):
    rng = random.Random(3)
    all_labels = [
        [rng.choice([*S.TOKEN_LABELS, "TOTAL", "X-DATE"]) for _ in range(rng.randrange(0, 12))]
        for _ in range(200)
    ]
    rows = [([f"w{i}" for i in range(len(v))], v, [0.5] * len(v)) for v in all_labels]
    got = labeling.with_spans(docs(spark, *rows)).orderBy("doc_id").collect()
    for labels, row in zip(all_labels, got):
        found = [(s.entity_type, s.start_word, s.end_word) for s in row.spans]
        assert found == reference_spans(labels), labels
        for s in row.spans:
            assert s.text == " ".join(f"w{i}" for i in range(s.start_word, s.end_word + 1))


def test_span_scores(spark):
    df = docs(spark, (["ACME", "LTD", "9.00"], ["B-VENDOR", "I-VENDOR", "I-TOTAL"], [0.9, 0.7, 0.95]))
    spans = labeling.with_spans(df).first().spans
    assert [(s.text, s.score) for s in spans] == [("ACME LTD", 0.8), ("9.00", 0.95)]


def labelled(spark, words, company="", date="", total=""):
    df = spark.createDataFrame(
        [(words, company, date, total)], "words array<string>, company string, date string, total string"
    )
    return labeling.assign_labels(df).first().labels


def test_label_assignment(spark):
    words = ["BND HOLDINGS SDN", "05 MAR 2018 18:24", "RM 9.00", "note", "9.00", "2018-03-05"]
    assert labelled(spark, words, "BHD HOLDINGS SDN", "05/03/2018", "9.00") == [
        "B-VENDOR",
        "B-DATE",
        "B-TOTAL",
        "O",
        "I-TOTAL",
        "I-DATE",
    ]
    # The vendor wins over the total; nothing matches absent entities.
    assert labelled(spark, ["24"], "Shop 24", "", "24.00") == ["B-VENDOR"]
    assert labelled(spark, ["9.00", "", "x"]) == ["O", "O", "O"]


def test_vendor_flags_like_brute_force(spark):
    from tests.test_functions import slow_similarity

    rng = random.Random(5)
    rows = []
    for i in range(150):
        name = "".join(rng.choice("abcde ") for _ in range(rng.randrange(3, 14))).strip() or "ab"
        words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(6)]
        words.append(name[1:] + "x")
        rows.append((i, words, name))
    df = spark.createDataFrame(rows, "doc_id int, words array<string>, company string")
    got = labeling.with_vendor_flags(df).orderBy("doc_id").collect()
    for (_, words, name), row in zip(rows, got):
        norm = " ".join(name.split())
        want = [
            w in norm or (len(w) >= 4 and slow_similarity(w, norm) >= 86)
            for w in [" ".join(v.split()) for v in words]
        ]
        assert row.is_vendor == want, (words, name)


def test_first_subtokens_and_training_labels(spark):
    sub = spark.createDataFrame(
        [(1, 0, 0, "B-DATE", 0.9), (1, 0, 1, "O", 0.1), (1, 2, 2, "O", 0.8)],
        "doc_id int, word int, tok int, label string, score double",
    )
    words = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "doc_id int, word int")
    rows = labeling.first_subtokens(sub, words).orderBy("word").collect()
    assert [(r.label, r.score) for r in rows] == [("B-DATE", 0.9), ("O", 0.0), ("O", 0.8)]
    df = spark.createDataFrame([([None, 0, 0, 1, None], [3, 5])], "w array<int>, l array<int>")
    got = df.select(labeling.training_labels(F.col("w"), F.col("l")).alias("r")).first().r
    assert got == [-100, 3, -100, 5, -100]


def test_class_weights(spark):
    df = spark.createDataFrame([([0] * 60 + [1, 1, 3, -100],)], "ids array<int>")
    rows = labeling.class_weights(df, "ids").orderBy("label_id").collect()
    assert [r.weight for r in rows] == [1.0, 25.0, 25.0, 25.0, 25.0, 25.0, 25.0]
    df = spark.createDataFrame([([0] * 60 + [1] * 8 + [3] * 7,)], "ids array<int>")
    rows = labeling.class_weights(df, "ids").orderBy("label_id").collect()
    assert [r.weight for r in rows][:4] == [1.0, 7.5, 25.0, 8.5714]
    empty = spark.createDataFrame([([-100],)], "ids array<int>")
    with pytest.raises(Exception, match="no labels"):
        labeling.class_weights(empty, "ids").collect()


def test_span_metrics(spark):
    df = docs(
        spark,
        (["a", "b", "c"], ["B-VENDOR", "I-VENDOR", "B-TOTAL"], [1.0] * 3),
        (["a", "b"], ["O", "O"], [1.0] * 2),
    ).withColumn(
        "predicted",
        F.when(F.col("doc_id") == 0, F.array(*map(F.lit, ["B-VENDOR", "I-VENDOR", "O"]))).otherwise(
            F.array(F.lit("B-DATE"), F.lit("O"))
        ),
    )
    both = labeling.with_spans(
        labeling.with_spans(df, out="true_spans"), labels="predicted", out="predicted_spans"
    )
    rows = {r.entity_type: r for r in labeling.span_metrics(both).collect()}
    assert (rows["ALL"].precision, rows["ALL"].recall, rows["ALL"].f1) == (0.5, 0.5, 0.5)
    assert (rows["VENDOR"].f1, rows["TOTAL"].recall, rows["DATE"].precision) == (1.0, 0.0, 0.0)


def test_class_report_and_matrix(spark):
    pairs = [("a", "a")] * 3 + [("a", "b"), ("b", "b"), ("c", "a")]
    df = spark.createDataFrame(pairs, "expected string, predicted string")
    rows = {r.label: r for r in evaluation.class_report(df).collect()}
    assert (rows["a"].precision, rows["a"].recall, rows["a"].support) == (0.75, 0.75, 4)
    assert (rows["c"].precision, rows["c"].f1) == (0.0, 0.0)
    assert rows["macro avg"].recall == round((0.75 + 1 + 0) / 3, 4)
    assert rows["weighted avg"].recall == round((0.75 * 4 + 1) / 6, 4)
    matrix = evaluation.confusion_matrix(df, ["a", "b", "z"]).orderBy("expected").collect()
    assert [tuple(r) for r in matrix] == [("a", 3, 1, 0), ("b", 0, 1, 0), ("z", 0, 0, 0)]
    acc = evaluation.accuracy(df).first()
    assert (acc.total_cases, acc.correct_cases, acc.accuracy) == (6, 4, 0.6667)


def test_stratified_split(spark):
    df = spark.range(5 * 50 + 1).select(
        F.col("id").alias("submission_id"),
        F.when(F.col("id") == 250, F.lit("rare"))
        .otherwise(F.concat(F.lit("s"), F.col("id") % 5))
        .alias("scenario"),
    )
    split = evaluation.stratified_split(df)
    assert split.count() == 251
    counts = {
        r.scenario: r["count"]
        for r in split.filter("split = 'heldout'").groupBy("scenario").count().collect()
    }
    assert counts == {**{f"s{i}": 15 for i in range(5)}, "rare": 1}
    again = evaluation.stratified_split(df.repartition(3))
    assert split.exceptAll(again).count() == 0
    with pytest.raises(ValueError):
        evaluation.stratified_split(df, fraction=1.0)


def test_items_and_synthetic_rows(spark):
    df = ledger(spark, record(amount=100.0, quantity=4, fx_rate=1.25)).withColumn(
        "line_items",
        F.explode(
            F.array(
                F.lit('[{"desc":"A","qty":2,"price":3.0},{"description":"B","quantity":1,"unit_price":4}]'),
                F.lit("broken"),
                F.lit("[]"),
                F.lit(None).cast("string"),
            )
        ),
    )
    rows = cases.unify_items(df).select(
        "items", cases.items_total(F.col("items"), F.col("fx_rate")).alias("t")
    ).collect()
    assert [(i.description, i.qty, i.price) for i in rows[0]["items"]] == [("A", 2, 3.0), ("B", 1, 4.0)]
    assert rows[0].t == 12.5
    assert [r["items"][0].price for r in rows[1:]] == [20.0] * 3 and rows[1].t == 100.0
    made = cases.synthetic_ledger(spark, 200, ["A", "B", "C"])
    again = cases.synthetic_ledger(spark, 200, ["A", "B", "C"])
    assert made.exceptAll(again).count() == 0 and made.select("vendor").distinct().count() == 3
    assert made.filter("currency = 'EUR' AND fx_rate <> 1").count() == 0


def test_error_summary(spark):
    df = spark.createDataFrame(
        [("a", True, False), ("a", True, True), ("b", False, False)],
        "scenario string, ok_amount boolean, ok_vendor boolean",
    )
    rows = evaluation.error_summary(df, ["ok_amount", "ok_vendor"]).collect()
    got = {(r.scenario, r.field): (r.failures, r.failure_rate) for r in rows}
    assert got == {
        ("ALL", "amount"): (1, 0.3333),
        ("ALL", "vendor"): (2, 0.6667),
        ("a", "vendor"): (1, 0.5),
        ("b", "amount"): (1, 1.0),
        ("b", "vendor"): (1, 1.0),
    }
    failed = evaluation.failed_cases(df, ["ok_amount", "ok_vendor"]).collect()
    assert sorted(len(r.incorrect_fields) for r in failed) == [1, 2]
    assert math.isclose(evaluation.field_accuracy(df, ["ok_amount"]).first()[1], 0.6667)
