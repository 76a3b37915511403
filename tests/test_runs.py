"""Neighbouring rows are folded before they are shuffled, and results do not depend on their order."""

import random
import re

from pyspark.sql import functions as F

from tallyweave.operators import extraction, labeling
from tallyweave.operators.runs import runs

TOKENS = "doc_id int, pos int, text string, conf double, block_num int, par_num int, line_num int"


def below_exchanges(df):
    """The physical plan under the shuffles."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines, depth, out = plan.splitlines(), None, []
    for line in lines:
        at = len(re.match(r"[\s:+\-|*()0-9]*", line)[0])
        if depth is not None and at <= depth:
            depth = None
        if depth is not None:
            out.append(line.strip())
        elif "Exchange" in line:
            depth = at
    return "\n".join(out)


def tokens_of(spark):
    rows = [
        (doc, pos, f"w{pos % 7}" if pos % 11 else " ", float(pos * 13 % 101), pos // 40, pos // 20 % 2, pos // 10 % 2)
        for doc in (1, 2, 2, None)
        for pos in range(95)
    ]
    rows.append((3, 0, "faint", 5.0, 0, 0, 0))
    rows.append((4, 0, None, None, 0, 0, 0))
    shuffled = random.Random(5).sample(rows, len(rows))
    return rows, [spark.createDataFrame(r, TOKENS) for r in (rows, shuffled)]


def test_runs(spark):
    df = spark.createDataFrame(
        [(1, "a", True), (1, "b", False), (None, "c", None), (None, "d", True), (1, None, True)],
        "k int, v string, use boolean",
    ).coalesce(1)
    assert [tuple(r) for r in runs(df, ["k"], ["v"]).collect()] == [
        (1, ["a", "b"]),
        (None, ["c", "d"]),
        (1, [None]),
    ]
    assert [tuple(r) for r in runs(df, ["k"], ["v"], kept="use").collect()] == [(1, ["a"]), (None, ["d"]), (1, [None])]
    assert runs(df.where("k = 9"), ["k"], ["v"]).collect() == []


def test_lines_and_texts_in_any_order(spark):
    rows, frames = tokens_of(spark)
    lines, docs = {}, {}
    for doc, pos, text, conf, *place in rows:
        said = docs.setdefault(doc, [])
        if text and text.strip():
            lines.setdefault((doc, *place), []).append((pos, text))
            if conf >= 30:
                said.append((pos, text, conf))
    want = {k: " ".join(t for _, t in sorted(v)) for k, v in lines.items()}
    for df in frames:
        got = extraction.assemble_lines(df)
        assert {tuple(r)[:4]: r.line_text for r in got.collect()} == want
        texts = {r.doc_id: r for r in extraction.documents_from_tokens(df).collect()}
        assert texts.keys() == docs.keys()
        for doc, said in docs.items():
            assert texts[doc].text == " ".join(t for _, t, _ in sorted(said)) and texts[doc].n_words == len(said)
            mean = sum(c for *_, c in said) / len(said) if said else 0.0
            assert abs(texts[doc].mean_confidence - mean) < 0.006


def test_first_subtokens_in_any_order(spark):
    words = [(d, w) for d in (1, 2, 2, None) for w in (*range(30), 5000, 4096 + 3, None)]
    sub = [
        (d, w, t, f"L{w}" if t == 1 else "I-DATE", w / 8 + t)
        for d in (1, 2, None, 5)
        for w in (*range(30), 4096 + 3)
        if w % 9
        for t in (3, 1, 2)
    ] + [(1, 0, None, "B-DATE", 1.0)]
    known = {(d, w): (label, score) for d, w, t, label, score in sub if t == 1 and d is not None}
    want = sorted((str(d), str(w), *known.get((d, w), ("O", 0.0))) for d, w in words)
    for seed in (None, 3):
        if seed:
            words, sub = random.Random(seed).sample(words, len(words)), random.Random(seed).sample(sub, len(sub))
        got = labeling.first_subtokens(
            spark.createDataFrame(sub, "doc_id int, word int, tok int, label string, score double"),
            spark.createDataFrame(words, "doc_id int, word int"),
        )
        assert sorted((str(r.doc_id), str(r.word), r.label, r.score) for r in got.collect()) == want


def test_rows_are_folded_before_the_shuffle(spark):
    _, (df, _) = tokens_of(spark)
    words = df.select("doc_id", F.col("pos").alias("word")).distinct().checkpoint()
    sub = words.select("*", F.lit(0).alias("tok"), F.lit("O").alias("label"), F.lit(0.5).alias("score"))
    for out in (
        extraction.assemble_lines(df),
        extraction.documents_from_tokens(df),
        labeling.first_subtokens(sub, words),
    ):
        under = below_exchanges(out)
        assert "MapInArrow" in under and "Aggregate" not in under and "Sort" not in under, under
