"""Token labels: assigning them to words, reading spans back, counting them.

A document's words, labels and scores are arrays of one row, so labelling and
decoding need no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave import schemas as S
from tallyweave.functions.arrays import indices, let
from tallyweave.functions.dates import parse_date
from tallyweave.functions.fuzzy import partial_similarity
from tallyweave.functions.money import norm_numeric
from tallyweave.functions.text import norm_alnum
from tallyweave.operators.runs import runs, starts


def check_samples(samples: DataFrame) -> DataFrame:
    """Add ``accepted``: as many boxes as words, and a page of positive size."""
    same = F.size("words") == F.size("bboxes")
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    return samples.withColumn("accepted", F.coalesce(same & sized, F.lit(False)))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _resembles(words: pd.Series, name: pd.Series, least: pd.Series) -> pd.Series:
    """For each open word: is it similar enough to the name?"""

    def one(values, entity, bound):
        if values is None:
            return None
        return [v is not None and partial_similarity(v, entity, bound) >= bound for v in values]

    return pd.Series([one(w, n, b) for w, n, b in zip(words, name, least)], dtype=object)


def _may_resemble(word: Column, name: Column, least: float) -> Column:
    """False if the characters rule out a similarity of ``least``, both ways exactly.

    A window of the longer string shares at least ``m * t / (2 - t)`` of the
    shorter one's ``m`` characters when the similarity is ``t``, so the
    characters of the shorter one that the longer lacks must be few.  From a
    similarity of 80 on, two of the shared ones stand side by side in both, so
    some pair of neighbours must occur in the longer string.
    """
    word_is_shorter = F.length(word) <= F.length(name)
    # Of one length, either may play the shorter one.
    of_word = F.length(F.call_function("translate", word, name, F.lit("")))
    of_name = F.length(F.call_function("translate", name, word, F.lit("")))
    same_length = F.length(word) == F.length(name)
    lacking = (
        F.when(same_length, F.least(of_word, of_name)).when(word_is_shorter, of_word).otherwise(of_name)
    )
    shorter = F.least(F.length(word), F.length(name))
    t = least / 100.0
    few_lacking = lacking <= shorter * (1.0 - t / (2.0 - t)) + 1e-9
    if least < 80:
        return few_lacking

    def has_pair(first: Column, second: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(first) - 1, F.lit(1)))
        return F.exists(
            starts, lambda i: F.contains(second, F.substring(first, i, F.lit(2)))
        )

    pair = F.when(word_is_shorter, has_pair(word, name)).otherwise(has_pair(name, word))
    return pair & few_lacking


def with_vendor_flags(
    docs: DataFrame,
    words: str = "words",
    vendor: str = "company",
    out: str = "is_vendor",
    least: float = S.VENDOR_SIMILARITY,
) -> DataFrame:
    """Add one boolean per word: contained in the vendor's name, or similar to it."""
    name = norm_alnum(F.coalesce(F.col(vendor), F.lit("")))

    def tested(named: Column) -> Column:
        def one(word: Column) -> Column:
            inside = (word != "") & (named != "") & F.contains(named, word)
            is_open = (
                ~inside
                & (named != "")
                & (F.length(word) >= 4)
                & _may_resemble(word, named, least)
            )
            return F.struct(inside.alias("inside"), F.when(is_open, word).alias("open"))

        return F.transform(F.transform(words, norm_alnum), one)

    staged = docs.withColumns({"_name": name, "_tested": let(name, tested)})
    open_words = F.col("_tested.open")
    staged = staged.withColumn(
        "_similar",
        _resembles(
            F.when(F.exists(open_words, lambda w: w.isNotNull()), open_words),
            F.col("_name"),
            F.lit(least),
        ),
    )
    similar = F.coalesce(
        F.col("_similar"), F.array_repeat(F.lit(False), F.size("_tested").cast("int"))
    )
    flags = F.zip_with(F.col("_tested.inside"), similar, lambda inside, near: inside | near)
    return staged.withColumn(out, flags).drop("_name", "_tested", "_similar")


def assign_labels(docs: DataFrame) -> DataFrame:
    """Add ``labels``: one BIO label per word from the document's entities.

    Reads ``words`` and the entity columns ``company``, ``date``, ``total``.
    The first word of a type in the document gets B, every later one I; where
    types overlap, the vendor wins over the date and the date over the total.
    """
    facts = F.struct(
        parse_date(F.coalesce(F.col("date"), F.lit("")), names_first=True).alias("date"),
        norm_numeric(F.coalesce(F.col("total"), F.lit(""))).alias("total"),
    )
    maybe_date = r"\d[-/. ]|[A-Za-z]{3,9} +\d"

    def marked(known: Column) -> Column:
        def one(word: Column) -> Column:
            is_date = word.rlike(maybe_date) & (parse_date(word, names_first=True) == known["date"])
            is_total = (known["total"] != "") & (norm_numeric(word) == known["total"])
            return F.struct(
                F.coalesce(is_date, F.lit(False)).alias("date"), is_total.alias("total")
            )

        return F.transform("words", one)

    def first(marks: Column) -> Column:
        return F.array_position(marks, True)

    def labelled(m: Column) -> Column:
        def choose(i: Column) -> Column:
            def when(kind: str) -> tuple[Column, Column]:
                begins = m[f"first_{kind}"] == i + 1
                name = kind.upper()
                return (
                    F.get(m[kind], i),
                    F.when(begins, F.lit(f"B-{name}")).otherwise(F.lit(f"I-{name}")),
                )

            return F.when(*when("vendor")).when(*when("date")).when(*when("total")).otherwise(
                F.lit("O")
            )

        return F.transform(indices(m["vendor"]), choose)

    flagged = with_vendor_flags(docs).withColumn("_marks", let(facts, marked))
    marks = F.struct(
        F.col("is_vendor").alias("vendor"),
        F.col("_marks.date").alias("date"),
        F.col("_marks.total").alias("total"),
        first(F.col("is_vendor")).alias("first_vendor"),
        first(F.col("_marks.date")).alias("first_date"),
        first(F.col("_marks.total")).alias("first_total"),
    )
    return flagged.withColumn("labels", let(marks, labelled)).drop("is_vendor", "_marks")


def label_id(label: Column) -> Column:
    names = F.array(*[F.lit(name) for name in S.TOKEN_LABELS])
    return (F.array_position(names, label) - 1).cast("int")


def label_name(number: Column) -> Column:
    names = F.array(*[F.lit(name) for name in S.TOKEN_LABELS])
    return F.get(names, number)


def _prefix(label: Column) -> Column:
    known = F.substring(label, 1, 2).isin("B-", "I-")
    return F.when(label == "O", F.lit("O")).when(known, F.substring(label, 1, 1)).otherwise(
        F.lit("B")
    )


def _kind(label: Column) -> Column:
    dash = F.instr(label, "-")
    return (
        F.when(label == "O", F.lit(""))
        .when(dash > 0, F.substring(label, dash + 1, F.length(label)))
        .otherwise(label)
    )


def with_spans(
    docs: DataFrame,
    words: str = "words",
    labels: str = "labels",
    scores: str = "scores",
    out: str = "spans",
) -> DataFrame:
    """Add ``spans``: runs of words of one entity type.

    O ends a span; B, a change of type, or I after O begins one.  A span ends
    where the next boundary stands, so boundaries are listed once and each is
    paired with its successor.
    """
    def boundaries(d: Column) -> Column:
        return F.filter(
            indices(d["prefix"]),
            lambda i: F.get(d["prefix"], i).isin("O", "B")
            | (i == 0)
            | (F.get(d["kind"], i) != F.get(d["kind"], i - 1)),
        )

    def decoded(d: Column) -> Column:
        return let(
            boundaries(d),
            lambda edges: F.transform(
                F.filter(
                    F.zip_with(
                        edges,
                        F.concat(F.slice(edges, 2, F.size(edges) + 1), F.array(F.size(d["kind"]))),
                        lambda a, b: F.struct(a.alias("start"), (b - 1).alias("end")),
                    ),
                    lambda p: F.coalesce(F.get(d["prefix"], p["start"]), F.lit("O")) != "O",
                ),
                lambda p: span(d, p),
            ),
        )

    def span(d: Column, p: Column) -> Column:
        length = p["end"] - p["start"] + 1
        within = F.slice(d["scores"], p["start"] + 1, length)
        mean = F.aggregate(within, F.lit(0.0), lambda total, s: total + s) / length
        return F.struct(
            F.get(d["kind"], p["start"]).alias("entity_type"),
            F.array_join(F.slice(d["words"], p["start"] + 1, length), " ").alias("text"),
            F.round(mean, 4).alias("score"),
            p["start"].alias("start_word"),
            p["end"].alias("end_word"),
        )

    columns = F.struct(
        F.col(words).alias("words"),
        F.col(scores).alias("scores"),
        F.transform(labels, _prefix).alias("prefix"),
        F.transform(labels, _kind).alias("kind"),
    )
    return docs.withColumn(out, let(columns, decoded))


def first_subtokens(subtokens: DataFrame, words: DataFrame) -> DataFrame:
    """Word labels from subtoken labels: the first subtoken of a word speaks.

    ``words`` lists ``doc_id, word``; words without a subtoken get O and 0.
    Neighbouring rows of a document are shuffled as one; any order is right.
    """
    keys, parts = ["doc_id", "_block"], ["word", "tok", "label", "score"]
    block = F.floor(F.col("word") / BLOCK).alias("_block")
    kind = words.schema["word"].dataType
    # NULLs are equal to no word and come before no subtoken.
    pieces = subtokens.dropna(subset=["doc_id", "word", "tok"]).select(
        "doc_id",
        block,
        F.col("word").cast(kind).alias("word"),
        "tok",
        F.col("label").cast("string").alias("label"),
        F.col("score").cast("double").alias("score"),
    )
    spoken = runs(pieces, keys, parts, first=(["doc_id", "word"], "tok"))
    absent = [F.lit(None).cast(spoken.schema[c].dataType).alias(c) for c in parts[1:]]
    asked = runs(words.select("doc_id", block, "word"), keys, ["word"]).select(*keys, "word", *absent)
    # Words of no document meet nothing, so they need not lie in one task.
    apart = F.when(F.col("doc_id").isNull() | F.col("_block").isNull(), F.xxhash64("word")).alias("_apart")
    met = asked.union(spoken).select("*", apart)
    fields = [T.StructField("doc_id", met.schema["doc_id"].dataType), T.StructField("word", kind)]
    schema = T.StructType([*fields, T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
    place = [*keys, "_apart"]
    return met.repartition(*place).sortWithinPartitions(*place).mapInArrow(_speak, schema)


#: Words of a document that are looked up together.
BLOCK = 4096


def _speak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers runs of words, sorted by document and block, from the runs of subtokens beside them."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            if held is not None:
                part = pa.concat_batches([held, part])
            # The last block may go on.
            last = int(starts(part, ["doc_id", "_block", "_apart"])[-1])
            held = part.slice(last)
            if last:
                yield _answers(part.slice(0, last))
    if held is not None:
        yield _answers(held)


def _answers(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The words of whole blocks, with label and score of their first subtokens."""
    group = np.zeros(rows.num_rows, np.int64)
    group[starts(rows, ["doc_id", "_block", "_apart"])] = 1
    group = group.cumsum()
    silent = rows.column("tok").is_null()

    def opened(side: pa.Array) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
        """The side's rows; of each word its row, key and whether it is one."""
        own = rows.filter(side)
        word = own.column("word").flatten()
        row = np.repeat(np.arange(own.num_rows), own.column("word").value_lengths().to_numpy())
        number = pc.fill_null(word, 0).to_numpy(zero_copy_only=False)
        key = group[side.to_numpy(zero_copy_only=False)][row] * BLOCK + number % BLOCK
        return own, row, key, word.is_valid().to_numpy(zero_copy_only=False)

    spoken, _, said, _ = opened(pc.invert(silent))
    asked, row, key, is_word = opened(silent)
    order = np.lexsort((spoken.column("tok").flatten().to_numpy(zero_copy_only=False), said))
    known, first = np.unique(said[order], return_index=True)
    at = np.searchsorted(known, key)
    hit = is_word & (at < len(known))
    hit[hit] = known[at[hit]] == key[hit]
    found = np.zeros(len(key), np.int64)
    found[hit] = order[first[at[hit]]]
    found = pa.array(found, mask=~hit)
    return pa.RecordBatch.from_arrays(
        [
            asked.column("doc_id").take(pa.array(row)),
            asked.column("word").flatten(),
            pc.fill_null(spoken.column("label").flatten().take(found), "O"),
            pc.fill_null(spoken.column("score").flatten().take(found), 0.0),
        ],
        names=["doc_id", "word", "label", "score"],
    )


def training_labels(subtoken_words: Column, word_label_ids: Column) -> Column:
    """Label ids per subtoken: later subtokens of a word, and specials, are ignored.

    ``subtoken_words`` holds the word index of each subtoken, NULL for specials.
    """
    both = F.struct(subtoken_words.alias("words"), word_label_ids.alias("ids"))
    return let(
        both,
        lambda b: F.transform(
            b["words"],
            lambda w, i: F.when(
                w.isNull() | ((i > 0) & F.coalesce(F.get(b["words"], i - 1) == w, F.lit(False))),
                F.lit(S.IGNORED_LABEL_ID),
            ).otherwise(F.get(b["ids"], w)),
        ),
    )


def label_counts(docs: DataFrame, group: str = "split") -> DataFrame:
    """Words per label and group."""
    return (
        docs.select(group, F.explode("labels").alias("label"))
        .groupBy(group, "label")
        .agg(F.count("*").alias("n"))
    )


def entity_coverage(docs: DataFrame, group: str = "split") -> DataFrame:
    """Share of documents per group that have each entity type."""

    def has(kind: str) -> Column:
        return F.exists("labels", lambda v: F.endswith(v, F.lit(f"-{kind}")))

    present = F.array(
        *[
            F.struct(F.lit(kind).alias("entity_type"), has(kind).alias("has"))
            for kind in S.ENTITY_TYPES
        ]
    )
    return (
        docs.select(group, F.explode(present).alias("e"))
        .groupBy(group, "e.entity_type")
        .agg(
            F.count_if("e.has").alias("documents"),
            F.count("*").alias("total"),
            F.round(F.avg(F.col("e.has").cast("double")), 4).alias("coverage"),
        )
    )


def class_weights(docs: DataFrame, label_ids: str, cap: float = S.MAX_CLASS_WEIGHT) -> DataFrame:
    """Weight of each of the seven labels: how much rarer than O, up to ``cap``.

    O itself is 1; labels that never occur get ``cap``.  Ignored positions do
    not count; a corpus without any label is an error.
    """
    counted = (
        docs.select(F.explode(label_ids).alias("label_id"))
        .filter(F.col("label_id") != S.IGNORED_LABEL_ID)
        .groupBy("label_id")
        .agg(F.count("*").alias("n"))
        .groupBy()
        .agg(F.map_from_entries(F.collect_list(F.struct("label_id", "n"))).alias("counts"))
    )
    names = F.array(*[F.lit(name) for name in S.TOKEN_LABELS])
    n = F.coalesce(F.try_element_at("counts", F.col("label_id")), F.lit(0))
    n_o = F.coalesce(F.try_element_at("counts", F.lit(0)), F.lit(0))
    weight = (
        F.when(F.col("label_id") == 0, F.lit(1.0))
        .when(n == 0, F.lit(cap))
        .otherwise(F.least(n_o / n, F.lit(cap)))
    )
    checked = F.when(
        F.size("counts") == 0, F.raise_error(F.lit("no labels to weigh")).cast("double")
    ).otherwise(F.round(weight, 4))
    return counted.select("counts", F.posexplode(names).alias("label_id", "label")).select(
        "label_id", "label", n.alias("n"), checked.alias("weight")
    )


def documents_without(docs: DataFrame, kind: str, group: str = "split", sample: int = 15):
    """Share of documents without any label of a type, and the first few of them.

    Returns ``(rates, samples)``; samples carry up to 30 words with digits.
    """
    lacking = ~F.exists(F.col("labels"), lambda v: F.endswith(v, F.lit(kind)))
    rates = docs.groupBy(group).agg(
        F.count_if(lacking).alias("missing"),
        F.count("*").alias("total"),
        F.round(F.avg(lacking.cast("double")), 4).alias("rate"),
    )
    first = Window.partitionBy(group).orderBy("doc_id")
    samples = (
        docs.filter(lacking)
        .withColumn("nth", F.row_number().over(first))
        .filter(F.col("nth") <= sample)
        .select(
            group,
            "doc_id",
            "nth",
            F.slice(F.filter("words", lambda w: w.rlike(r"\d")), 1, 30).alias("digit_words"),
        )
    )
    return rates, samples


def span_metrics(
    docs: DataFrame, predicted: str = "predicted_spans", truth: str = "true_spans"
) -> DataFrame:
    """Precision, recall and F1 of spans, overall and per entity type.

    A predicted span counts when type, start and end are those of a true one.
    """

    def keys(spans: str) -> Column:
        return F.transform(
            spans, lambda s: F.concat_ws("|", s["entity_type"], s["start_word"], s["end_word"])
        )

    staged = docs.select(keys(predicted).alias("p"), keys(truth).alias("t")).withColumn(
        "both", F.array_intersect("p", "t")
    )
    kinds = ["ALL", *S.ENTITY_TYPES]

    def of(column: Column, kind: str) -> Column:
        if kind == "ALL":
            return F.size(column)
        return F.size(F.filter(column, lambda v: F.startswith(v, F.lit(f"{kind}|"))))

    per_doc = F.array(
        *[
            F.struct(
                F.lit(kind).alias("entity_type"),
                of(F.col("both"), kind).alias("tp"),
                of(F.col("p"), kind).alias("np"),
                of(F.col("t"), kind).alias("nt"),
            )
            for kind in kinds
        ]
    )
    return (
        staged.select(F.explode(per_doc).alias("c"))
        .groupBy("c.entity_type")
        .agg(F.sum("c.tp").alias("tp"), F.sum("c.np").alias("np"), F.sum("c.nt").alias("nt"))
        .select("entity_type", *_ratios(F.col("tp"), F.col("np"), F.col("nt")))
    )


def _ratios(tp: Column, predicted: Column, support: Column) -> list[Column]:
    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)

    return [
        F.round(ratio(tp, predicted), 4).alias("precision"),
        F.round(ratio(tp, support), 4).alias("recall"),
        F.round(ratio(tp * 2, predicted + support), 4).alias("f1"),
        support.alias("support"),
    ]


def token_accuracy(docs: DataFrame, predicted: str, truth: str) -> DataFrame:
    hits = F.aggregate(
        F.zip_with(predicted, truth, lambda a, b: (a == b).cast("long")),
        F.lit(0).cast("long"),
        lambda total, hit: total + hit,
    )
    return docs.agg(
        F.sum(F.size(truth)).cast("long").alias("tokens"),
        F.round(F.sum(hits) / F.sum(F.size(truth)), 4).alias("accuracy"),
    )


def o_share(docs: DataFrame, labels: str = "labels") -> DataFrame:
    """Words per label with O's share of all words, without exploding them."""
    n_o = F.size(F.filter(labels, lambda v: v == "O"))
    return docs.agg(
        F.sum(F.size(labels)).cast("long").alias("tokens"),
        F.round(F.sum(n_o) / F.sum(F.size(labels)), 4).alias("o_ratio"),
    )


def best_label(scores: Column) -> Column:
    """Index of the highest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def best_span(spans: Column, kind: str) -> Column:
    """The span of a type with the highest score, the earliest one on ties."""
    ranked = F.transform(
        F.filter(spans, lambda s: s["entity_type"] == kind),
        lambda s: F.struct(
            s["score"].alias("score"), (-s["start_word"]).alias("_early"), s["text"].alias("text")
        ),
    )
    return F.array_max(ranked)
