"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The model is fitted on a bounded sample of labelled rows (``max_rows``, the
smallest by a hash of their id): a lexicon of words and word beginnings that
toxic texts of the sample use far more often than others, trees on dense
features, and an isotonic curve from raw score to probability; trees and curve
are fitted across folds.  Scoring reads every whole text
once, keeps nothing between rows and needs no shuffle; what is broadcast is the
model, whose size the parameters bound.

Defined results: a NULL text is an empty one, and an empty text gets the score
of a text without any toxic sign; ids may repeat or be NULL; a label that is NULL, or
whose document is missing, is not learned from, and of several labels of an id
the largest counts; with no label, or labels of one kind only, the score is the
share of that kind, pulled towards one half; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

WORD = re.compile(r"[^\W_](?:[\w'*@$!#]*[\w*@$#])?")
LINE_SIGNS = "!?.,;:"
SIGNS = "*@$#%&"
FOLDS = 3
CAPITAL = re.compile("[A-Z\u00c0-\u00d6\u00d8-\u00de]")
#: Second person, in the languages of the texts.  Fixed values.
SECOND_PERSON = frozenset(
    "you your yours yourself ya u tu te toi ton ta tes vous votre vos du dich dir dein deine "
    "deiner ihr euch euer usted ustedes ti tus vosotros vuestra vuestro su sus".split()
)
#: Stand-ins for letters.  Fixed values.
STANDINS = str.maketrans({"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i"})
FEATURES = [
    "lexicon_density",
    "lexicon_hits",
    "stem_density",
    "stem_hits",
    "disguised_hits",
    "near_second_person",
    "second_person",
    "upper_share",
    "bangs",
    "questions",
    "other_signs",
    "disguised_words",
    "log_words",
]


@dataclass
class Lexicon:
    """Words, and beginnings of words, with the log odds of toxic texts using them."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    stem_sizes: tuple[int, ...] = (4, 5, 6)
    reach: int = 5


@dataclass
class Model:
    lexicon: Lexicon
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    knots: np.ndarray
    values: np.ndarray


def plain(word: str) -> str:
    return word.translate(STANDINS).replace("*", "")


def learn_lexicon(texts: list[str], toxic: np.ndarray, most: int = 4000, least_odds: float = 2.0) -> Lexicon:
    """Terms whose smoothed log odds of occurring in toxic texts exceed ``least_odds``."""
    lexicon = Lexicon()
    seen = {True: (Counter(), Counter()), False: (Counter(), Counter())}
    for text, bad in zip(texts, toxic.tolist(), strict=True):
        words = set(text.lower().split())
        words = {p for w in words for m in WORD.findall(w) for p in (m, plain(m))}
        stems = {w[:n] for w in words for n in lexicon.stem_sizes if len(w) > n}
        seen[bool(bad)][0].update(words)
        seen[bool(bad)][1].update(stems)
    n_bad = int(toxic.sum())
    n_good = len(texts) - n_bad
    if not n_bad or not n_good:
        return lexicon
    least = max(2, n_bad // 400)
    for kind, into in ((0, lexicon.words), (1, lexicon.stems)):
        odds = {
            term: np.log((n + 0.5) / (n_bad + 1)) - np.log((seen[False][kind][term] + 0.5) / (n_good + 1))
            for term, n in seen[True][kind].items()
            if n >= least
        }
        best = sorted(((-v, t) for t, v in odds.items() if v >= least_odds))[:most]
        into.update({t: float(-v) for v, t in best})
    return lexicon


class Reader:
    """Turns texts into features; remembers what it found out about a token."""

    def __init__(self, lexicon: Lexicon, most: int = 300_000):
        self.lexicon = lexicon
        self.most = most
        self.known: dict[str, tuple[float, ...] | None] = {}

    def about(self, token: str) -> tuple[float, ...] | None:
        """Lexicon hits, disguised hits, stem weight, disguised words; None if all are 0."""
        hits = hidden = stems = disguised = 0.0
        for word in (token,) if token.isalpha() else WORD.findall(token):
            bare = word
            if not word.isalpha():
                bare = plain(word)
                disguised += bare != word and bare.isalpha() and not word.isdigit()
            if bare in self.lexicon.words:
                hits += 1
                hidden += bare != word
            stems += max(
                (self.lexicon.stems.get(bare[:n], 0.0) for n in self.lexicon.stem_sizes if len(bare) > n),
                default=0.0,
            )
        return (hits, hidden, stems, disguised) if hits or stems or disguised else None

    def features(self, text: str) -> list[float]:
        """Dense features of one whole text, in the order of FEATURES."""
        tokens = text.lower().split()
        kinds = Counter(tokens)
        if len(self.known) > self.most:
            self.known = {}
        known, total, marked = self.known, [0.0] * 4, set()
        for token, times in kinds.items():
            try:
                found = known[token]
            except KeyError:
                found = known[token] = self.about(token)
            if found:
                total = [a + times * b for a, b in zip(total, found, strict=True)]
                if found[0] or found[2]:
                    marked.add(token)
        hits, hidden, stems, disguised = total
        near = 0
        if marked:
            you = [i for i, t in enumerate(tokens) if t.strip(LINE_SIGNS) in SECOND_PERSON]
            at = np.array([i for i, t in enumerate(tokens) if t in marked])
            around = np.array([-(10**9), *you, 10**9])
            places = np.searchsorted(around, at)
            gap = np.minimum(at - around[places - 1], around[places] - at)
            near = int((gap <= self.lexicon.reach).sum())
        per = 100.0 / max(len(tokens), 1)
        return [
            hits * per,
            min(hits, 50.0),
            stems * per,
            min(stems, 200.0),
            hidden,
            near * per,
            sum(kinds[w] for w in SECOND_PERSON if w in kinds) * per,
            len(CAPITAL.findall(text)) / max(len(text), 1),
            text.count("!") * per,
            text.count("?") * per,
            sum(text.count(s) for s in SIGNS) * per,
            disguised * per,
            float(np.log1p(len(tokens))),
        ]

    def table(self, texts: list[str]) -> np.ndarray:
        return np.array([self.features(t) for t in texts]).reshape(len(texts), len(FEATURES))


def fit_tree(x: np.ndarray, bins: list[np.ndarray], codes: np.ndarray, grad: np.ndarray, hess: np.ndarray,
             depth: int, rate: float, l2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One regression tree, grown level by level from gradient histograms.

    Nodes lie in heap order; a node without a split has feature -1.
    """
    size = 2 ** (depth + 1) - 1
    feature = np.full(size, -1)
    threshold = np.zeros(size)
    value = np.zeros(size)
    node = np.zeros(len(x), dtype=np.int64)
    width = max(len(b) for b in bins) + 1
    for level in range(depth + 1):
        first, many = 2**level - 1, 2**level
        local = node - first
        live = (local >= 0) & (local < many)
        g = np.bincount(local[live], grad[live], many)
        h = np.bincount(local[live], hess[live], many)
        value[first : first + many] = -rate * g / (h + l2)
        if level == depth:
            break
        best = np.full(many, 1e-6)
        for f, edges in enumerate(bins):
            if not len(edges):
                continue
            at = local[live] * width + codes[live, f]
            gs = np.bincount(at, grad[live], many * width).reshape(many, width).cumsum(1)[:, : len(edges)]
            hs = np.bincount(at, hess[live], many * width).reshape(many, width).cumsum(1)[:, : len(edges)]
            gain = gs**2 / (hs + l2) + (g[:, None] - gs) ** 2 / (h[:, None] - hs + l2) - (g**2 / (h + l2))[:, None]
            gain[(hs < 0.5) | (h[:, None] - hs < 0.5)] = 0
            pick = gain.argmax(1)
            top = gain[np.arange(many), pick]
            better = top > best
            best[better] = top[better]
            feature[first : first + many][better] = f
            threshold[first : first + many][better] = edges[pick[better]]
        f = feature[node]
        split = live & (f >= 0)
        right = x[np.arange(len(x)), np.maximum(f, 0)] > threshold[node]
        node = np.where(split, 2 * node + 1 + right, np.where(live, -1, node))
    return feature, threshold, value


def raw_scores(model_trees: list, base: float, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), base)
    rows = np.arange(len(x))
    for feature, threshold, value in model_trees:
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            right = x[rows, np.maximum(f, 0)] > threshold[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        out += value[node]
    return out


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots and rising shares of label 1, each pulled slightly inwards."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, y in zip(score[order].tolist(), label[order].tolist(), strict=True):
        if blocks and blocks[-1][0] == s:  # equal scores share a block
            blocks[-1][1] += y
            blocks[-1][2] += 1
            continue
        blocks.append([s, y, 1.0, s])
    pooled: list[list[float]] = []
    for first, y, n, _ in blocks:
        pooled.append([first, y, n, first])
        while len(pooled) > 1 and pooled[-2][1] * pooled[-1][2] >= pooled[-1][1] * pooled[-2][2]:
            _, y2, n2, last = pooled.pop()
            pooled[-1][1] += y2
            pooled[-1][2] += n2
            pooled[-1][3] = last
    knots, values = [], []
    for first, y, n, last in pooled:
        knots += [first] if first == last else [first, last]
        values += [(y + 0.05) / (n + 0.1)] * (1 if first == last else 2)
    return np.array(knots), np.maximum.accumulate(np.array(values))


def fit(texts: list[str], toxic: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.15, l2: float = 1.0,
        seed: int = 7) -> Model:
    """Fit lexicon, trees and calibration on the given sample."""
    toxic = toxic.astype(float)
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    if toxic.sum() < 3 or (1 - toxic).sum() < 3:
        return Model(Lexicon(), 0.0, [], np.array([0.0]), np.array([share]))
    # Folds by turns within each label, in a fixed random order.
    fold = np.zeros(len(toxic), dtype=int)
    for kind in (0.0, 1.0):
        rows = np.flatnonzero(toxic == kind)
        fold[np.random.default_rng(seed).permutation(rows)] = np.arange(len(rows)) % FOLDS
    # Each row's features come from a lexicon of the other folds, so that the
    # trees see terms as they will behave on new texts.
    x = np.zeros((len(toxic), len(FEATURES)))
    for k in range(FOLDS):
        others = [t for t, f in zip(texts, fold, strict=True) if f != k]
        reader = Reader(learn_lexicon(others, toxic[fold != k]))
        x[fold == k] = reader.table([t for t, f in zip(texts, fold, strict=True) if f == k])
    base = float(np.log(share / (1 - share)))
    grow = lambda rows: boost(x[rows], toxic[rows], base, trees, depth, rate, l2)
    # The curve is fitted on scores of rows that their trees have not seen.
    raw = np.zeros(len(toxic))
    for k in range(FOLDS):
        raw[fold == k] = raw_scores(grow(fold != k), base, x[fold == k])
    knots, values = isotonic(raw, toxic)
    return Model(learn_lexicon(texts, toxic), base, grow(fold >= 0), knots, values)


def boost(x: np.ndarray, y: np.ndarray, base: float, trees: int, depth: int, rate: float, l2: float) -> list:
    """Trees for the logistic loss."""
    bins = [np.unique(np.r_[0.0, np.quantile(x[:, f], np.linspace(0, 1, 65))])[:-1] for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(bins)], 1)
    grown, raw = [], np.full(len(x), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grown.append(fit_tree(x, bins, codes, p - y, p * (1 - p), depth, rate, l2))
        raw += raw_scores(grown[-1:], 0.0, x)
    return grown


def predict(model: Model, reader: Reader, texts: list[str]) -> np.ndarray:
    if not model.trees:
        return np.full(len(texts), float(model.values[-1]))
    raw = raw_scores(model.trees, model.base, reader.table(texts))
    return np.interp(raw, model.knots, model.values)


def training_rows(docs: DataFrame, labels: DataFrame, learnable, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled rows as (text, toxic), chosen by a hash of the id.

    The ids are chosen from the labels alone; only their texts are then read,
    through a join with a table of at most ``max_rows`` ids.
    """
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .where(learnable(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .select("text", "toxic")
    )


def fit_from_tables(docs: DataFrame, labels: DataFrame, learnable, max_rows: int = 6_000, **params) -> Model:
    """Fit on at most ``max_rows`` labelled documents for which ``learnable(doc_id)`` holds."""
    sample = training_rows(docs, labels, learnable, max_rows).toPandas()
    return fit(sample["text"].tolist(), sample["toxic"].to_numpy(dtype=float), **params)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic, from the text alone."""
    if column in docs.columns:
        raise ValueError(f"{column} is a column already")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader = Reader(model.lexicon)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            scores = pa.array(predict(model, reader, texts), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, schema)
