"""A gated recurrent language model with a class-factored softmax, in numpy.

Counts of all training words are a Spark aggregation.  The ``head`` most frequent
words are modelled one by one; every other word belongs to a tail class by its
ending, and its share of the class comes from the counts.  The probability of a word is that of its
class given the state, times that of the word within its class: a softmax for
head classes, (c + 0.5) / (S + 0.5 (D + 1)) for tail classes (c: the word's
count, S and D: words and distinct words of the class in the training texts; a
word never seen has c = 0, as in the usual unigram baseline).

The gated recurrent units are trained by truncated backpropagation: each
partition trains a copy on every window of its training documents, the state
carried from window to window and a lane taking the next stretch of a document when its own
ends; each document is learned from once, in one of the rounds, and copies are averaged, in groups of a fixed
size, between rounds.  Gradients wait until a fixed number of tokens has been
seen before they make a step.  Scoring carries the state across windows through the
whole of each document.

Broadcast are the ``known`` most frequent words with their counts (words of at most
``longest`` bytes) and the parameters; both have fixed bounds.  Words beyond them
are looked up in the table of counts by a join.

Defined results: a NULL text is empty and scored as its end alone; a document without
an id is held out; rows may repeat; very long texts are scored whole, in one lane,
and learned from in stretches; without any training document every count
is 0; an empty table gives no rows; other columns are ignored.  Scores depend on how the
table is partitioned, as each partition trains a copy; the base columns do not.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import held_out, stored
from tallyweave.operators.lookup import lookup

#: Stands for the end of a document; no word is empty.
END = b""


@dataclass
class Settings:
    head: int = 2048
    head_classes: int = 32
    tail_classes: int = 64
    known: int = 400_000
    longest: int = 64
    units: int = 16
    window: int = 16
    #: Words of a training text that one lane takes; the rest of a longer one begins anew in another lane,
    #: or lanes would stand idle while the last long texts go on.
    stretch: int = 256
    lanes: int = 256
    #: Live tokens whose gradients make a step, so that a partition's last long texts take no steps of their own.
    tokens_a_step: int = 2048
    rounds: int = 2
    rates: tuple[float, ...] = (0.01, 0.004)
    #: Texts that are scored side by side, and their bytes.
    score_lanes: int = 8192
    score_bytes: int = 32_000_000
    seed: int = 3


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case A-Z, cut at ASCII white space: bytes know no other letters or spaces."""
    return (text or b"").lower().split()


# --- counts -----------------------------------------------------------------------


def word_counts(training: DataFrame, most: int = 200_000) -> DataFrame:
    """(word binary, n) over all ``text`` of ``training``; END counts documents.

    Each task adds up what it reads and passes on its sums whenever they reach
    ``most`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
            )
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                seen.update(words_of(text.as_py()))
                seen[END] += 1
                if len(seen) >= most:
                    yield flush()
        yield flush()

    partial = training.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Bounded tables about the most frequent words; places 0 .. are by falling count."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    inputs: np.ndarray  # row of the input table
    classes: np.ndarray
    spots: np.ndarray  # column of the head softmax, -1 in the tail
    tail_log: np.ndarray  # log10 of the share of the class, 0 in the head
    endings: dict[bytes, int]
    class_sums: np.ndarray  # S and D by tail class
    bounds: np.ndarray  # columns of each head class
    head: int
    head_classes: int
    tail_classes: int

    def tail_class(self, word: bytes) -> int:
        return self.endings.get(word[-2:], self.tail_classes - 1)


def build_vocabulary(counts: DataFrame, s: Settings) -> Vocabulary:
    """From the table of counts: sums are Spark's; the driver gets bounded lists."""
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    size = F.octet_length("word")
    eighth = F.floor(F.log2("n") * 8)  # counts by eighths of a power of two: some hundred steps
    common = counts.where(size <= s.longest)
    steps = sorted(common.groupBy(eighth.alias("k")).agg(F.count("*").alias("m")).collect(), reverse=True)
    least, room = 0, s.known
    for row in steps:
        room -= row["m"]
        if room < 0:
            break
        least = row["k"]
    listed = common.where((eighth >= least) | (F.col("word") == END)).toPandas() if steps else None
    words, n = [END], np.array([0], np.int64)
    if listed is not None and len(listed):
        # The end stands first, whatever its count; the others by falling count.
        pairs = sorted(
            zip(map(bytes, listed["word"]), listed["n"].tolist(), strict=True), key=lambda x: (x[0] != END, -x[1], x[0])
        )
        words, n = [w for w, _ in pairs], np.array([c for _, c in pairs], np.int64)
    head = min(len(words), s.head + 1)
    last_n, last_word = int(n[head - 1]), words[head - 1]
    in_head = (F.col("word") == END) | (
        (size <= s.longest) & ((F.col("n") > last_n) | ((F.col("n") == last_n) & (F.col("word") <= F.lit(last_word))))
        if head > 1
        else F.lit(False)
    )
    ending = F.when(size >= 2, F.expr("substring(word, octet_length(word) - 1, 2)")).otherwise(F.col("word"))
    tail = counts.where(~in_head).groupBy(ending.alias("ending")).agg(
        F.sum("n").alias("s"), F.count("*").alias("d")
    )
    # Two bytes: at most 65,792 endings.
    sums = sorted(
        ((int(r["s"]), int(r["d"]), bytes(r["ending"])) for r in tail.collect()), key=lambda r: (-r[0], r[2])
    )
    endings = {e: k for k, (_, _, e) in enumerate(sums[: s.tail_classes - 1])}
    class_sums = np.zeros((s.tail_classes, 2))
    for a, b, e in sums:
        class_sums[endings.get(e, s.tail_classes - 1)] += (a, b)
    # Head classes: equal numbers of words, by frequency.
    edges = np.unique(np.linspace(0, head, s.head_classes + 1).astype(int))
    head_classes = len(edges) - 1
    own = np.repeat(np.arange(head_classes), np.diff(edges))
    tails = np.array([endings.get(w[-2:], s.tail_classes - 1) for w in words[head:]], np.int64)
    tail_log = np.zeros(len(words))
    tail_log[head:] = np.log10((n[head:] + 0.5) / (class_sums[tails, 0] + 0.5 * (class_sums[tails, 1] + 1)))
    return Vocabulary(
        words,
        n,
        int(totals[0] or 0),
        int(totals[1] or 0),
        np.r_[np.arange(head), head + tails].astype(np.int32),
        np.r_[own, head_classes + tails].astype(np.int32),
        np.r_[np.arange(head), np.full(len(words) - head, -1)].astype(np.int32),
        tail_log,
        endings,
        class_sums,
        edges,
        head,
        head_classes,
        s.tail_classes,
    )


# --- the model ----------------------------------------------------------------------


def start_parameters(v: Vocabulary, s: Settings) -> dict[str, np.ndarray]:
    """Small random weights; biases that make the untrained model the unigram model."""
    rng = np.random.default_rng(s.seed)
    h, rows, classes = s.units, v.head + v.tail_classes, v.head_classes + v.tail_classes
    counts = v.counts[: v.head] + 0.5
    mass = np.r_[np.add.reduceat(counts, v.bounds[:-1]), v.class_sums[:, 0] + 0.5 * (v.class_sums[:, 1] + 1)]
    params = {
        "inputs": rng.normal(0, 0.3, (rows, 3 * h)),
        "units": rng.normal(0, 0.3 / np.sqrt(h), (h, 3 * h)),
        "class_w": np.zeros((h, classes)),
        "class_b": np.log(mass / mass.sum()),
        "word_w": np.zeros((h, v.head)),
        "word_b": np.log(counts),
    }
    return {k: p.astype(np.float32) for k, p in params.items()}


def by_gate(table: np.ndarray) -> np.ndarray:
    """Rows of three gates as three tables without gaps, which are quicker to go through; times -1 and,
    for the new content, -2, as ``gated`` wants them."""
    out = np.ascontiguousarray(np.moveaxis(table.reshape(len(table), 3, -1), 1, 0))
    out *= np.array([-1, -1, -2], table.dtype)[:, None, None]
    return out


def step(p: dict[str, np.ndarray], h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, tuple]:
    """One token: the state after it, and what the way back needs."""
    return gated(by_gate(p["units"]), h, by_gate(p["inputs"][rows]))


@np.errstate(over="ignore")
def gated(units: np.ndarray, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """As ``step``, from tables by gate; ``x``, the input rows, is overwritten.

    The logistic function and tanh by way of exp, which is quicker; where it overflows they are at their limits.
    """
    u = np.matmul(h, units)
    gates, n = x[:2], x[2]
    gates += u[:2]
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    u = u[2]
    n += gates[0] * u
    np.exp(n, out=n)
    n += 1
    np.divide(2, n, out=n)
    n -= 1
    after = h - n
    after *= gates[1]
    after += n
    return after, (u, gates[0], gates[1], n)


def log_sums(states: np.ndarray, w: np.ndarray, b: np.ndarray, safe: bool, rows: int = 1024) -> np.ndarray:
    """log of the sum of exp of each row of outputs, some rows at a time, which stay in the cache."""
    out, weight = np.empty(len(states), states.dtype), np.exp(b) if safe else np.ones_like(b)
    for a in range(0, len(states), rows):
        logits = states[a : a + rows] @ w
        if not safe:
            logits += b
            top = logits.max(axis=1)
            logits -= top[:, None]
        np.exp(logits, out=logits)
        out[a : a + rows] = np.log(logits @ weight)
        if not safe:
            out[a : a + rows] += top
    return out


def softmax_back(
    states: np.ndarray, columns: np.ndarray, b: np.ndarray, at: np.ndarray, safe: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the states, of the columns and of ``b`` by -log of the share of column ``at``.

    The share of a column is exp(states @ column) * weight / total: weights and totals are
    multiplied in where arrays are small.
    """
    e, weight = states @ columns.T, np.exp(b) if safe else np.ones_like(b)
    if not safe:
        e += b
        e -= e.max(axis=1, keepdims=True)
    np.exp(e, out=e)
    total = e @ weight
    e.reshape(-1)[np.arange(0, e.size, len(b)) + at] -= total / weight[at]
    share = 1 / total
    back = e @ (columns * weight[:, None])
    back *= share[:, None]
    return back, (e.T @ (states * share[:, None])) * weight[:, None], (share @ e) * weight


def safe_output(p: dict) -> bool:
    """Whether no output can be so large that its exp() overflows: states lie within -1 and 1."""
    pairs = (p["class_w"], p["class_b"]), (p["word_w"], p["word_b"])
    return max((np.abs(w).sum(0) + np.abs(b)).max() for w, b in pairs) < 80


def output_logs(
    p: dict, v: Vocabulary, states: np.ndarray, classes: np.ndarray, spots: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Natural log of the class and, within it, of the head word of each token, together and of the class alone."""
    safe = safe_output(p)
    alone = np.einsum("ij,ij->i", states, np.ascontiguousarray(p["class_w"].T)[classes]) + p["class_b"][classes]
    alone -= log_sums(states, p["class_w"], p["class_b"], safe)
    order, starts = by_head_class(v, classes, spots)
    order = order[: starts[-1]]
    inside, at = states[order], spots[order]
    word = np.einsum("ij,ij->i", inside, np.ascontiguousarray(p["word_w"].T)[at]) + p["word_b"][at]
    for k in np.flatnonzero(np.diff(starts)).tolist():
        own, columns = slice(starts[k], starts[k + 1]), slice(v.bounds[k], v.bounds[k + 1])
        word[own] -= log_sums(inside[own], p["word_w"][:, columns], p["word_b"][columns], safe)
    out = alone.copy()
    out[order] += word
    return out, alone


def output_back(
    p: dict, v: Vocabulary, states: np.ndarray, classes: np.ndarray, spots: np.ndarray, grads: dict
) -> np.ndarray:
    """Gradient of the states by -log of the probability of each token; adds those of the outputs to ``grads``."""
    safe = safe_output(p)
    back, w, b = softmax_back(states, np.ascontiguousarray(p["class_w"].T), p["class_b"], classes, safe)
    grads["class_w"] += w.T
    grads["class_b"] += b
    order, starts = by_head_class(v, classes, spots)
    order = order[: starts[-1]]
    inside, at = states[order], spots[order]
    behind, columns = np.empty_like(inside), np.ascontiguousarray(p["word_w"].T)
    found = np.zeros_like(columns)
    for k in np.flatnonzero(np.diff(starts)).tolist():
        own, words = slice(starts[k], starts[k + 1]), slice(v.bounds[k], v.bounds[k + 1])
        behind[own], found[words], b = softmax_back(
            inside[own], columns[words], p["word_b"][words], at[own] - v.bounds[k], safe
        )
        grads["word_b"][words] += b
    grads["word_w"] += found.T
    back[order] += behind
    return back


def by_head_class(v: Vocabulary, classes: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by the class of their head word, those of the tail last; where each class starts, and the tail."""
    head = np.where(spots >= 0, classes, v.head_classes)
    order = np.argsort(short(head), kind="stable")
    return order, np.searchsorted(head[order], np.arange(v.head_classes + 1))


def short(places: np.ndarray) -> np.ndarray:
    """As 16 bits, if they fit, which are sorted much quicker."""
    return places.astype(np.int16) if len(places) and places.max() < 2**15 else places


class Trainer:
    """Adam over windows of truncated backpropagation, for a fixed number of lanes."""

    def __init__(self, params: dict, v: Vocabulary, s: Settings, rate: float):
        self.v, self.s, self.rate, self.t = v, s, rate, 0
        # All parameters in one array, of which ``p`` and ``grads`` show parts by name.
        self.all = np.concatenate([x.ravel() for x in params.values()]) if params else np.zeros(0, np.float32)
        self.g, self.m, self.n = (np.zeros_like(self.all) for _ in range(3))
        self.p, self.grads = shown(self.all, params), shown(self.g, params)
        self.tokens = self.waiting = 0

    def learn(self, texts: Iterator[np.ndarray]) -> None:
        """All windows of all texts, given as places in the vocabulary, or -1 - tail class.

        A lane takes the next stretch of a text when its own has ended; until its window is over it idles.
        """
        s = self.s
        texts = (ids[a : a + s.stretch] for ids in texts for a in range(0, len(ids), s.stretch))
        held, h = np.zeros((s.lanes, s.stretch), np.int64), np.zeros((s.lanes, s.units), np.float32)
        at, ends = np.zeros((2, s.lanes), int)
        while True:
            for k, ids in zip(np.flatnonzero(at >= ends).tolist(), texts):  # noqa: B905
                held[k, : len(ids)], at[k], ends[k], h[k] = ids, 0, len(ids), 0
            own = np.flatnonzero(at < ends)
            if not len(own):
                self.update()
                return
            lengths = np.minimum(ends[own] - at[own], s.window)
            steps = np.arange(lengths.max())[:, None]
            live = steps < lengths
            block = held[own, np.where(live, at[own] + steps, 0)]
            h[own] = self.window(h[own], *places_of(self.v, block), live)
            at[own] += lengths
            self.tokens += int(lengths.sum())

    def window(self, h, rows, classes, spots, live):
        p, units, grads = self.p, self.s.units, self.grads
        w = by_gate(p["units"])
        x = np.take(by_gate(p["inputs"]), rows, axis=1)
        states, u = np.empty((2, *rows.shape, units), h.dtype)
        for t in range(len(rows)):
            states[t] = h
            h, (u[t], *_) = gated(w, h, x[:, t])
        r, z, n = x
        flat, use, full = states.reshape(-1, units), live.ravel(), live.all(axis=1)
        if full.all():
            ahead = output_back(p, self.v, flat, classes.ravel(), spots.ravel(), grads)
        else:
            ahead = np.zeros_like(flat)
            ahead[use] = output_back(p, self.v, flat[use], classes.ravel()[use], spots.ravel()[use], grads)
        ahead = ahead.reshape(states.shape)
        # What the gradient of a state is multiplied with on its way to each gate, for all tokens at once.
        to_n = (1 - z) * (1 - n * n)
        to_z = (states - n) * (z * (1 - z))
        to_r = (-0.5 * u) * (r * (1 - r))
        dx, dn = np.empty_like(x), np.empty((len(rows), *h.shape), h.dtype)
        turned = np.ascontiguousarray(np.moveaxis(p["units"].reshape(units, 3, units), 0, 2))
        dh, du = np.zeros_like(h), np.empty((3, *h.shape), h.dtype)
        for t in range(len(rows) - 1, -1, -1):
            if not full[t]:
                dh *= live[t][:, None]
            np.multiply(dh, to_n[t], out=dx[2, t])
            np.multiply(dh, to_z[t], out=dx[1, t])
            np.multiply(dx[2, t], to_r[t], out=dx[0, t])
            np.multiply(dx[2, t], r[t], out=dn[t])
            du[:2], du[2] = dx[:2, t], dn[t]
            dh *= z[t]
            for part in np.matmul(du, turned):
                dh += part
            dh += ahead[t]
        for k, d in enumerate((dx[0], dx[1], dn)):
            grads["units"][:, k * units : (k + 1) * units] += flat.T @ d.reshape(-1, units)
        order = np.argsort(short(rows.ravel()), kind="stable")
        sorted_rows = rows.ravel()[order]
        first = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]])
        by_row = np.moveaxis(dx, 0, 2).reshape(-1, 3 * units)[order]
        grads["inputs"][sorted_rows[first]] += np.add.reduceat(by_row, first)
        self.waiting += int(use.sum())
        if self.waiting >= self.s.tokens_a_step:
            self.update()
        return h

    def update(self, many: int = 16_384) -> None:
        """One step of Adam by the mean gradient of the tokens that wait for one."""
        if not self.waiting:
            return
        self.t += 1
        rate = self.rate * math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        # Some parameters at a time, which stay in the cache.
        for a in range(0, len(self.all), many):
            p, g, m, n = (x[a : a + many] for x in (self.all, self.g, self.m, self.n))
            g /= self.waiting
            m += 0.1 * (g - m)
            g *= g
            n += 0.001 * (g - n)
            p -= rate * m / (np.sqrt(n) + 1e-8)
            g[:] = 0
        self.waiting = 0


def shown(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Parts of ``flat`` by name, in the order and shapes of ``like``."""
    out, at = {}, 0
    for k, x in like.items():
        out[k] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    return out


def places_of(v: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input rows, classes and head columns; -1 - k stands for a word of tail class k."""
    known = np.maximum(ids, 0)
    tail = -1 - ids
    beyond = ids < 0
    return (
        np.where(beyond, v.head + tail, v.inputs[known]),
        np.where(beyond, v.head_classes + tail, v.classes[known]),
        np.where(beyond, -1, v.spots[known]),
    )


def ids_of(words: list[bytes], number: dict[bytes, int], v: Vocabulary) -> tuple[np.ndarray, list[int]]:
    """Places of words and, at last, the end; the positions of words beyond the known ones."""
    ids = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
    missing = np.flatnonzero(ids < 0).tolist()
    for i in missing:
        ids[i] = -1 - v.tail_class(words[i])
    return np.r_[ids, 0], missing


# --- training ------------------------------------------------------------------------


def train(training: DataFrame, v: Vocabulary, s: Settings, fan_in: int = 32) -> dict[str, np.ndarray]:
    """Parameters after ``rounds`` rounds; each round learns from its share of the documents."""
    params = start_parameters(v, s)
    context = training.sparkSession.sparkContext
    vocabulary = context.broadcast(v)
    for turn in range(s.rounds):
        start = context.broadcast(params)
        rate = s.rates[min(turn, len(s.rates) - 1)]

        def run(batches: Iterator[pa.RecordBatch], start=start, rate=rate) -> Iterator[pa.RecordBatch]:
            v = vocabulary.value
            number = {w: k for k, w in enumerate(v.words)}
            trainer = Trainer(start.value, v, s, rate)
            copy = 0

            def texts() -> Iterator[np.ndarray]:
                nonlocal copy
                for batch in batches:
                    for text, at in zip(batch.column("text"), batch.column("at").to_pylist(), strict=True):
                        copy = copy or at
                        yield ids_of(words_of(text.as_py()), number, v)[0]

            trainer.learn(texts())
            if trainer.tokens:
                yield _packed(copy, trainer.tokens, trainer.p)

        share = F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(s.rounds)) == turn
        copies = (
            training.where(share)
            .select(F.col("text").cast("binary").alias("text"), F.abs(F.xxhash64("doc_id") % (2**40)).alias("at"))
            .mapInArrow(run, COPY)
        )
        # Copies are averaged in groups of fixed size until one group is left.
        copies = stored(copies, "copies")
        while (many := copies.count()) > fan_in:
            groups = -(-many // fan_in)
            group = F.pmod(F.xxhash64("copy", "tokens"), F.lit(groups))
            copies = stored(copies.groupBy(group.alias("g")).applyInPandas(_averaged, COPY), "copies")
        if many:
            params = _unpacked(_averaged(copies.toPandas())["params"][0], params)
    return params


COPY = "copy bigint, tokens bigint, params binary"


def _packed(copy: int, tokens: int, p: dict[str, np.ndarray]) -> pa.RecordBatch:
    flat = np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float32)
    return pa.RecordBatch.from_arrays(
        [pa.array([copy], pa.int64()), pa.array([tokens], pa.int64()), pa.array([flat.tobytes()], pa.binary())],
        names=["copy", "tokens", "params"],
    )


def _averaged(copies: pd.DataFrame) -> pd.DataFrame:
    """The mean of copies, each weighing as many tokens as it has learned from."""
    total, mean = int(copies["tokens"].sum()), 0.0
    for tokens, params in zip(copies["tokens"], copies["params"], strict=True):
        mean = mean + np.frombuffer(params, np.float32).astype(np.float64) * (tokens / total)
    return pd.DataFrame(
        {"copy": [int(copies["copy"].min())], "tokens": [total], "params": [mean.astype(np.float32).tobytes()]}
    )


def _unpacked(packed: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(packed, np.float32), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


# --- scoring -----------------------------------------------------------------------


class Scorer:
    """log10 of class and head-word probabilities, summed over whole texts."""

    #: Lanes that run together, and tokens whose states wait for their outputs: both stay in the cache.
    together, waiting = 1024, 8192

    def __init__(self, p: dict, v: Vocabulary, s: Settings):
        self.p, self.v, self.s = p, v, s
        self.inputs, self.units = by_gate(p["inputs"]), by_gate(p["units"])

    def logs(self, states: np.ndarray, classes: np.ndarray, spots: np.ndarray) -> np.ndarray:
        return output_logs(self.p, self.v, states, classes, spots)[0]

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Texts run side by side, longest first, so that those still running are
        always the first lanes; the state goes on from window to window, which
        are the longer the fewer lanes still run."""
        s, out = self.s, np.zeros(len(texts))
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        side = min(s.score_lanes, self.together)
        for a in range(0, len(order), side):
            lanes = order[a : a + side]
            lengths = np.array([len(texts[k]) for k in lanes])
            tables = places_of(self.v, np.concatenate([texts[k] for k in lanes]))
            begin = np.r_[0, lengths.cumsum()[:-1]]
            sums = np.zeros(len(lanes))
            h = np.zeros((len(lanes), s.units), np.float32)
            first = 0
            while first < lengths[0]:
                running = int(np.searchsorted(-lengths, -first, side="left"))
                steps = min(max(s.window, self.waiting // running), int(lengths[0]) - first)
                place = first + np.arange(steps)[:, None]
                live = place < lengths[None, :running]
                at = begin[None, :running] + np.minimum(place, lengths[None, :running] - 1)
                x = np.take(self.inputs, tables[0][at], axis=1)
                states = np.empty((steps, running, s.units), np.float32)
                h = h[:running]
                for t in range(steps):
                    states[t] = h
                    h = gated(self.units, h, x[:, t])[0]
                states, where = states.reshape(-1, s.units), at.ravel()
                lane = np.broadcast_to(np.arange(running), live.shape).ravel()
                if not live.all():
                    use = live.ravel()
                    states, where, lane = states[use], where[use], lane[use]
                logs = self.logs(states, tables[1][where], tables[2][where])
                sums[:running] += np.bincount(lane, logs, running)
                first += steps
            out[lanes] = sums / math.log(10)
        return out


def slices(batch: pa.RecordBatch, s: Settings) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that are scored at once."""
    size = np.cumsum([0, *(len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text"))])
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(size, size[at] + s.score_bytes, side="right")) - 1
        end = max(at + 1, min(end, at + s.score_lanes))
        yield batch.slice(at, end - at)
        at = end


def _listed(ends: list[int], words: list[bytes], many: list[int], classes: list[int]) -> pa.Array:
    """Words of all texts one after the other as a list of (word, n, class) of each text."""
    columns = [pa.array(words, pa.binary()), pa.array(many, pa.int64()), pa.array(classes, pa.int32())]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["word", "n", "class"]))


SCORED = (
    "row bigint, {id}, n_tokens bigint, n_known bigint, base double, score double, "
    "rare array<struct<word:binary,n:bigint,class:int>>"
)


def score(docs: DataFrame, counts: DataFrame, v: Vocabulary, params: dict, s: Settings) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every whole text."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((v, params))
    kind = docs.schema["doc_id"].dataType.simpleString()
    floor = v.total + 0.5 * (v.distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, params = shared.value
        number = {w: k for k, w in enumerate(v.words)}
        base_log = np.log10((v.counts + 0.5) / floor)
        scorer = Scorer(params, v, s)
        for batch in batches:
            for part in slices(batch, s):
                texts, known, base, tails, rare, many, ends = [], [], [], [], [], [], [0]
                for text in part.column("text"):
                    words = words_of(text.as_py())
                    ids, missing = ids_of(words, number, v)
                    have = ids[ids >= 0]
                    texts.append(ids)
                    known.append(int((v.counts[have] > 0).sum()))
                    base.append(float(base_log[have].sum()))
                    tails.append(float(v.tail_log[have].sum()))
                    some = Counter(words[i] for i in missing)
                    rare += some
                    many += some.values()
                    ends.append(len(rare))
                scores = scorer.score(texts) + np.array(tails)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        part.column("doc_id"),
                        pa.array(list(map(len, texts)), pa.int64()),
                        pa.array(known, pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(scores, pa.float64()),
                        _listed(ends, rare, many, [v.tail_class(w) for w in rare]),
                    ],
                    names=["row", "doc_id", "n_tokens", "n_known", "base", "score", "rare"],
                )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("text")
    )
    # Stored: the row numbers, which tie rare words to their texts, are given once.
    scored = stored(rows.mapInArrow(run, SCORED.format(id=f"doc_id {kind}")), "scored")
    sums = F.array(*[F.lit(float(a + 0.5 * (d + 1))) for a, d in v.class_sums])
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    seen = lookup(rare, counts.withColumnRenamed("n", "c"), ["word"]).withColumn(
        "c", F.coalesce("c", F.lit(0))
    )
    add = seen.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(floor))).alias("more_base"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / F.get(sums, F.col("class")))).alias("more_score"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return lookup(scored.drop("rare"), add, ["row"]).select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + zero("more")).alias("n_known"),
        (F.col("base") + zero("more_base")).alias("base_score"),
        (F.col("score") + zero("more_score")).alias("score"),
    )


def score_documents(docs: DataFrame, parts: int = 5, settings: Settings | None = None) -> DataFrame:
    """Learns from the documents not held out and scores all of them."""
    s = settings or Settings()
    training = docs.where(~held_out(F.col("doc_id"), parts)).select("doc_id", "text")
    counts = stored(word_counts(training), "counts")
    v = build_vocabulary(counts, s)
    params = train(training, v, s)
    return score(docs, counts, v, params, s).select(
        "doc_id",
        held_out(F.col("doc_id"), parts).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(v.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
