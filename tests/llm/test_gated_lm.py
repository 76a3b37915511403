"""The language model learns from every word of every training text, and scores whole texts."""

import math
import random
import zlib

import numpy as np

from tallyweave.llm import gated_lm
from tests.llm.test_operators import documents, prose


def test_gates_see_all_training_words(spark, monkeypatch):
    texts = [*prose(20, 3, words=30), prose(1, 4, words=3000)[0], prose(1, 5, words=700)[0], "", None]
    texts = [t for t in texts for _ in range(2)]
    learned, averaged = [], gated_lm._averaged

    def counted(copies):
        out = averaged(copies)
        learned.append(int(out["tokens"].sum()))
        return out

    monkeypatch.setattr(gated_lm, "_averaged", counted)
    settings = gated_lm.Settings(head=30, known=35, lanes=4)
    gated_lm.score_documents(documents(spark, texts).coalesce(1), settings=settings).collect()
    training = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    assert sum(learned) == sum(len((t or "").split()) + 1 for t in training)


def test_lanes_carry_the_state_through_texts_and_start_anew():
    s = gated_lm.Settings(window=4, lanes=2, stretch=50)
    texts = [np.arange(1, 12), np.array([0]), np.arange(20, 29), np.array([30, 31])]
    seen, done = {}, []

    class Kept(gated_lm.Trainer):
        def window(self, h, rows, classes, spots, live):
            for k in range(len(h)):
                words = rows[live[:, k], k].tolist()
                # Each lane's state holds the number of words it has passed.
                seen.setdefault(int(h[k, 0]), []).append(words)
                done.extend(words)
            return h + live.sum(0)[:, None]

    v = gated_lm.Vocabulary([], np.arange(1), 10, 4, np.arange(40), np.zeros(40, int), np.arange(40), np.zeros(4), {},
                            np.zeros((2, 2)), np.array([0, 40]), 40, 1, 2)
    trainer = Kept({}, v, s, 0.1)
    trainer.learn(iter(texts))
    assert sorted(done) == sorted(np.concatenate(texts).tolist()) and trainer.tokens == len(done)
    assert sorted(seen[0]) == [[0], [1, 2, 3, 4], [20, 21, 22, 23], [30, 31]]
    assert sorted(seen[4]) == [[5, 6, 7, 8], [24, 25, 26, 27]] and sorted(seen[8]) == [[9, 10, 11], [28]]


def small_vocabulary():
    """Ten words in the head (classes of three, three and four), some tail words in two classes."""
    counts = np.array([9, 8, 7, 6, 5, 4, 3, 2, 2, 1, 1, 1, 1])
    return gated_lm.Vocabulary(
        [b""] + [b"w%d" % k for k in range(12)], counts, int(counts.sum()), 13, np.r_[np.arange(10), 10, 11, 11],
        np.r_[0, 0, 0, 1, 1, 1, 2, 2, 2, 2, 3, 4, 4], np.r_[np.arange(10), -1, -1, -1], np.zeros(13), {}, np.ones((2, 2)),
        np.array([0, 3, 6, 10]), 10, 3, 2,
    )


def slow_score(p, v, ids):
    """One token after the other, probability by probability."""
    def logistic(x):
        return 1 / (1 + math.exp(-x))

    units, total = len(p["units"]), 0.0
    h = [0.0] * units
    for i in ids.tolist():
        row, kind, spot = (int(x) for x in gated_lm.places_of(v, np.array(i)))
        out = [sum(h[k] * p["class_w"][k, c] for k in range(units)) + p["class_b"][c] for c in range(p["class_w"].shape[1])]
        total += out[kind] - math.log(sum(map(math.exp, out)))
        if spot >= 0:
            a, b = v.bounds[kind], v.bounds[kind + 1]
            out = {w: sum(h[k] * p["word_w"][k, w] for k in range(units)) + p["word_b"][w] for w in range(a, b)}
            total += out[spot] - math.log(sum(map(math.exp, out.values())))
        u = [sum(h[k] * p["units"][k, j] for k in range(units)) for j in range(3 * units)]
        x = p["inputs"][row]
        r = [logistic(x[j] + u[j]) for j in range(units)]
        z = [logistic(x[units + j] + u[units + j]) for j in range(units)]
        n = [math.tanh(x[2 * units + j] + r[j] * u[2 * units + j]) for j in range(units)]
        h = [n[j] + z[j] * (h[j] - n[j]) for j in range(units)]
    return total / math.log(10)


def test_scores_are_those_of_one_token_after_the_other():
    rng, v = np.random.default_rng(3), small_vocabulary()
    s = gated_lm.Settings(units=4, window=5, score_lanes=6)
    p = {k: x + rng.normal(0, 0.5, x.shape).astype(np.float32) for k, x in gated_lm.start_parameters(v, s).items()}
    texts = [np.r_[rng.integers(-2, 13, n), 0] for n in (0, 1, 4, 5, 6, 37, 2, 90, 11, 3)]
    want = [slow_score(p, v, t) for t in texts]
    assert np.allclose(gated_lm.Scorer(p, v, s).score(texts), want, rtol=1e-4)
    # Outputs so large that exp() needs the largest taken off first.
    p["word_w"] *= 60
    assert not gated_lm.safe_output(p)
    assert np.allclose(gated_lm.Scorer(p, v, s).score(texts), [slow_score(p, v, t) for t in texts], rtol=1e-3)


def test_one_very_long_text_among_short_ones_does_not_spoil_the_model(spark):
    rng = random.Random(8)
    tongues = [[f"{kind}{k}x" for k in range(60)] for kind in "pqr"]
    texts = [" ".join(rng.choices(tongues[k % 3], k=30)) for k in range(900)]
    texts[400] = " ".join(rng.choices([f"z{k}" for k in range(500)], k=20_000))
    assert zlib.crc32(b"400") % 5 != 1
    settings = gated_lm.Settings(head=150, known=400, rates=(0.03, 0.01))
    for parts in (1, 4):
        rows = gated_lm.score_documents(documents(spark, texts).repartition(parts), settings=settings).collect()
        held = [r for r in rows if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + len(held)


def test_steps_wait_for_a_fixed_number_of_tokens():
    v = small_vocabulary()
    s = gated_lm.Settings(units=4, window=4, lanes=2, tokens_a_step=10)
    trainer = gated_lm.Trainer(gated_lm.start_parameters(v, s), v, s, 0.1)
    trainer.learn(iter([np.r_[np.ones(7, int), 0], np.array([2, 0]), np.r_[np.ones(12, int), 0]]))
    # Windows of 6, 8, 4, 4 and 1 tokens, the second lane taking the third text: a step after two of them and one at the end.
    assert trainer.tokens == 23 and trainer.t == 2 and trainer.waiting == 0


def test_gradients_of_idle_lanes_and_of_large_outputs_are_those_of_the_score():
    rng, v = np.random.default_rng(6), small_vocabulary()
    s = gated_lm.Settings(units=3, window=5)
    live = np.arange(5)[:, None] < np.array([5, 2, 4])
    places = gated_lm.places_of(v, rng.integers(-2, 13, (5, 3)))
    start = gated_lm.start_parameters(v, s)
    for large in (1, 60):
        params = {k: x.astype(np.float64) + rng.normal(0, 0.5, x.shape) for k, x in start.items()}
        params["word_w"] *= large
        assert gated_lm.safe_output(params) == (large == 1)

        def loss(p):
            h, out = np.full((3, 3), 0.2), 0.0
            for rows, classes, spots, on in zip(*places, live, strict=True):
                out -= gated_lm.output_logs(p, v, h, classes, spots)[0][on].sum()
                h = gated_lm.step(p, h, rows)[0]
            return out

        trainer = gated_lm.Trainer(params, v, s, 0.1)
        trainer.window(np.full((3, 3), 0.2), *places, live)
        for name, found in trainer.grads.items():
            for at in np.ndindex(found.shape):
                up, down = ({**params, name: params[name].copy()} for _ in range(2))
                up[name][at] += 1e-5
                down[name][at] -= 1e-5
                assert abs(found[at] - (loss(up) - loss(down)) / 2e-5) < 1e-5 * large


def test_gates_go_through_arrays_without_gaps(monkeypatch):
    """Rows of three gates side by side, gone through one gate at a time, took most of the time."""
    v, s, seen, gated = small_vocabulary(), gated_lm.Settings(units=4, window=4), [], gated_lm.gated

    def watched(units, h, x):
        seen.extend(a.flags.c_contiguous for a in (h, *units, *x))
        return gated(units, h, x)

    monkeypatch.setattr(gated_lm, "gated", watched)
    p, texts = gated_lm.start_parameters(v, s), [np.r_[np.ones(k, int), 0] for k in (3, 9, 20)]
    gated_lm.Trainer(p, v, s, 0.1).learn(iter(texts))
    gated_lm.Scorer(p, v, s).score(texts)
    assert seen and all(seen)


def test_the_outputs_of_a_long_text_are_worked_out_many_words_at_a_time(monkeypatch):
    v, s, calls, logs = small_vocabulary(), gated_lm.Settings(units=4), [], gated_lm.Scorer.logs

    def counted(self, states, classes, spots):
        calls.append(len(states))
        return logs(self, states, classes, spots)

    monkeypatch.setattr(gated_lm.Scorer, "logs", counted)
    text = np.r_[np.random.default_rng(1).integers(-2, 13, 20_000), 0]
    p = gated_lm.start_parameters(v, s)
    assert np.allclose(gated_lm.Scorer(p, v, s).score([text, text[-30:]]), [slow_score(p, v, text), slow_score(p, v, text[-30:])], rtol=1e-4)
    assert sum(calls) == len(text) + 30 and len(calls) < 10
