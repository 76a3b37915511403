"""Product codes against plain rounds in Python integers."""

import hashlib
import math
import random

import numpy as np

from tallyweave.llm import product_codes
from tallyweave.llm.product_codes import Codebooks, assign

VECTORS = "vec_id bigint, embedding array<float>, label int, part int"


def slow(rows):
    """rows: (vec_id, vector, label)."""
    fine = [r for r in rows if r[1] is not None and r[1] and len(r[1]) % 8 == 0 and all(x is not None and math.isfinite(x) for x in r[1])]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fine = [r for r in fine if len(r[1]) == len(fine[0][1])]
    if not fine:
        return []
    w = len(fine[0][1]) // 8
    cut = [[[math.floor(4096 * float(np.float32(x))) for x in v[p * w : (p + 1) * w]] for p in range(8)] for _, v, _ in fine]
    books = [[c[p] for c in cut[:16]] for p in range(8)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for turn in range(7):
        found = [[nearest(c[p], books[p]) for p in range(8)] for c in cut]
        if turn == 6:
            break
        for p in range(8):
            for k in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(xs) // len(own) for xs in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(fine, error, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted(
        ((r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]], digest) for r, f, e in zip(fine, found, error, strict=True)),
        key=str,
    )


def got(spark, rows):
    table = spark.createDataFrame([(*r, 3) for r in rows], VECTORS).repartition(3)
    return sorted(map(tuple, product_codes.report(table).collect()), key=str)


def vectors(n, seed, width=24):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(9)]
    return [[m + rng.gauss(0, 0.2) for m in rng.choice(middles)] for _ in range(n)]


def test_rows_match_plain_rounds(spark):
    rows = [(i, v, i % 4 if i % 5 else None) for i, v in enumerate(vectors(300, 1))]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [1.0] * 23 + [float("inf")], [1.0] * 23 + [None], [1.0] * 16, [1.0] * 9]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)]
    rows += [rows[3], rows[3], (7, rows[3][1], 9), (None, rows[5][1], None), (-4, None, 2)]
    rows += [(2000 + i, rows[9][1], 3) for i in range(200)]
    assert got(spark, rows) == slow(rows)


def test_large_components_are_exact(spark):
    rows = [(i, [x * 1e5 for x in v], None) for i, v in enumerate(vectors(60, 2, 8))]
    assert got(spark, rows) == slow(rows)


def test_few_rows_and_none(spark):
    rows = [(i, v, 1) for i, v in enumerate(vectors(5, 3))]
    assert got(spark, rows) == slow(rows)
    assert got(spark, []) == [] and got(spark, [(1, None, 1)]) == []


def test_net_moves_prune_and_lose_nothing(spark):
    values = product_codes.scaled(np.array(vectors(4000, 4, 32))).reshape(-1, 8, 4)
    book = values[:16].transpose(1, 0, 2).copy()
    books, before, measured = Codebooks([book]), None, []
    for _ in range(6):
        before, distance, n = assign(values, books, before)
        measured.append(n)
        full = product_codes.squared(values[:, :, None, :] - books.history[-1][None])
        assert (full.argmin(axis=2) == before.entry).all() and (full.min(axis=2) == distance).all()
        # Every bound holds in the round of its stamp.
        own = np.stack([product_codes.squared(values[:, :, None, :] - b[None]) for b in books.history])
        assert (before.low <= np.sqrt(np.take_along_axis(own, before.stamp[None].astype(int), 0)[0])).all()
        after = books.history[-1].copy()
        for p in range(8):
            for j in range(16):
                own = values[before.entry[:, p] == j, p]
                if len(own):
                    after[p, j] = own.sum(axis=0) // len(own)
        books = Codebooks([*books.history, after])
    # The first pass measures all entries, later ones far fewer.
    assert measured[0] >= values.shape[0] * 8 * 16 and measured[-1] < measured[0] / 2
    # What is taken off a bound is never more than the moves added up.
    net, steps = books.moved(6), [np.sqrt(product_codes.squared(b - a)) for a, b in zip(books.history, books.history[1:], strict=False)]
    added = np.stack([sum(steps[t:], np.zeros((8, 16))) for t in range(7)])
    assert (net <= added + 1e-3).all() and (net < added - 1).any()
