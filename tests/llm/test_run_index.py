"""Repeated strings of 400 bytes against a dictionary of all of them."""

import hashlib
import random
from collections import Counter

import numpy as np

from tallyweave.llm import run_index
from tests.llm.test_operators import documents, prose

LONG = run_index.LONG


def slow(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[a : a + LONG] for r in raw for a in range(len(r) - LONG + 1))
    out = []
    for k, r in enumerate(raw):
        gone = bytearray(len(r))
        for a in range(len(r) - LONG + 1):
            if seen[r[a : a + LONG]] > 1:
                gone[a : a + LONG] = b"\1" * LONG
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def got(spark, texts, **kwargs):
    docs = documents(spark, texts).repartition(3)
    return sorted(map(tuple, run_index.report(docs).collect()))


def corpus():
    rng = random.Random(3)
    base = prose(12, 7, words=400)
    passage, other = base[0][:700], base[1][:401]
    texts = [None, "", "short", base[2][:LONG], base[2][:LONG], base[3][: LONG - 1], base[3][: LONG - 1], *base]
    texts += [base[2], base[2], base[4] + base[4][:900]]
    for k in range(30):
        own = " ".join(prose(1, 50 + k, words=40))
        texts.append(own[: 5 + 7 * k] + (passage if k % 2 else other) + own[::-1])
    for k in range(12):
        words = base[5].split()
        for _ in range(k):
            words[rng.randrange(len(words))] = f"changed{k}"
        texts.append(" ".join(words))
    texts += ["a" * 1500, "ab" * 500 + "c", "é" * 450, "x" * LONG, "y" * (LONG + 1), "\n".join([base[6][:150]] * 6)]
    return texts


def test_rows_match_all_strings_counted(spark):
    texts = corpus()
    want = slow(texts)
    assert got(spark, texts) == want
    assert sum(r[3] > 1 for r in want) > 2 and any(0 < r[2] < r[1] for r in want)


def test_no_rows_and_no_repeats(spark):
    assert got(spark, []) == []
    assert got(spark, ["only " * 20, None]) == slow(["only " * 20, None])


def test_very_long_texts_are_cut_for_hashing_only(spark):
    long = " ".join(prose(60, 9, words=4000))
    assert len(long) > run_index.STRETCH
    cut = run_index.STRETCH
    texts = [long, "start " + long[cut - 300 : cut + 500] + " end", long[-450:]]
    rows = got(spark, texts)
    assert [r[2:4] for r in rows] == [(800 + 450, 2), (800, 1), (450, 1)]
    kept = long[: cut - 300] + long[cut + 500 : -450]
    assert rows[0][4] == hashlib.sha256(kept.encode()).hexdigest()


def test_anchors_with_very_many_regions_are_named_one_by_one(spark):
    texts = corpus()
    found = run_index.find(documents(spark, texts), most=3)
    rows = {bytes(r["key"]): [tuple(x) for x in r["runs"]] for r in run_index.removed(found).collect()}
    for t, (_, _, gone, runs, _) in zip(texts, slow(texts), strict=True):
        mine = rows.get(hashlib.sha256((t or "").encode()).digest()[:16], [])
        assert (sum(b - a for a, b in mine), len(mine)) == (gone, runs)


def test_matching_statistics_of_a_run_index():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 60))).encode() for _ in range(25)] + [b"ab" * 20, b"b", b"b"]
    index = run_index.RunIndex.build(texts)
    assert index.lengths.sum() == len(index.text) and len(index.heads) < len(index.text)
    suffixes = [(k, a, t[a:]) for k, t in enumerate(texts) for a in range(len(t) + 1)]

    def common(x, y):
        return next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))

    want = [max(common(s, o) for j, b, o in suffixes if (j, b) != (k, a)) for k, a, s in suffixes]
    assert index.statistics().tolist() == want


def test_smallest_of_neighbours():
    key = np.random.default_rng(2).integers(0, 50, 1000, dtype=np.uint64)
    assert run_index.smallest(key, 7).tolist() == [min(key[i : i + 7]) for i in range(994)]
