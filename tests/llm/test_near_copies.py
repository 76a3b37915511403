"""Near copies against brute-force Jaccard of five-word shingles."""

import random

import corpus_pipeline
import numpy as np

from tallyweave.llm import near_copies, simhash
from tests.llm.test_operators import ODD, documents, prose


def slow_sets(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return sets


def slow_pairs(texts):
    sets = slow_sets(texts)
    return {
        (i, j)
        for j, b in enumerate(sets)
        for i, a in enumerate(sets[:j])
        if 5 * len(a & b) >= 4 * len(a | b)
    }


def changed(text, at):
    words = text.split()
    for k in at:
        words[k] = "changed"
    return " ".join(words)


def copies():
    """Texts with copies just within and just beyond the bound, chains and odd ones."""
    base = prose(12, 5, words=80)
    texts = ODD + base
    for k, t in enumerate(base):
        texts += [changed(t, [20]), changed(t, [20, 60]), t.upper() + "\n", t + " tail" * k]
    rng = random.Random(2)
    texts += [changed(base[0], rng.sample(range(80), 1)) for _ in range(40)]
    return texts + texts[-3:]


def test_stage_keeps_one_of_each_group_of_near_copies(spark):
    texts = copies()
    label = list(range(len(texts)))
    for a, b in sorted(slow_pairs(texts)) * 8:
        label[a] = label[b] = min(label[a], label[b])
    kept = corpus_pipeline.dedup_stage(spark, documents(spark, texts).repartition(3), "")
    assert kept.columns == documents(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))
    # Far from all of these are within 3 bits of each other.
    assert len(set(label)) < len(texts) // 4
    assert corpus_pipeline.dedup_stage(spark, documents(spark, []), "").count() == 0


def test_links_are_near_copies_and_join_all_of_them(spark):
    texts = sorted({t for t in copies() if t and t.strip()})
    rows = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    found = {tuple(sorted(r)) for r in near_copies.links(rows).collect()}
    pairs = slow_pairs(texts)
    assert found <= pairs  # precision
    label = np.arange(len(texts))
    for _ in range(8):
        for a, b in found:
            label[a] = label[b] = min(label[a], label[b])
    assert all(label[a] == label[b] for a, b in pairs)  # recall


def test_prefixes_of_near_copies_meet():
    rng = np.random.default_rng(1)
    common = np.unique(rng.integers(0, 2**64, 50, dtype=np.uint64))
    place = rng.permutation(len(common))
    for n in (1, 2, 4, 5, 6, 9, 10, 33, 250):
        for _ in range(20):
            a = np.unique(np.r_[rng.integers(0, 2**64, n, dtype=np.uint64), rng.choice(common, min(n, 20))])
            fewest = -(-4 * len(a) // 5)
            b = np.sort(rng.choice(a, fewest, replace=False))
            assert near_copies.alike(a, b)
            assert len(np.intersect1d(near_copies.prefix(a, common, place), near_copies.prefix(b, common, place)))
            if fewest > 1:
                assert not near_copies.alike(a, b[1:])
            differ = np.bitwise_count((near_copies.parities(a) ^ near_copies.parities(b)).view(np.uint64)).sum()
            assert differ <= len(a) - len(b)


def test_simhash_links_come_first(spark, monkeypatch):
    """The stage asks the SimHash operator, whose links join all texts within 3 bits, and checks each link."""
    texts = sorted({t for t in copies() if t and t.strip()})
    rows = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    found = {tuple(r) for r in near_copies.sketched(rows).collect()}
    close = {(i, j) for j, q in enumerate(prints) for i, p in enumerate(prints[:j]) if (p ^ q).bit_count() <= 3}

    def joined(pairs):
        label = list(range(len(texts)))
        for a, b in sorted(pairs) * 8:
            label[a] = label[b] = min(label[a], label[b])
        return label

    assert found and joined(found) == joined(close)

    asked = []
    linked = simhash.links
    monkeypatch.setattr(simhash, "links", lambda *given: asked.append(given) or linked(*given))
    assert corpus_pipeline.dedup_stage(spark, documents(spark, texts), "").count() < len(texts)
    assert len(asked) == 1


def test_only_possible_pairs_are_confirmed(spark, monkeypatch):
    """SimHash links texts that are far from alike; sizes and parities rule them out before whole texts are sent."""
    texts = sorted({t for t in copies() if t and t.strip()})
    rows = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    asked, confirmed = [], near_copies.confirmed
    monkeypatch.setattr(near_copies, "sketched", lambda _: rows.alias("x").crossJoin(rows.alias("y")).selectExpr("x.node AS a", "y.node AS b").where("a < b"))
    monkeypatch.setattr(near_copies, "confirmed", lambda pairs, *rest: asked.append(pairs) or confirmed(pairs, *rest))
    found = {tuple(sorted(r)) for r in near_copies.links(rows).collect()}
    pairs = slow_pairs(texts)
    assert found == pairs
    sizes = [len(s) for s in slow_sets(texts)]
    tried = {tuple(sorted(r)) for part in asked for r in part.collect()}
    assert pairs <= tried and len(tried) < len(texts) ** 2 // 8
    assert all(5 * min(sizes[a], sizes[b]) >= 4 * max(sizes[a], sizes[b]) for a, b in tried)


def test_finer_parities_bound_the_difference(spark):
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 2**64, 30_000, dtype=np.uint64))
    for n in (1, 255, 256, 257, 300, 2000, 9000):
        a = np.sort(rng.choice(pool, n, replace=False))
        b = np.sort(rng.choice(a, -(-4 * n // 5), replace=False))
        far = np.sort(rng.choice(pool, n, replace=False))
        rows = [(k, len(x), near_copies.parities(x, near_copies.fine_longs(len(x))).tolist()) for k, x in enumerate((a, b, far))]
        known = spark.createDataFrame(rows, "node bigint, n int, fine array<bigint>")
        one, other = known.where("node = 0"), known.selectExpr("node AS b", "n AS other_n", "fine AS other_fine")
        kept = {r["b"] for r in one.crossJoin(other).where(near_copies._finely_allowed("other_")).collect()}
        assert kept >= {0, 1}
        assert 2 not in kept or n == 1


def test_meetings_are_the_shared_postings_whatever_the_rounds(spark):
    texts = sorted({t for t in copies() if t and t.strip()})
    known = near_copies.sketches(spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")).persist()
    rows = [tuple(r) for r in near_copies.postings(known).collect()]
    nodes = {}
    for token, node, *_ in rows:
        nodes.setdefault(token, set()).add(node)
    shared = sorted(r for r in rows if len(nodes[r[0]]) > 1)
    assert shared
    for rounds in (1, 3):
        assert sorted(tuple(r) for r in near_copies.meetings(known, rounds).collect()) == shared
    known.unpersist()


def test_a_text_meets_its_copies_block_by_block(spark):
    texts = sorted({t for t in copies() if t and t.strip()})
    rows = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    every = [(a, b) for b in range(len(texts)) for a in range(b)]
    pairs = spark.createDataFrame(every, "a bigint, b bigint")
    for block in (1, 7, 256):
        assert {tuple(r) for r in near_copies.confirmed(pairs, rows, block=block).collect()} == slow_pairs(texts)
