"""Merkle manifests against a tree hashed level by level with hashlib."""

import hashlib
import zlib

import numpy as np

from tallyweave.llm import merkle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, tree int, _guard int"


def rows(spark, some):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", 1, 2) for i, t, s in some], DOCS)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def slow_leaf(i, t, s, bare=False):
    n = None if t is None else len(t)
    return sha(*map(framed, (i, s, "en", n, t.replace("\n", "") if bare and t is not None else t)))


def slow_tree(digests):
    """Root, and for each leaf its siblings level by level with the number of those to the left."""
    paths, place = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[k : k + 3] for k in range(0, len(digests), 3)]
        for path, k in zip(paths, place, strict=True):
            run = runs[k // 3]
            path.append((run[: k % 3], run[k % 3 + 1 :]))
        place = [k // 3 for k in place]
        digests = [sha(*run) for run in runs]
    return digests[0], paths


def slow(some):
    key = lambda s: (s is not None, (s or "").encode())
    sources, out = sorted({s for _, _, s in some}, key=key), []
    trees = {}
    for s in sources:
        own = sorted((r for r in some if r[2] == s), key=lambda r: (r[0] is not None, r[0] or 0, slow_leaf(*r)))
        trees[s] = own, *slow_tree([slow_leaf(*r) for r in own])
    root, above = slow_tree([trees[s][1] for s in sources])
    for s, up in zip(sources, above, strict=True):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = slow_leaf(*r, bare=even)
            for left, right in path + up:
                folded = sha(*left, folded, *right)
            proof = sha(*(d for left, right in path + up for d in left + right))
            out.append((r[0], slow_leaf(*r), subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def got(spark, some):
    df = merkle.verify(rows(spark, some))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, df.collect()), key=str)


def test_compression_of_many_inputs_is_sha256():
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 256, (7, 32), dtype=np.uint8)
    state = np.repeat(merkle.START[:, None], 7, axis=1)
    for blocks in range(1, 4):
        state = merkle.compress(state, merkle.hex_block(digests))
        want = [hashlib.sha256(d.tobytes().hex().encode() * blocks).digest() for d in digests]
        assert [d.tobytes() for d in merkle.close(state, np.full(7, blocks))] == want


def test_small_trees_with_odd_rows(spark):
    some = [(i, f"text {i}\nand more\n" * (i % 4), f"src{i % 5}") for i in range(40)]
    some += [(100, None, "src1"), (101, "", None), (102, "\n", None), (None, "a\nb", "src2"), (None, None, None)]
    some += [(103, "alone\n", "one"), (5, "text 5\nand more\n", "src0"), (7, "other", "src2"), (7, "other", "src2"), (104, "é\n" * 30_000, "ü")]
    assert got(spark, some) == slow(some)
    assert any(not r[-1] for r in slow(some)) and any(r[-1] for r in slow(some))


def test_trees_of_several_rounds_and_a_hot_source(spark):
    some = [(i, f"{i}\n", "hot" if i % 3 else f"s{i % 7}") for i in range(7000)]
    assert got(spark, some) == slow(some)


def test_one_row_and_none(spark):
    assert got(spark, [(2, "x\n", "a")]) == slow([(2, "x\n", "a")])
    assert got(spark, []) == []


def test_kept_states_resume_each_slot(spark):
    nodes = merkle.build(merkle.leaves(rows(spark, [(i, "x", "a") for i in range(10)])), ["doc_id"]).rounds[0]
    for r in nodes.where("level >= 0").collect():
        children = np.frombuffer(bytes(r["children"]), np.uint8).reshape(-1, 32)
        states = np.frombuffer(bytes(r["states"]), np.uint8).reshape(-1, 32)
        for k in range(len(children)):
            right = np.zeros((1, 2, 32), np.uint8)
            right[0, : len(children) - k - 1] = children[k + 1 :]
            again = merkle.resume(states[k : k + 1], np.array([k]), children[k : k + 1], right, np.array([len(children) - k - 1]))
            assert again.tobytes() == bytes(r["digest"])
