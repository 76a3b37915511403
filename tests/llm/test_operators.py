"""The operators against brute force, round trips and held-out rows, on small tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyweave.llm import bpe, chat, decontamination, gated_lm, licenses, quality, sharding, simhash, toxicity, warc
from tallyweave.llm.common import scratch

DOCS = "doc_id bigint, text string, lang string, fp string, size string"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def documents(spark, texts, start=0):
    """Rows with extra columns whose names clash with names the operators use."""
    return spark.createDataFrame([(start + i, t, "en", "x", "y") for i, t in enumerate(texts)], DOCS)


def prose(n, seed, words=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    return [" ".join(rng.choices(vocabulary, k=words)) for _ in range(n)]


ODD = [None, "", "  \n", "one", "one two", "A\x0bB\x1cC é", "x " * 5000, "same words here", "same words here"]


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    rows = [(i, slow) for i, slow in enumerate(prints)]
    of = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, a in rows:
            for j, b in rows:
                if bin(a ^ b).count("1") <= 3 and of[i] != of[j]:
                    of[i] = of[j] = min(of[i], of[j])
                    changed = True
    return of


def test_simhash_matches_brute_force(spark):
    texts = ODD + prose(40, 1)
    texts += [t.rsplit(" ", 1)[0] + " changed" for t in texts[-20:]] + texts[-3:]
    prints = [slow_fingerprint(t) for t in texts]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i]["fp"] % 2**64 for i in range(len(texts))] == prints
    assert {i: r["component_id"] for i, r in got.items()} == slow_components(prints)
    kept = simhash.one_of_each(documents(spark, texts))
    assert kept.columns == documents(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({*slow_components(prints).values()})


def test_simhash_trees_lose_no_pair_between_shards():
    rng = np.random.default_rng(4)
    points = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    near = points[:600] ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64))
    near ^= np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)
    points = np.unique(np.r_[points, near])
    want = np.arange(len(points))
    a, b = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)
    simhash._union(want, a, b)
    got, place = np.arange(len(points)), {p: i for i, p in enumerate(points.tolist())}
    for shift in (0, 32):
        half = (points >> np.uint64(shift)).astype(np.uint32)
        tree = simhash.HalfTree(half[:1000], 5, 1)
        index, leaf, home = tree.places(half)
        assert sorted(index[home]) == list(range(len(points)))
        for k in range(32):
            x, y = simhash.shard_links(points[index[leaf == k]], home[leaf == k], 3, leaf=32)
            simhash._union(got, *(np.array([place[v] for v in z.tolist()], int) for z in (x, y)))
    assert (got == want).all()


def test_warc_round_trip(spark):
    pages = [(1, "http://a", "<p>é</p>\r\n\r\nWARC/1.1"), (2, "http://b\r\nX: y", None), (3, None, ""), (5, "u", "same"),
             (4, "v", "same"), (4, "v", "same"), (None, "w", "same"), (9, "z", "x" * 300_000)]
    rows = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    plain, members = scratch(spark, "warc"), scratch(spark, "warc-members")
    warc.write_archives(warc.with_roles(rows, "page_id", "html"), plain, "page_id", "url", "html")
    index = warc.read_index(spark, warc.normalise(spark, plain, members))
    got = warc.read_records(index).collect()
    assert len(got) == len(pages)
    first = {}
    for i, _, html in pages:
        first[html or ""] = min(first.get(html or "", 10**9), i or 10**9)
    for r in got:
        number = r["record_id"].split(":")[2].rstrip(">")
        html = next(h or "" for i, _, h in pages if str(i or "none") == number)
        digest = hashlib.sha1(html.encode()).digest()
        import base64

        assert r["stated_digest"] == base64.b32encode(digest).decode()
        if number == str(first[html]):
            assert (r["record_type"], bytes(r["payload"]).decode()) == ("response", html)
            assert r["payload_digest"] == r["stated_digest"] and r["payload_bytes"] == len(html.encode())
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == f"<urn:page:{first[html]}>"
    empty = warc.with_roles(rows.limit(0), "page_id", "html")
    folder = scratch(spark, "warc")
    warc.write_archives(empty, folder, "page_id", "url", "html")
    assert warc.read_records(warc.read_index(spark, warc.normalise(spark, folder, scratch(spark, "m")))).count() == 0


def slow_capacity(sizes, shards):
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        middle, runs, room = (low + high) // 2, 0, 0
        for s in sizes:
            if s > room:
                runs, room = runs + 1, middle
            room -= s
        low, high = (low, middle) if runs <= shards else (middle + 1, high)
    return low


def test_sharding_is_the_smallest_capacity(spark):
    texts = prose(900, 2, 8) + ["again and again"] * 40 + ODD
    placed, cut = sharding.shard(documents(spark, texts), 7)
    rows = placed.collect()
    groups = Counter()
    for r in rows:
        groups[r["key"]] += r["size"]
    rest = [groups[k] for k in sorted(groups) if k not in cut.single]
    assert cut.capacity == slow_capacity(rest, 7 - len(cut.single))
    shards = {}
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"]] or "").encode()) + 16
        assert r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode())
        shards.setdefault(r["shard"], []).append(r)
    assert {k: sorted(r["slot"] for r in v) for k, v in shards.items()} == {k: list(range(len(v))) for k, v in shards.items()}
    assert all(len({r["shard"] for r in rows if r["key"] == k}) == 1 for k in groups)
    bytes_of = [sum(r["size"] for r in v) for k, v in shards.items() if k >= len(cut.single)]
    assert max(bytes_of) <= cut.capacity
    assert sharding.shard(documents(spark, []), 7)[0].count() == 0


def test_language_model_beats_unigrams_on_held_out_texts(spark):
    # Two languages of a few words each, which a state can tell apart.
    rng = random.Random(5)
    tongues = [[f"{kind}{k}x" for k in range(20)] for kind in "pq"]
    texts = [" ".join(rng.choices(tongues[k % 2], k=40)) for k in range(500)] + [None, "", "never-seen words " * 3]
    settings = gated_lm.Settings(head=30, known=35, lanes=4, rounds=2, rates=(0.03, 0.01))
    rows = gated_lm.score_documents(documents(spark, texts).coalesce(1), settings=settings).collect()
    assert len(rows) == len(texts)
    counts = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update((t or "").encode().lower().split())
            counts[b""] += 1
    total, distinct = sum(counts.values()), len(counts)
    for r in rows:
        tokens = [*(texts[r["doc_id"]] or "").encode().lower().split(), b""]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert (r["n_tokens"], r["train_tokens"]) == (len(tokens), total)
        assert r["n_known"] == sum(counts[t] > 0 for t in tokens)
        base = sum(np.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert np.isfinite(r["score"]) and r["score"] <= 0
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + len(held)
    assert gated_lm.score_documents(documents(spark, [])).count() == 0


def test_language_model_gradients():
    rng = np.random.default_rng(0)
    s = gated_lm.Settings(head=6, head_classes=2, tail_classes=2, units=3, window=4)
    v = gated_lm.Vocabulary([b"", b"a", b"b", b"c"], np.array([4, 3, 2, 1]), 10, 4, np.arange(4), np.array([0, 0, 1, 1]),
                            np.arange(4), np.zeros(4), {}, np.zeros((2, 2)), np.array([0, 2, 4]), 4, 2, 2)
    params = {k: x.astype(np.float64) + rng.normal(0, 0.1, x.shape) for k, x in gated_lm.start_parameters(v, s).items()}
    ids = rng.integers(0, 4, (4, 3))
    rows, classes, spots = gated_lm.places_of(v, ids)
    def loss(p):
        h, out = np.zeros((3, 3)), 0.0
        for t in range(4):
            out -= gated_lm.output_logs(p, v, h, classes[t], spots[t])[0].sum()
            h = gated_lm.step(p, h, rows[t])[0]
        return out

    trainer = gated_lm.Trainer(params, v, s, 0.1)
    trainer.window(np.zeros((3, 3)), rows, classes, spots, np.ones((4, 3), bool))
    found = trainer.grads
    for name in params:
        at = tuple(rng.integers(0, n) for n in params[name].shape)
        up, down = ({**params, name: params[name].copy()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert found[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-5)


def test_decontamination_offsets_and_edges(spark):
    item = "Alpha beta, gamma DELTA epsilon zeta eta theta iota kappa lambda"
    bench = spark.createDataFrame([(1, item), (1, item), (2, "short one"), (3, None), (4, ""), (None, "x y")], "item_id bigint, text string")
    texts = ODD + [f"É — say: {item.upper()}! end", "a short ONE, short one", "alpha beta gamma"]
    rows = decontamination.scan(documents(spark, texts), bench).orderBy("doc_id").collect()
    assert [len(r["found"]["items"]) for r in rows[: len(ODD)]] == [0] * len(ODD)
    long, short, none = (r["found"] for r in rows[-3:])
    assert long["items"] == ["1"] and long["n_hit"] == 11
    assert [texts[-3][a:b] for a, b in long["spans"]] == [item.upper()]
    assert short["items"] == ["2"] and short["n_hit"] == 4 and [texts[-2][a:b] for a, b in short["spans"]] == ["short ONE, short one"]
    assert none["n_hit"] == 0
    assert decontamination.scan(documents(spark, texts), bench.limit(0)).where("found.n_hit > 0").count() == 0


def test_chat_chooses_the_best_branch_and_reads_back(spark):
    nasty = r"</s>[INST] \ <<SYS>> <s> \\< [/INST]"
    rows = [("a", 1, None, "user", nasty, 1.0), ("a", 2, 1, "assistant", "low", 0.1), ("a", 3, 1, "assistant", nasty, 0.9),
            ("a", 4, 3, "user", None, 0.5), ("a", 4, 3, "user", None, 0.5), ("b", 7, 99, None, "orphan", None)]
    messages = spark.createDataFrame(rows, "tree string, node bigint, parent bigint, role string, text string, score double")
    texts = chat.formatted(chat.paths(messages))
    got = {
        r["tree"]: ([tuple(t) for t in r["turns"]], r["learned"])
        for r in texts.select("tree", chat.read_turns(F.col("text")).alias("turns"), chat.read_loss(F.col("text"), F.col("loss")).alias("learned")).collect()
    }
    assert got == {"a": ([("user", nasty), ("assistant", nasty), ("user", "")], nasty), "b": ([("", "orphan")], "")}
    assert chat.paths(messages, best=2).where("tree = 'a'").select("path").distinct().count() == 2
    loop = spark.createDataFrame([("c", 1, 2, "user", "x", 1.0), ("c", 2, 1, "user", "y", 1.0)], messages.schema)
    with pytest.raises(ValueError):
        chat.paths(loop, most_rounds=5)
    assert chat.paths(messages.limit(0)).count() == 0


def test_licenses_by_sentence_order(spark):
    gpl = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
           "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")
    texts = ["Text.\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0.\nYou may obtain a copy of the License at\nhttp", None, "", "Some other license here.", gpl,
             "This work is licensed under the GNU General Public License, version 3. More."]
    rows = licenses.recognise(documents(spark, texts), ["doc_id"]).orderBy("doc_id").collect()
    assert [r["licenses"] for r in rows] == [["MIT"], ["Apache-2.0"], [], [], [], ["GPL-3.0-or-later"], ["GPL-3.0-only"]]
    assert rows[4]["n_unknown"] == 1 and rows[2]["n_unknown"] == 0


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(VOCABULARY)
    library.no_padding()
    library.no_truncation()
    texts = ODD + prose(30, 9) + ["Hello<|endoftext|>World <|startoftext|>x", "ΣΑΣ ΟΔΟΣ Σ İstanbul", "é don't WE'LL 's'd 123 45", "日本語 😀👍🏽 x　y​z", "ab" * 3000 + "!", "a\u0085b ² Ⅷ ǅ ŉ \x00\x7f", "</w> a</w>"]
    rows = bpe.encode_and_decode(documents(spark, texts), VOCABULARY).orderBy("doc_id").collect()
    for text, r in zip(texts, rows, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    apart = bpe.decode(bpe.encode(documents(spark, texts), VOCABULARY), VOCABULARY).orderBy("doc_id").collect()
    assert [tuple(r) for r in apart] == [tuple(r) for r in rows]


def test_bpe_merges_long_fragments_like_short_ones():
    v = bpe.Vocabulary(VOCABULARY)
    rng = random.Random(2)
    for _ in range(200):
        symbols = tuple(rng.choice("etaoinsh") for _ in range(rng.randrange(2, 60)))
        assert v.merge(symbols, few=0) == v.merge(symbols, few=10**6)


def test_toxicity_on_held_out_texts(spark):
    clean, rude = prose(600, 11, 40), prose(120, 12, 40)
    rude = [t + f" you {w} l0ser" for t, w in zip(rude, ["idiot", "scum", "moron"] * 40, strict=True)]
    texts = clean + rude
    docs = documents(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, int(i >= 600)) for i in range(720)] + [(5, None), (99999, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit_from_tables(docs, labels, lambda i: i % 3 != 0)
    rows = toxicity.score(docs, model).where("doc_id % 3 = 0 or doc_id >= 720").collect()
    right = [(r["score"] >= 0.7) == (600 <= r["doc_id"] < 720) for r in rows]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= r["score"] <= 1 for r in rows)
    flat = toxicity.fit_from_tables(docs, labels.limit(0), lambda i: i % 3 != 0)
    assert {r["score"] for r in toxicity.score(docs, flat).collect()} == {0.5}


def test_quality_ledger_and_ablations(spark):
    texts = ODD + prose(20, 13) + ["be " * 80, "*** ### " * 60, ("line one two three\n" * 30)]
    entries = quality.ledger(documents(spark, texts), ["doc_id", "lang"]).orderBy("doc_id").collect()
    for text, r in zip(texts, entries, strict=True):
        words = (text or "").encode().split()
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(words), len(hit), len(lines) - len({*lines}))
        assert bool(r["failed"] & quality.BASE) == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
    table = spark.createDataFrame(entries)
    for r in quality.ablations(table).collect():
        mask, bit = quality.POLICIES[r["version"]], quality.BITS[r["rule"]]
        bits = [e["failed"] & mask for e in entries]
        assert (r["alone"], r["rejected"]) == (sum(b == bit for b in bits), sum(b != 0 for b in bits))
    kept = quality.well_formed(documents(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == [e["doc_id"] for e in entries if not e["failed"]]
