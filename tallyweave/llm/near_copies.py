"""Near copies by the Jaccard similarity of word shingles, found exactly.

Two texts are near copies if their sets of shingles (``shingle`` words each)
have a similarity of ``LEAST`` (0.8) or more.  Put all shingles into one order:
two such sets share one of the first n - ceil(0.8 n) + 1 shingles of either, n
being its size (prefix filtering).  So texts are posted under the shingles of
their prefix, texts that meet under one are candidates, and each candidate pair
is confirmed on both whole texts before it becomes a link.  No pair is missed
and none is linked unchecked; connected components then run as Spark jobs.

The order puts shingles that are common in a bounded sample of the texts last,
the others by hash.  That decides how many candidates there are, never what is
found.  A candidate is dropped unchecked only if bounds rule it out: the sizes,
the places in the order, and the parities of both sets over 512 buckets, which
differ in at most as many buckets as the sets differ in shingles.  Candidates come in two rounds: first the
texts that the SimHash operator links (``simhash``: 3 or fewer differing bits of
fingerprints of three-word shingles), and each text with the smallest text it
meets under a shingle, which joins most of a family of copies with one pair for
each; then, under each shingle, the pairs whose texts are not joined yet.

Defined results: words are those of ``simhash``, shingles are compared by their
64-bit hashes; texts of fewer words than a shingle are one shingle; texts
without words, NULL among them, are copies of each other and of nothing else;
rows may repeat; a NULL id comes after all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import simhash
from tallyweave.llm.common import SPACES, stored
from tallyweave.llm.graph import components
from tallyweave.operators.lookup import lookup

SEED = 42
#: The least similarity of near copies, as a fraction.
LEAST = (4, 5)
#: Longs that hold the parities of a set.
LONGS = 8
#: Most longs of the finer parities of a large set.
MOST_LONGS = 256
#: Rounds in which texts meet under shingles.
ROUNDS = 4


def shingles(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Hashes of the distinct shingles of a UTF-8 text, ascending."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    last = max(1, len(words) - shingle + 1)
    parts = map(b" ".join, zip(*(words[k : k + last] for k in range(shingle)), strict=True)) if last > 1 else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, last))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have the least similarity."""
    up, down = LEAST
    if min(len(a), len(b)) * down < max(len(a), len(b)) * up:
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared * (up + down) >= up * (len(a) + len(b))


def prefix(hashes: np.ndarray, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first shingles in the common order, as many as near copies must share one of."""
    up, down = LEAST
    most = len(hashes) - -(-len(hashes) * up // down) + 1
    if not len(hashes) or not len(common):
        return hashes[:most]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    late = np.where(common[at] == hashes, place[at], -1)
    return hashes[np.argsort(late, kind="stable")[:most]]


def parities(hashes: np.ndarray, longs: int = LONGS) -> np.ndarray:
    """Whether each of the buckets holds an odd number of the hashes, as longs."""
    odd = np.bincount((hashes % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fine_longs(n: int) -> int:
    """How many longs hold the finer parities of a set of this size, twice as many buckets as shingles or more.

    Sets that can be as alike as asked have as many, or one twice as many as the other.
    """
    longs = LONGS
    while 64 * longs < 2 * n and longs < MOST_LONGS:
        longs *= 2
    return longs


def _common(texts: DataFrame, shingle: int, sample: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in several texts of a sample, ascending, and their ranks by frequency."""
    share = min(2**20, int(np.ceil(2**20 * sample / max(texts.count(), 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), shingle) for t in batch.column(0)]
            values, n = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["token", "n"])

    drawn = texts.where(F.pmod(F.xxhash64("node"), F.lit(2**20)) < share).select(F.col("text").cast("binary"))
    counts = drawn.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    found = counts.where("n > 2").orderBy(F.desc("n"), "token").limit(most).toPandas()
    values = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], (len(values) - 1 - np.arange(len(values)))[order]


def sketches(texts: DataFrame, shingle: int = 5, sample: int = 16_384, most: int = 65_536) -> DataFrame:
    """(node, n, tokens, form, fine): the size of every text's set, its prefix and its parities, a row for each text."""
    shared = texts.sparkSession.sparkContext.broadcast(_common(texts, shingle, sample, most))
    names = [f"p{k}" for k in range(LONGS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def listed(arrays: tuple[np.ndarray, ...]) -> pa.ListArray:
            ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64)))

        def full(rows: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            nodes, sizes, tokens, fine, odd = zip(*rows, strict=True)
            odd = np.array(odd).reshape(-1, LONGS)
            columns = [
                pa.array(nodes, pa.int64()),
                pa.array(sizes, pa.int32()),
                listed(tokens),
                listed(fine),
                *(pa.array(np.ascontiguousarray(odd[:, k])) for k in range(LONGS)),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["node", "n", "tokens", "fine", *names])

        rows, size = [], 0
        for batch in batches:
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text"), strict=True):
                hashes = shingles(text.as_py(), shingle)
                fine = parities(hashes, fine_longs(len(hashes)))
                rows.append((node, len(hashes), prefix(hashes, *shared.value), fine, parities(hashes)))
                size += len(rows[-1][2])
                if size > 100_000:
                    yield full(rows)
                    rows, size = [], 0
        if rows:
            yield full(rows)

    found = texts.select("node", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "node bigint, n int, tokens array<bigint>, fine array<bigint>, " + ", ".join(f"{n} bigint" for n in names)
    )
    return found.select("node", "n", "tokens", F.struct(*names).alias("form"), "fine")


def postings(known: DataFrame) -> DataFrame:
    """(token, node, n, at): the prefix of every text; ``n`` is the size of its set, ``at`` the place in the prefix."""
    return known.select("node", "n", F.posexplode("tokens").alias("at", "token")).select("token", "node", "n", "at")


def meetings(known: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The postings under shingles that several texts are posted under.

    Most shingles are of one text.  They go in rounds by a hash, each shuffled and forgotten before the next, so
    that all postings never lie on the disks at once.
    """
    kept = []
    for k in range(rounds):
        posted = postings(known).where(F.pmod(F.xxhash64("token"), F.lit(rounds)) == k)
        met = posted.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
        kept.append(stored(lookup(posted, met.select("token"), ["token"], "left_semi"), "shared"))
    return reduce(DataFrame.unionByName, kept)


def _places_allow(other: str) -> Column:
    """Whether sets that meet at these places of their order, n and at, can be as alike as asked."""
    up, down = LEAST
    n, at, m, to = F.col("n"), F.col("at"), F.col(f"{other}n"), F.col(f"{other}at")
    shared = F.least(at, to) + F.least(n - at, m - to)
    return shared.cast("bigint") * (up + down) >= (n.cast("bigint") + m) * up


def _sets_allow(other: str) -> Column:
    """Whether sets of these sizes and parities, n and form, can be as alike as asked."""
    up, down = LEAST
    n, m, form, shape = F.col("n").cast("bigint"), F.col(f"{other}n"), F.col("form"), F.col(f"{other}form")
    apart = sum((F.bit_count(form[f"p{k}"].bitwiseXOR(shape[f"p{k}"])) for k in range(LONGS)), F.lit(0))
    return (F.least(n, m) * down >= F.greatest(n, m) * up) & ((n + m - apart) * (up + down) >= (n + m) * (2 * up))


def _finely_allowed(other: str) -> Column:
    """Whether sets of these sizes and finer parities, n and fine, can be as alike as asked."""
    up, down = LEAST
    n, m = F.col("n").cast("bigint"), F.col(f"{other}n")
    many = F.least(F.size("fine"), F.size(f"{other}fine"))
    xor = lambda x, y: x.bitwiseXOR(y)

    def folded(c: str) -> Column:
        # The buckets of half as many longs are pairs of these.
        return F.when(F.size(c) == many, F.col(c)).otherwise(F.zip_with(F.slice(c, 1, many), F.slice(c, many + 1, many), xor))

    odd = F.zip_with(folded("fine"), folded(f"{other}fine"), xor)
    apart = F.aggregate(odd, F.lit(0), lambda total, x: total + F.bit_count(x))
    return (n + m - apart) * (up + down) >= (n + m) * (2 * up)


def possible(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The (a, b) ``pairs`` that sizes and parities, and then the finer parities, do not rule out."""
    for name, allowed in (("form", _sets_allow), ("fine", _finely_allowed)):
        of = known.select("node", "n", name)
        one = lookup(pairs, of.withColumnRenamed("node", "a"), ["a"], "inner")
        other = of.select(F.col("node").alias("b"), *[F.col(c).alias(f"other_{c}") for c in ("n", name)])
        pairs = lookup(one, other, ["b"], "inner").where(allowed("other_")).select("a", "b")
    return pairs


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int = 5, block: int = 256) -> DataFrame:
    """The (a, b) ``pairs`` of nodes, none twice, whose whole texts are near copies.

    The text of an ``a`` is sent once for each ``block`` of its ``b``, about, and met by theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            ends = [batch.column(k).to_pylist() for k in ("a", "part", "b")]
            for k, (a, part, b) in enumerate(zip(*ends, strict=True)):
                hashes = shingles(batch.column("text")[k].as_py(), shingle)
                if b == a:
                    first, own = (a, part), hashes
                elif first != (a, part):
                    raise RuntimeError("a text is missing")
                elif alike(own, hashes):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).alias("parts"))
    placed = lookup(pairs, parts, ["a"], "inner").select(
        "a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b"
    )
    ends = placed.unionByName(placed.select("a", "part", F.col("a").alias("b")).distinct())
    of = texts.select(F.col("node").alias("b"), F.col("text").cast("binary").alias("text"))
    met = lookup(ends, of, ["b"], "inner").select("a", "part", "b", "text", (F.col("a") != F.col("b")).alias("after"))
    sent = met.repartition("a", "part").sortWithinPartitions("a", "part", "after")
    return sent.select("a", "part", "b", "text").mapInArrow(run, "a bigint, b bigint")


def sketched(texts: DataFrame) -> DataFrame:
    """(a, b): enough pairs to join all texts that SimHash joins, by equal fingerprints and by those of few differing bits.

    Each fingerprint stands for its smallest node, so a family of one fingerprint has one pair for each text.
    """
    prints = stored(simhash.fingerprints(texts, ["node"]), "fingerprints")
    hubs = stored(prints.groupBy("fp").agg(F.min("node").alias("hub")), "distinct")
    equal = lookup(prints, hubs, ["fp"], "inner").where(F.col("node") != F.col("hub"))
    across = simhash.links(hubs)
    for end in ("a", "b"):
        of = hubs.select(F.col("fp").alias(end), F.col("hub").alias(f"hub_{end}"))
        across = lookup(across, of, [end], "inner")
    pairs = equal.select(F.col("hub").alias("a"), F.col("node").alias("b")).unionByName(
        across.select(F.least("hub_a", "hub_b").alias("a"), F.greatest("hub_a", "hub_b").alias("b"))
    )
    return pairs.where("a <> b").distinct()


def links(texts: DataFrame, shingle: int = 5) -> DataFrame:
    """(a, b): enough pairs of near copies among the (node, text) of ``texts`` to join all of them."""
    known = stored(sketches(texts, shingle), "prefixes")
    shared = meetings(known)

    hubs = shared.groupBy("token").agg(F.min(F.struct("node", "n", "at")).alias("hub"))
    first = lookup(shared, hubs.select("token", *[F.col(f"hub.{c}").alias(f"other_{c}") for c in ("node", "n", "at")]), ["token"], "inner")
    first = first.where((F.col("node") != F.col("other_node")) & _places_allow("other_"))
    hubbed = first.select(F.col("other_node").alias("a"), F.col("node").alias("b"))
    # Both are confirmed in one pass.
    tried = stored(possible(sketched(texts).unionByName(hubbed).distinct(), known), "pairs")
    found = stored(confirmed(tried, texts, shingle), "links")

    roots = components(found)
    marked = lookup(shared, roots, ["node"]).withColumn("root", F.coalesce("root", "node"))
    sizes = marked.groupBy("token", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("token").agg(F.max(F.struct("size", "root"))["root"].alias("main"), F.count("*").alias("kinds"))
    places = lookup(marked, main.where("kinds > 1").drop("kinds"), ["token"], "inner")
    apart = stored(lookup(places, known.select("node", "form"), ["node"], "inner"), "apart")
    rest = apart.where("root <> main").select("token", *[F.col(c).alias(f"other_{c}") for c in ("node", "root", "n", "at", "form")])
    again = lookup(apart, rest, ["token"], "inner").where(
        (F.col("root") != F.col("other_root"))
        & ((F.col("root") == F.col("main")) | (F.col("node") < F.col("other_node")))
        & _places_allow("other_")
        & _sets_allow("other_")
    )
    pairs = again.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct()
    left = stored(possible(lookup(pairs, tried, ["a", "b"], "left_anti"), known), "pairs")
    return found.unionByName(confirmed(left, texts, shingle))


def one_of_each(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """Of every component of near copies the row with the smallest id; rows alike in id and text are one."""
    key, node = "_key", "_node"
    while key in docs.columns or node in docs.columns:
        key, node = key + "_", node + "_"
    bare = F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES))
    keyed = docs.withColumns(
        {key: F.xxhash64("doc_id", "text"), node: F.when(bare == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64("text"))}
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("key"))).alias("first")
    least = stored(keyed.groupBy(F.col(node).alias("node")).agg(first), "least")
    # Rows of one node have one text.
    texts = stored(
        keyed.where(F.col(node) != 0).select(F.col(node).alias("node"), "text").dropDuplicates(["node"]), "texts"
    )
    roots = components(links(texts, shingle))
    of = lookup(least, roots, ["node"]).groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    stay = of.select(F.col("first.key").alias(key)).distinct()
    # Unique on both sides by then, so that the rows are not shuffled once more.
    return keyed.dropDuplicates([key]).join(stay, key, "left_semi").drop(key, node)
