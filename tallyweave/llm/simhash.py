"""SimHash near-duplicates, found exactly with vantage-point trees.

Texts become 64-bit fingerprints and equal fingerprints one row.  Two
fingerprints that differ in at most ``radius`` bits differ in at most
``radius // 2`` bits of one of their halves, so there is a vantage-point tree
for each half: an inner node splits fingerprints by the Hamming distance of the
half to its vantage point, at the median.  By the triangle inequality a
fingerprint within that smaller radius lies on the same side, or on the other
side if the distance is that close to the boundary.  A fingerprint lives in one
leaf, its shard, and also visits the later leaves that its ball reaches over a
boundary; whatever pair there is meets in at least one shard.  Against a tree
over all 64 bits, the halves and their smaller radius cut the share of
fingerprints near a boundary from 60 to 30 percent at each level.

Inside a shard a second vantage-point tree, over all 64 bits and with the full
radius, splits further, and blocks of fingerprints are compared.  A shard
returns at most one link per fingerprint (a spanning forest), never all pairs;
blocks known to be in one component are not compared again.  Connected
components then run as Spark jobs.

The trees are fitted on a bounded sample of fingerprints (``sample`` of them, by
a hash); that decides how evenly shards are filled, never what is found.

Defined results: NULL and empty texts have no words and fingerprint 0, which
links like any other; texts of fewer words than a shingle are one shingle;
rows may repeat; a NULL id is carried and never names a component unless all
ids of it are NULL; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyweave.llm.common import stored
from tallyweave.llm.graph import components
from tallyweave.operators.lookup import lookup

SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of a UTF-8 text: bit i is set if it is in over half the hashes of the shingles."""
    # bytes: lower() changes A-Z only and split() cuts at ASCII white space only.
    words = (text or b"").lower().split()
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    if last == 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    parts = map(b" ".join, zip(*(words[k : k + last] for k in range(shingle)), strict=True))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, last)
    counts = np.zeros(64, np.int64)
    for at in range(0, last, 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > last).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = 3) -> DataFrame:
    """``keep`` and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("_text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(values.view(np.int64))], names=[*keep, "fp"]
            )

    rows = docs.select(*keep, F.col("text").cast("binary").alias("_text"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("fp", LongType())]))


# --- trees over the halves, which deal fingerprints into shards ---------------


class HalfTree:
    """A vantage-point tree over 32-bit halves; nodes in heap order, leaves are shards."""

    def __init__(self, half: np.ndarray, depth: int, radius: int, seed: int = 11):
        self.depth, self.radius = depth, radius
        self.vantage = np.zeros(2**depth - 1, np.uint32)
        self.bound = np.zeros(2**depth - 1, np.int16)
        rng = np.random.default_rng(seed)
        groups = {0: half}
        for node in range(2**depth - 1):
            points = groups.pop(node)
            best = None
            for point in rng.choice(points, min(8, len(points)), replace=False) if len(points) else [0]:
                far = np.bitwise_count(points ^ np.uint32(point)).astype(np.int16)
                cut = int(np.median(far)) if len(far) else 0
                near = (np.abs(far - cut) <= radius).mean() if len(far) else 0
                uneven = abs((far <= cut).mean() - 0.5) if len(far) else 0
                if best is None or (near + 2 * uneven, cut) < best[0]:
                    best = ((near + 2 * uneven, cut), np.uint32(point), cut, far)
            _, self.vantage[node], self.bound[node], far = best
            groups[2 * node + 1], groups[2 * node + 2] = points[far <= best[2]], points[far > best[2]]

    def places(self, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, leaf, home): the leaf each half lives in, and the later leaves its ball reaches."""
        index = np.arange(len(half))
        node = np.zeros(len(half), np.int64)
        home = np.ones(len(half), bool)
        for _ in range(self.depth):
            far = np.bitwise_count(half[index] ^ self.vantage[node]).astype(np.int16)
            bound = self.bound[node]
            inside = far <= bound
            own = 2 * node + np.where(inside, 1, 2)
            # A visitor goes wherever its ball reaches; a resident visits only leaves behind its own.
            over = inside & (far + self.radius > bound)
            under = ~inside & ~home & (far - self.radius <= bound)
            cross = over | under
            index = np.r_[index, index[cross]]
            home = np.r_[home, np.zeros(cross.sum(), bool)]
            node = np.r_[own, np.where(inside, 2 * node + 2, 2 * node + 1)[cross]]
        return index, node - (2**self.depth - 1), home


# --- pairs inside a shard -------------------------------------------------------


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the sets of a[i] and b[i]; ``label`` holds for each member a smaller or equal one, down to the root."""
    while len(a):
        ra, rb = label[a], label[b]
        apart = ra != rb
        if not apart.any():
            return
        high, low = np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart]
        np.minimum.at(label, high, low)
        while True:
            deeper = label[label]
            if np.array_equal(deeper, label):
                break
            label[:] = deeper
        a, b = a[apart], b[apart]


def _compare(points: np.ndarray, label: np.ndarray, rows: np.ndarray, cols: np.ndarray, radius: int,
             block: int = 1024) -> None:
    for i in range(0, len(rows), block):
        r = rows[i : i + block]
        for j in range(i if cols is rows else 0, len(cols), block):
            c = cols[j : j + block]
            low = label[r].min()
            if low == label[r].max() == label[c].min() == label[c].max():
                continue  # one component already
            hit, to = np.nonzero(np.bitwise_count(points[r][:, None] ^ points[c][None, :]) <= radius)
            _union(label, r[hit], c[to])


def _within(points: np.ndarray, label: np.ndarray, own: np.ndarray, guests: np.ndarray, radius: int,
            leaf: int, rng: np.random.Generator) -> None:
    """Links own-own and own-guest pairs: a vantage-point tree over all 64 bits."""
    stack = [(own, guests)]
    while stack:
        own, guests = stack.pop()
        if not len(own) or len(own) + len(guests) < 2:
            continue
        vantage = points[rng.choice(own)]
        far = np.bitwise_count(points[own] ^ vantage).astype(np.int16)
        cut = int(np.median(far))
        inside, near = far <= cut, (far <= cut) & (far > cut - radius)
        if len(own) <= leaf or inside.all() or near.mean() > 0.6:  # small, or nothing would be pruned
            _compare(points, label, own, own, radius)
            _compare(points, label, own, guests, radius)
            continue
        away = np.bitwise_count(points[guests] ^ vantage).astype(np.int16)
        stack.append((own[inside], guests[away <= cut + radius]))
        stack.append((own[~inside], np.r_[guests[away > cut - radius], own[near]]))


def shard_links(points: np.ndarray, home: np.ndarray, radius: int, leaf: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """A forest linking all fingerprints of a shard that are joined by pairs with a resident in them."""
    own = np.flatnonzero(home)
    label = np.arange(len(points))
    # Residents first, by value: equal stretches lie together and roots are residents.
    _within(points, label, own, np.flatnonzero(~home), radius, leaf, np.random.default_rng(5))
    linked = np.flatnonzero(label != np.arange(len(label)))
    return points[linked], points[label[linked]]


def links(distinct: DataFrame, radius: int = 3, shard_rows: int = 8192, sample: int = 65_536,
          most_depth: int = 12) -> DataFrame:
    """(a, b) over the ``fp`` column of ``distinct``: enough links to join all that differ in at most ``radius`` bits."""
    rows = distinct.count()
    depth = min(most_depth, max(0, int(np.ceil(np.log2(max(rows, 1) / shard_rows)))))
    share = min(2**20, int(np.ceil(2**20 * sample / max(rows, 1))))
    drawn = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(2**20)) < share).select("fp")
    points = drawn.toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    trees = [
        HalfTree((points >> np.uint64(shift)).astype(np.uint32), depth, radius // 2) for shift in (0, 32)
    ]
    shared = distinct.sparkSession.sparkContext.broadcast(trees)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column("fp").to_numpy(zero_copy_only=False)
            fp = signed.view(np.uint64)
            for side, tree in enumerate(shared.value):
                index, leaf, home = tree.places((fp >> np.uint64(32 * side)).astype(np.uint32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf * 2 + side), pa.array(home), pa.array(signed[index])],
                    names=["shard", "home", "fp"],
                )

    def link(shard: pd.DataFrame) -> pd.DataFrame:
        a, b = shard_links(shard["fp"].to_numpy().view(np.uint64), shard["home"].to_numpy(), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "shard bigint, home boolean, fp bigint")
    return dealt.groupBy("shard").applyInPandas(link, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, keep: list[str] | None = None, shingle: int = 3, radius: int = 3) -> DataFrame:
    """``keep`` (``doc_id`` at least), fp, root, component_id.

    Rows of one component share ``root``; ``component_id`` is the smallest id
    reachable over links of at most ``radius`` bits.
    """
    prints = stored(fingerprints(docs, keep or ["doc_id"], shingle), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = components(links(distinct, radius))
    roots = lookup(distinct.withColumnRenamed("fp", "node"), joined, ["node"], "inner")
    least = roots.groupBy("root").agg(F.min("least").alias("component"))
    # Fingerprints without links are components of their own.
    of = lookup(roots.select(F.col("node").alias("fp"), "root"), least, ["root"])
    every = lookup(distinct, of, ["fp"]).select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component")).alias("component_id")
    )
    return lookup(prints, every, ["fp"])


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """Of every component the row with the smallest id; rows alike in id and text are one."""
    key = "_key"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = near_duplicates(keyed.select(key, "doc_id", "text"), [key, "doc_id"], shingle, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)).alias("first")
    stay = found.groupBy("root").agg(first).select(F.col(f"first.{key}").alias(key)).distinct()
    return lookup(keyed, stay, [key], "left_semi").dropDuplicates([key]).drop(key)


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
