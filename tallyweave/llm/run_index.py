"""Repeated passages by run-length indexes: run-compressed Burrows-Wheeler transforms with sampled run ends.

A byte is removed if a string of ``LONG`` bytes over it also starts anywhere else.

*Sharding.*  The smallest of the hashes of all ``SEED``-byte strings in a string
of ``LONG`` bytes (the leftmost of equal ones) is its anchor; equal strings have
equal anchors.  Neighbouring strings share one, so a text falls into regions:
an anchor, the strings it stands for, and their bytes.  Regions whose anchor is
found once in the corpus hold nothing repeated and are done.  Equal regions are
folded to one by a 128-bit digest before any bytes move; what occurs twice is repeated as a whole.
Where an anchor has different regions, one of each goes, with all others of that anchor, to a
shard of bounded size.

*Index.*  A shard's suffixes are sorted by doubling, and the transform is kept as runs
with the text positions at their heads and tails.  Common prefixes are measured
only there: inside a run a suffix and its neighbour have one byte less in common than
the pair one byte before.  Streaming once through the text thus gives the
matching statistics of every position against all others of the shard, and
positions with ``LONG`` or more are marked.

An anchor with more than ``most`` different regions (a passage that very many
texts share, each going on in its own way) has no bounded shard; its strings are
named one by one by 128-bit digests, counted by Spark.

Defined results: NULL is an empty text; texts below ``LONG`` bytes keep all; a
text that occurs twice and is long enough goes whole, every copy; matches may overlap
and lie in one text, but never cross texts; very long texts are cut into
overlapping stretches for hashing; ids may repeat or be NULL; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import stored
from tallyweave.llm.merkle import starts_of, whole_groups
from tallyweave.operators.lookup import lookup

LONG = 400
SEED = 128
#: Bytes hashed at once; places in a stretch take as many bits of a sort key.
STRETCH_BITS = 20
STRETCH = 1 << STRETCH_BITS
SHARD_BYTES = 1 << 20

# --- anchors ---------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Hasher:
    """Hashes of all SEED-byte strings of a stretch, from sums of bytes times powers."""

    def __init__(self, stretch: int = STRETCH):
        self.power = self.powers(_BASE, stretch)
        self.inverse = self.powers(pow(_BASE, -1, 2**64), stretch)

    @staticmethod
    def powers(base: int, many: int) -> np.ndarray:
        out = np.full(many + 1, np.uint64(base))
        out[0] = 1
        return np.multiply.accumulate(out)

    def __call__(self, data: np.ndarray, seed: int = SEED) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=sums[1:])
        h = (sums[seed:] - sums[:-seed]) * self.inverse[: len(data) - seed + 1]
        for _ in range(2):
            h ^= h >> np.uint64(32)
            h *= _MIX
        return h ^ (h >> np.uint64(29))


def smallest(key: np.ndarray, wide: int) -> np.ndarray:
    """Minimum of every ``wide`` neighbours: of a block's end and the next one's beginning."""
    blocks = np.full(-(-len(key) // wide) * wide, np.uint64(2**64 - 1))
    blocks[: len(key)] = key
    blocks = blocks.reshape(-1, wide)
    begin = np.minimum.accumulate(blocks, axis=1).ravel()
    end = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(end[: len(key) - wide + 1], begin[wide - 1 : len(key)])


def regions(hasher: Hasher, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, first, last) of the regions of texts that stand one after the other in ``data``.

    ``first`` and ``last`` are where in ``data`` the first and last string of a region start.
    """
    some = np.flatnonzero(lengths >= LONG)
    if not len(some):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    starts, ends = starts[some], (starts + lengths)[some] - LONG
    hashes = hasher(data)
    places = np.uint64(STRETCH - 1)
    key = (hashes & ~places) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (smallest(key, LONG - SEED + 1) & places).astype(np.int64)
    edge = np.zeros(len(anchor) + 1, np.int8)
    edge[starts] += 1
    np.add.at(edge, ends + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    opens = np.zeros(len(anchor), bool)
    opens[starts] = True
    first = np.flatnonzero(valid & (opens | np.r_[True, anchor[1:] != anchor[:-1]]))
    text = np.searchsorted(starts, first, side="right") - 1
    last = np.minimum(np.r_[first[1:] - 1, len(anchor) - 1], ends[text])
    return some[text], hashes[anchor[first]], first, last


def stretches(offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(place in the data, starts, lengths, first text) of stretches of whole short texts or parts of a long one."""
    lengths = np.diff(offsets)
    k = 0
    while k < len(lengths):
        if lengths[k] > STRETCH:
            for at in range(0, int(lengths[k]) - LONG + 1, STRETCH - LONG + 1):
                yield int(offsets[k]) + at, np.zeros(1, np.int64), np.array([min(STRETCH, int(lengths[k]) - at)]), k
            k += 1
            continue
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + STRETCH, side="right")) - 1)
        yield int(offsets[k]), (offsets[k:end] - offsets[k]).astype(np.int64), lengths[k:end].astype(np.int64), k
        k = end


REGIONS = "key binary, anchor bigint, d1 bigint, d2 bigint, first bigint, last bigint"


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, data) of a binary column without NULLs."""
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, data = _bytes_of(batch.column("text"))
        view = memoryview(data)
        for at, starts, lengths, base in stretches(offsets):
            end = at + int(starts[-1] + lengths[-1])
            text, anchor, first, last = regions(hasher, data[at:end], starts, lengths)
            if not len(text):
                continue
            own = b"".join(
                xxhash.xxh3_128_digest(view[a:b]) for a, b in zip((at + first).tolist(), (at + last + LONG).tolist(), strict=True)
            )
            digest = np.frombuffer(own, ">i8").astype(np.int64).reshape(-1, 2)
            # Where a long text was cut, ``at`` is not its beginning.
            inside = at - offsets[base] if len(starts) == 1 else 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(base + text)),
                    pa.array(anchor.view(np.int64)),
                    pa.array(digest[:, 0]),
                    pa.array(digest[:, 1]),
                    pa.array(first - starts[text] + inside),
                    pa.array(last - starts[text] + inside),
                ],
                names=["key", "anchor", "d1", "d2", "first", "last"],
            )


# --- the index ---------------------------------------------------------------------------------


@dataclass
class RunIndex:
    """Runs of the transform of some texts, and the text positions at their heads and tails."""

    symbols: np.ndarray  # of each run: 0 stands for the end of a text, else byte + 1
    lengths: np.ndarray
    heads: np.ndarray
    tails: np.ndarray
    #: Symbols of all texts, each ended by 0; seven of them packed at each place; distance to the text's end.
    text: np.ndarray
    packed: np.ndarray
    left: np.ndarray

    @classmethod
    def build(cls, texts: list[bytes]) -> RunIndex:
        many = np.array(list(map(len, texts)))
        text = np.zeros(int(many.sum()) + len(texts), np.int64)
        ends = np.cumsum(many + 1) - 1
        body = np.ones(len(text), bool)
        body[ends] = False
        text[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        left = np.repeat(ends, many + 1) - np.arange(len(text))
        packed, open_ = np.zeros(len(text), np.int64), np.ones(len(text), bool)
        longer = np.r_[text, np.zeros(7, np.int64)]
        for k in range(7):
            packed = (packed << 9) | np.where(open_, longer[k : k + len(text)], 0)
            open_ &= longer[k : k + len(text)] > 0
        order = suffixes(packed, left)
        before = text[order - 1]
        # Ends of texts all differ from each other, so each is a run.
        change = np.r_[True, (before[1:] != before[:-1]) | (before[1:] == 0)]
        at = np.flatnonzero(change)
        return cls(before[at], np.diff(np.r_[at, len(text)]), order[at], order[np.r_[at[1:], len(text)] - 1], text, packed, left)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``a`` and ``b`` have in common, ends not counted."""
        out = np.zeros(len(a), np.int64)
        going = np.arange(len(a))
        while len(going):
            x, y = self.packed[a[going] + out[going]], self.packed[b[going] + out[going]]
            left = np.minimum(self.left[a[going] + out[going]], self.left[b[going] + out[going]])
            # Equal packs share seven symbols, others as many as stand before the first bit that differs;
            # halves of 32 bits are exact as doubles.
            differ = x ^ y
            high = differ >> 32
            bits = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, np.frexp((differ & 0xFFFFFFFF).astype(np.float64))[1])
            same = (63 - bits) // 9
            out[going] += np.minimum(same, left)
            going = going[(differ == 0) & (left > 7)]
        return out

    def statistics(self) -> np.ndarray:
        """For each place, the longest prefix of its suffix that also starts elsewhere."""
        place = np.arange(len(self.text))
        lcp = self.common(self.heads[1:], self.tails[:-1])
        ahead, behind = np.zeros((2, len(self.text)), np.int64)
        ahead[self.heads[1:]] = lcp
        behind[self.tails[:-1]] = lcp
        # Values inside runs follow by taking one off per place; a run's own value is never less.
        stream = lambda x: np.maximum.accumulate(x + place) - place
        return np.minimum(np.maximum(stream(ahead), stream(behind)), self.left)


def suffixes(packed: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Order of all suffixes; ends of texts are smaller than bytes, and in the order of the texts."""
    many, reach = len(packed), 7
    order = np.argsort(packed, kind="stable")
    ended = left < reach
    new = np.r_[True, (packed[order[1:]] != packed[order[:-1]]) | ended[order[1:]]]
    rank = np.empty(many, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(many), 0))
    slots = np.flatnonzero(~(new & np.r_[new[1:], True]))
    while len(slots):
        own = order[slots]
        key = rank[own] * many + rank[own + reach]
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[slots] = own
        new = np.r_[True, key[1:] != key[:-1]]
        rank[own] = slots[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        slots = slots[~(new & np.r_[new[1:], True])]
        reach *= 2
    return order


def repeated(texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each text, runs of places (first, last) where a string starts that also starts elsewhere."""
    index = RunIndex.build(texts)
    marked = index.statistics() >= LONG
    edge = np.flatnonzero(np.diff(np.r_[0, marked.astype(np.int8), 0]))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        # The end of a text is never marked, so a run lies in one text.
        k = int(np.searchsorted(begins, a, side="right")) - 1
        out[k].append((a - int(begins[k]), b - 1 - int(begins[k])))
    return out


MARKS = "d1 bigint, d2 bigint, spans array<struct<first:bigint,last:bigint>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _marks(d1: list[int], d2: list[int], spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    listed = [[{"first": a, "last": b} for a, b in s] for s in spans]
    return pa.RecordBatch.from_arrays(
        [pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(listed, _SPANS)], names=["d1", "d2", "spans"]
    )


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of the regions of each shard, from rows sorted by shard."""
    for table in whole_groups(batches, ["shard"], 1):
        starts = starts_of(table, ["shard"])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            part = table.slice(a, b - a)
            # A region may have been fetched twice, from rows of equal text and id.
            own = dict(zip(zip(part.column("d1").to_pylist(), part.column("d2").to_pylist(), strict=True),
                           part.column("bytes").to_pylist(), strict=True))
            spans = repeated(list(own.values()))
            found = [(*d, s) for d, s in zip(own, spans, strict=True) if s]
            if found:
                yield _marks(*map(list, zip(*found, strict=True)))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of all strings of regions."""
    for batch in batches:
        d1, d2 = batch.column("d1").to_pylist(), batch.column("d2").to_pylist()
        for k, body in enumerate(batch.column("bytes")):
            view = body.as_buffer()
            view = memoryview(view)
            many = len(view) - LONG + 1
            own = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[a : a + LONG]) for a in range(many)), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d1[k]] * many, pa.int64()),
                    pa.array([d2[k]] * many, pa.int64()),
                    pa.array(np.arange(many)),
                    pa.array(own[::2]),
                    pa.array(own[1::2]),
                ],
                names=["d1", "d2", "at", "w1", "w2"],
            )


# --- the job -----------------------------------------------------------------------------------


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def text_key(text: Column) -> Column:
    """Names a text: half of its SHA-256."""
    return F.unhex(F.substring(text_digest(text), 1, 32))


@dataclass
class Found:
    """Stored tables: one row per document, regions whose anchor is shared, their texts, and marks by region."""

    documents: DataFrame
    shared: DataFrame
    texts: DataFrame
    marks: DataFrame


def find(docs: DataFrame, most: int = 4096) -> Found:
    """All repeated strings of ``LONG`` bytes, by region."""
    body = F.coalesce("text", F.lit(""))
    info = stored(
        docs.select("doc_id", text_digest(F.col("text")).alias("sha"), F.octet_length(body).cast("long").alias("n_bytes"))
        .withColumn("key", F.unhex(F.substring("sha", 1, 32)))
        .withColumn("row", F.xxhash64("doc_id")),
        "info",
    )
    raw = docs.where(F.octet_length("text") >= LONG).select(text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    table = stored(raw.mapInArrow(_regions, REGIONS), "regions")

    # Anchors found twice; ``many`` if with different regions.
    anchors = table.groupBy("anchor").agg(
        F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("d1", "d2") for f in (F.min, F.max)]
    )
    twice = anchors.where("n > 1").select("anchor", F.expr("min_d1 <> max_d1 OR min_d2 <> max_d2").alias("many"))
    copies = lookup(table, twice, ["anchor"], "inner").groupBy("key", "anchor", "d1", "d2", "first", "last", "many").agg(
        F.count("*").alias("copies")
    )
    shared = stored(copies.withColumn("id", F.monotonically_increasing_id()), "shared")

    kinds = stored(
        shared.groupBy("anchor", "d1", "d2", "many").agg(
            F.sum("copies").alias("n"), F.min("id").alias("id"), F.max(F.col("last") - F.col("first")).alias("far")
        ),
        "kinds",
    )
    different = kinds.where("many").groupBy("anchor").agg(F.count("*").alias("kinds"))
    total = kinds.where("many").agg(F.sum(F.col("far") + LONG)).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_BYTES))
    shard = F.when(F.col("kinds") <= most, F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    wanted = lookup(kinds.where("many").select("anchor", "id"), different.select("anchor", shard.alias("shard")), ["anchor"], "inner")
    regions_wanted = lookup(shared.drop("many", "copies"), wanted.select("id", "shard"), ["id"], "inner")
    listed = regions_wanted.groupBy("key").agg(F.collect_list(F.struct("shard", "d1", "d2", "first", "last")).alias("wanted"))

    # One row of each text with shared anchors.
    keys = lookup(shared.select("key").distinct(), info.groupBy("key").agg(F.min("row").alias("row")), ["key"], "inner")
    keys = keys.join(listed, "key", "left")
    bodies = docs.where(F.octet_length("text") >= LONG).select(
        text_key(F.col("text")).alias("key"), F.xxhash64("doc_id").alias("row"), F.col("text").cast("binary").alias("text")
    )
    texts = stored(lookup(bodies, keys, ["key", "row"], "inner").drop("row"), "texts")

    piece = F.substring("text", (F.col("w.first") + 1).cast("int"), (F.col("w.last") - F.col("w.first") + LONG).cast("int"))
    pieces = texts.where("wanted is not null").select("text", F.explode("wanted").alias("w")).select(
        "w.shard", "w.d1", "w.d2", piece.alias("bytes")
    )
    cold = pieces.where("shard is not null").repartition("shard").sortWithinPartitions("shard")
    indexed = cold.mapInArrow(_indexed, MARKS)
    named = pieces.where("shard is null").drop("shard").mapInArrow(_named, "d1 bigint, d2 bigint, at bigint, w1 bigint, w2 bigint").distinct()
    known_twice = named.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    hot = lookup(named, known_twice, ["w1", "w2"], "inner").groupBy("d1", "d2").agg(
        F.collect_list(F.struct(F.col("at").alias("first"), F.col("at").alias("last"))).alias("spans")
    )
    # Regions that occur twice are repeated as a whole.
    whole = kinds.where("n > 1").select(
        "d1", "d2", F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("far").alias("last"))).alias("spans")
    )
    marks = indexed.unionByName(hot) if different.where(F.col("kinds") > most).take(1) else indexed
    marks = lookup(marks, kinds.where("n > 1").select("d1", "d2"), ["d1", "d2"], "left_anti").unionByName(whole)
    return Found(info, shared, texts, stored(marks, "marks"))


def cover(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes (begin, end) covered by strings starting at ``spans`` (first, last)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b + LONG > out[-1][1]:
                out[-1] = out[-1][0], b + LONG
        else:
            out.append((a, b + LONG))
    return out


RUNS = "key binary, text binary, runs array<struct<first:bigint,last:bigint>>"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed runs (first byte, byte behind the last) of each text, from its regions' spans."""
    for batch in batches:
        runs = []
        for found in batch.column("found").to_pylist():
            spans = [(r["first"] + s["first"], r["first"] + s["last"]) for r in found for s in r["spans"]]
            runs.append([{"first": a, "last": b} for a, b in cover(spans)])
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("text"), pa.array(runs, _SPANS)], names=["key", "text", "runs"])


def removed(found: Found) -> DataFrame:
    """(key, text as bytes, runs) of texts with anything repeated: ``runs`` are the maximal removed ones."""
    spans = lookup(found.shared.select("key", "d1", "d2", "first"), found.marks, ["d1", "d2"], "inner")
    by_text = spans.groupBy("key").agg(F.collect_list(F.struct("first", "spans")).alias("found"))
    texts = lookup(found.texts.drop("wanted"), by_text, ["key"], "inner")
    return texts.select("key", "text", "found").mapInArrow(_runs, RUNS)


REPORT = "key binary, n_removed bigint, n_spans bigint, kept_sha256 string"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone, many, kept = [], [], []
        for text, runs in zip(batch.column("text"), batch.column("runs").to_pylist(), strict=True):
            view, digest, at = memoryview(text.as_buffer()), hashlib.sha256(), 0
            for r in runs:
                digest.update(view[at : r["first"]])
                at = r["last"]
            digest.update(view[at:])
            gone.append(sum(r["last"] - r["first"] for r in runs))
            many.append(len(runs))
            kept.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array(kept, pa.string())],
            names=["key", "n_removed", "n_spans", "kept_sha256"],
        )


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    found = find(docs)
    # A text may stand twice in ``texts``, for rows of equal text and id.
    rows = removed(found).mapInArrow(_report, REPORT).groupBy("key").agg(
        F.max("n_removed").alias("n_removed"), F.max("n_spans").alias("n_spans"), F.max("kept_sha256").alias("kept_sha256")
    )
    joined = lookup(found.documents, rows, ["key"])
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )
