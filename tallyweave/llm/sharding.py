"""Shards of near equal bytes: contiguous runs of ordered groups, cut at the smallest feasible capacity.

Documents of equal text are one atomic group.  Groups stand in the order of
their key, a hash, and each shard is a run of them.  The smallest capacity for
which the greedy cut needs no more than the wanted number of shards is found by
binary search, and the greedy cut at that capacity is the result.

The search runs on the driver over a summary: bytes per prefix of the key.  A
prefix that holds several groups is handled twice, as one block (which gives a
capacity that certainly suffices) and as freely divisible (which gives one that
is certainly needed).  Prefixes that any cut between these capacities may touch
are then summarised one digit finer, until both agree.  So the result is that
of the full list of groups, while a few thousand sums reach the driver, however
many groups there are.

A group larger than the mean of what is left would decide the capacity alone
and leave other shards empty; such groups, fewer than there are shards, get a
shard each and the rest is cut into the remaining ones.

Defined results: a NULL text has no bytes and belongs to the group of the empty
text; repeated rows and ids each get a slot; NULL ids stand last in their
order; with fewer groups than shards some shards are empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import stored
from tallyweave.operators.lookup import lookup

EXTRA_BYTES = 16
#: Hexadecimal digits of the first summary: 4,096 prefixes.
FIRST_DIGITS = 3


def group_key(text: Column) -> Column:
    """Key of the group of equal texts: its SHA-256, which also orders the groups."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


@dataclass
class Plan:
    """Where groups go: single ones to shards of their own, the others between boundaries."""

    shards: int
    capacity: int
    single: list[str]
    boundaries: list[str]

    def shard(self, key: Column) -> Column:
        """The shard of a group, by comparing its key; no join is needed."""
        run = sum((F.when(key >= b, 1).otherwise(0) for b in self.boundaries), F.lit(len(self.single)))
        for number, own in enumerate(self.single):
            run = F.when(key == own, number).otherwise(run)
        return run.cast("int")


class Summary:
    """Sums of bytes over consecutive prefixes; ``loose`` prefixes hold more than one group."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        rows = sorted(rows)
        self.prefix = [r[0] for r in rows]
        self.size = np.array([r[1] for r in rows], np.int64)
        self.groups = np.array([r[2] for r in rows], np.int64)
        self.ends = np.r_[0, self.size.cumsum()]

    def cuts(self, capacity: int, shards: int, divide: bool) -> tuple[list[int], bool]:
        """Places (in bytes) behind each run of the greedy cut, and whether ``shards`` runs suffice."""
        places, at, total = [], 0, int(self.ends[-1])
        for _ in range(shards):
            if at >= total:
                break
            reach = at + capacity
            k = int(np.searchsorted(self.ends, reach, side="right")) - 1
            stop = int(self.ends[k])
            if k < len(self.size) and divide and self.groups[k] > 1:
                stop = reach
            if stop <= at:
                return places, False
            at = min(stop, total)
            places.append(at)
        return places, at >= total

    def least(self, shards: int, divide: bool) -> int:
        """The smallest capacity that is feasible."""
        low, high = 0, int(self.ends[-1])
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, divide)[1]:
                high = middle
            else:
                low = middle + 1
        return low

    def touched(self, low: int, high: int, shards: int) -> list[int]:
        """Loose prefixes in which a cut may lie for a capacity between the two."""
        early = self.cuts(low, shards, False)[0]
        late = self.cuts(high, shards, True)[0]
        found: set[int] = set()
        for k, to in enumerate(late):
            # Where the coarse cut is stuck, all that follows is open.
            start = early[k] if k < len(early) else (early[-1] if early else 0)
            a = int(np.searchsorted(self.ends, start, side="right")) - 1
            b = int(np.searchsorted(self.ends, to, side="left"))
            found.update(i for i in range(a, min(b, len(self.size))) if self.groups[i] > 1)
        return sorted(found)


def _summary(groups: DataFrame, digits: int) -> DataFrame:
    return groups.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("n")
    )


def plan(groups: DataFrame, shards: int, most_prefixes: int = 2_000_000) -> Plan:
    """The minimax cut of groups (key, bytes) into ``shards`` contiguous runs."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    largest = groups.orderBy(F.desc("bytes"), "key").limit(shards).collect()
    single: list[str] = []
    left = total
    for row in largest:
        rest = shards - len(single)
        if rest < 2 or row["bytes"] * rest <= left:
            break
        single.append(row["key"])
        left -= row["bytes"]
    others = groups.where(~F.col("key").isin(single)) if single else groups
    runs = shards - len(single)
    digits = FIRST_DIGITS
    summary = Summary([tuple(r) for r in _summary(others, digits).collect()])
    while True:
        low, high = summary.least(runs, True), summary.least(runs, False)
        open_at = summary.touched(low, high, runs) if low < high else []
        if low == high or not open_at:
            break
        # One digit more for the prefixes that matter; those of 256 bits are single groups.
        chosen = [summary.prefix[i] for i in open_at]
        finer = []
        for size in sorted({len(p) for p in chosen}):
            some = [p for p in chosen if len(p) == size]
            part = others.where(F.substring("key", 1, size).isin(some))
            finer += [tuple(r) for r in _summary(part, size + 1).collect()]
        keep = set(open_at)
        rows = [
            (p, int(b), int(n))
            for i, (p, b, n) in enumerate(zip(summary.prefix, summary.size, summary.groups, strict=True))
            if i not in keep
        ]
        if len(rows) + len(finer) > most_prefixes:
            raise RuntimeError("the summary outgrows the driver")
        summary = Summary(rows + finer)
    places = summary.cuts(high, runs, False)[0]
    boundaries = [summary.prefix[int(np.searchsorted(summary.ends, p))] for p in places[:-1]]
    return Plan(shards, high, single, boundaries)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key) of each row, without the texts."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(body) + EXTRA_BYTES).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        group_key(F.col("text")).alias("key"),
    )


def slots(rows: DataFrame, many: int, order: list[str], block: int = 20_000) -> DataFrame:
    """``rows`` with ``slot``: their number from 0 within a shard.

    A shard is numbered in blocks of rows by hash, so that no shard and no
    group, however large, is sorted in one task; a block starts where the
    blocks before it end.
    """
    blocks = max(1, -(-many // block))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = dealt.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_block").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    numbered = dealt.withColumn("_k", F.row_number().over(within) - 1)
    return (
        lookup(numbered, starts, ["shard", "_block"])
        .withColumn("slot", (F.col("_start") + F.col("_k")).cast("long"))
        .drop("_start", "_k", "_block")
    )


def shard(docs: DataFrame, shards: int) -> tuple[DataFrame, Plan]:
    """(doc_id, size, text_crc32, key, shard, slot) of every row, and the plan."""
    rows = stored(sized(docs), "sized")
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    cut = plan(groups, shards)
    placed = rows.withColumn("shard", cut.shard(F.col("key")))
    return slots(placed, rows.count(), ["doc_id", "key"]), cut


def write_shards(docs: DataFrame, cut: Plan, folder: str) -> None:
    """Writes whole documents by shard, as the plan cuts them."""
    docs.withColumn("shard", cut.shard(group_key(F.col("text")))).write.partitionBy("shard").parquet(folder)
