"""Product codes of vectors, learned with norm-of-sum bounds.

Vectors become integers and are cut into equal parts; every part position has a
codebook of a few entries, moved for some rounds to the floor of the mean of
the parts next to them.  All distances are exact integers.

A part keeps a lower bound of its distance to each entry, and the round in which it was
measured (its stamp).  All codebooks so far are kept, so the bound of entry j
measured in round t is good in round s after taking off the distance between
entry j in round t and in round s: the norm of the sum of its moves, which is
never more than the sum of their norms.  The distance to the entry it had
last is measured anew each round; only entries whose bound does not exceed that are
measured exactly, and stamped again.

One pass of narrow tasks per round: vectors and bounds stay in their partition
and are persisted while the next round is made (an executor lost is made up
from the table by those passes; nothing is shuffled), and a few sums per
partition, part and entry are added up by Spark.  Driver and tasks exchange codebooks only.

Defined results: a vector that is NULL, holds NULL, NaN or infinity, whose
length is not a positive multiple of the parts or differs from that of the first vector by id,
or with a component that, scaled, is not within 2**62, is dropped; repeated rows each
count; the first codebooks come from rows by rising id and then vector, NULL ids
last; with fewer rows than entries there are fewer entries; an error beyond a long
is NULL, and so is that of its label; other columns pass through ``codes``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import stored
from tallyweave.operators.lookup import lookup

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Components below this give squared distances that 64 bits hold, and doubles nearly so.
SMALL = 2**26


@dataclass
class Codebooks:
    """History of the codebooks: ``history[t]`` is (parts, entries, width) in round t, of int64 or Python integers."""

    history: list[np.ndarray]

    def moved(self, now: int) -> np.ndarray:
        """(stamps, parts, entries): net displacement of each entry from round t to ``now``, rounded up."""
        return np.stack([np.sqrt(squared(self.history[now] - old).astype(np.float64)) for old in self.history[: now + 1]]) * (1 + 1e-9)


def squared(difference: np.ndarray) -> np.ndarray:
    """Exact squared norms along the last axis."""
    return (difference * difference).sum(axis=-1)


def fitting(values: np.ndarray) -> np.ndarray:
    """As int64 where squares of differences surely fit, else as Python integers."""
    small = not values.size or (values.min() > -SMALL and values.max() < SMALL)
    return values.astype(np.int64 if small else object)


@dataclass
class Bounds:
    """What is remembered of each part: its entry, lower bounds and their stamps."""

    entry: np.ndarray  # (n, parts)
    low: np.ndarray  # (n, parts, entries), rounded down
    stamp: np.ndarray  # (n, parts, entries)


def assign(parts: np.ndarray, books: Codebooks, before: Bounds | None) -> tuple[Bounds, np.ndarray, int]:
    """Nearest entries of (n, parts, width) in the last round; exact squared distances; how many were measured."""
    now = len(books.history) - 1
    book = books.history[now]
    if book.dtype != parts.dtype:
        book, parts = book.astype(object), parts.astype(object)
    many, count, entries = len(parts), parts.shape[1], book.shape[1]
    if before is None:
        before = Bounds(
            np.zeros((many, count), np.uint8),
            np.full((many, count, entries), -np.inf, np.float32),
            np.full((many, count, entries), now, np.uint8),
        )
    entry, low, stamp = before.entry.copy(), before.low.copy(), before.stamp.copy()
    distance = np.empty((many, count), parts.dtype)
    measured, moved = 0, books.moved(now)
    rows = np.arange(many)
    for p in range(count):
        own = entry[:, p]
        nearest = squared(parts[:, p] - book[p, own])
        measured += many
        # Net displacement since each bound's own stamp; a margin covers rounding.
        valid = low[:, p] - moved[stamp[:, p], p, np.arange(entries)]
        upper = np.sqrt(nearest.astype(np.float64)) * (1 + 1e-6) + 1e-3
        open_at = ~(valid > upper[:, None])
        open_at[rows, own] = False
        low[rows, p, own], stamp[rows, p, own] = _down(nearest), now
        best = own.copy()
        for j in range(entries):
            some = np.flatnonzero(open_at[:, j])
            if not len(some):
                continue
            exact = squared(parts[some, p] - book[p, j])
            measured += len(some)
            low[some, p, j], stamp[some, p, j] = _down(exact), now
            better = (exact < nearest[some]) | ((exact == nearest[some]) & (j < best[some]))
            to = some[better]
            nearest[to], best[to] = exact[better], j
        entry[:, p], distance[:, p] = best, nearest
    return Bounds(entry, low, stamp), distance, measured


def _down(exact: np.ndarray) -> np.ndarray:
    """Distances as floats that are not above them."""
    return np.maximum(np.sqrt(exact.astype(np.float64)) * (1 - 1e-6) - 1e-3, 0).astype(np.float32)


# --- tables ---------------------------------------------------------------------------------


def kept(vectors: DataFrame, column: str, width: int | None = None) -> DataFrame:
    """Rows whose vector has usable components."""
    limit = float(2**62) / SCALE
    fine = F.col(column).isNotNull() & F.forall(
        F.col(column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < limit)
    )
    length = F.size(column)
    fine &= (length > 0) & (length % PARTS == 0) if width is None else length == width
    return vectors.where(F.coalesce(fine, F.lit(False)))


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(SCALE x): scaling by a power of two is exact."""
    return fitting(np.floor(values.astype(np.float64) * SCALE).astype(np.int64))


ADDED = ["entry", "low", "stamp", "sums", "distance"]
#: Stands for a part in the row that counts measured distances.
MEASURED = -1
STATE = "entry binary, low binary, stamp binary, sums array<struct<part:int,entry:int,n:bigint,sums:array<decimal(38,0)>>>, distance array<string>"
_SUMS = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))]))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _step(books: Codebooks, column: str, width: int, first: bool, last: bool, rows: int = 4096):
    """One round over a partition: bounds of every row, and at its end one row of sums."""
    parts_of = width // PARTS
    entries = books.history[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((PARTS, entries), np.int64)
        sums = np.zeros((PARTS, entries, parts_of), object)
        schema, measured = None, 0
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                ids = [batch.column(i) for i in range(batch.num_columns - (0 if first else len(ADDED)))]
                names = batch.schema.names[: len(ids)]
                schema = schema or pa.schema([batch.schema.field(i) for i in range(len(ids))])
                values = scaled(_matrix(batch.column(names.index(column)), width)).reshape(-1, PARTS, parts_of)
                before = None
                if not first:
                    n = len(values)
                    read = lambda c, t, b=batch: np.frombuffer(b"".join(b.column(c).to_pylist()), t)
                    before = Bounds(
                        read("entry", np.uint8).reshape(n, PARTS),
                        read("low", np.float32).reshape(n, PARTS, entries),
                        read("stamp", np.uint8).reshape(n, PARTS, entries),
                    )
                after, distance, looked = assign(values, books, before)
                measured += looked
                for p in range(PARTS):
                    own = after.entry[:, p]
                    count[p] += np.bincount(own, minlength=entries)
                    for j in np.unique(own):
                        total = values[own == j, p].sum(axis=0)
                        sums[p, j] += total.astype(object)
                yield _batch(
                    ids, names, [x.tobytes() for x in after.entry], [x.tobytes() for x in after.low],
                    [x.tobytes() for x in after.stamp], [None] * len(values),
                    [[str(d) for d in row] if last else None for row in distance.tolist()],
                )
        if schema is not None:
            listed = [
                {"part": p, "entry": j, "n": int(count[p, j]), "sums": list(map(Decimal, sums[p, j].tolist()))}
                for p in range(PARTS)
                for j in range(entries)
                if count[p, j]
            ]
            listed.append({"part": MEASURED, "entry": 0, "n": measured, "sums": [Decimal(0)]})
            yield _batch([pa.nulls(1, f.type) for f in schema], schema.names, [None], [None], [None], [listed], [None])

    return run


def _batch(ids, names, entry, low, stamp, sums, distance) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            *ids,
            pa.array(entry, pa.binary()),
            pa.array(low, pa.binary()),
            pa.array(stamp, pa.binary()),
            pa.array(sums, _SUMS),
            pa.array(distance, pa.list_(pa.string())),
        ],
        names=[*names, *ADDED],
    )


@dataclass
class Fit:
    """Codebooks of all rounds, and how many distances each pass measured."""

    books: Codebooks
    measured: list[int]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for x in self.books.history[-1].ravel().tolist()).encode()).hexdigest()


def codes(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, Fit | None]:
    """(columns of ``vectors``, ``entry`` of each part as bytes, ``distance`` of each part) and the fit."""
    reserved = {*ADDED} & {*vectors.columns}
    if reserved:
        raise ValueError(f"{sorted(reserved)}: rename these columns")
    usable = kept(vectors, column)
    order = [F.col(key).asc_nulls_last(), F.col(column)]
    shortest = usable.orderBy(*order).select(column).first()
    if shortest is None:
        return usable.select("*", F.lit(None).cast("binary").alias("entry"), F.lit(None).cast("array<string>").alias("distance")), None
    width = len(shortest[0])
    usable = kept(vectors, column, width)
    firsts = usable.orderBy(*order).limit(ENTRIES).select(column).collect()
    book = scaled(np.array([r[0] for r in firsts], np.float64)).reshape(-1, PARTS, width // PARTS)
    books, measured = Codebooks([np.ascontiguousarray(book.transpose(1, 0, 2))]), []
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in usable.schema.fields) + ", " + STATE
    rows, held = usable, None
    for turn in range(rounds + 1):
        step = _step(books, column, width, turn == 0, turn == rounds)
        state = rows.mapInArrow(step, schema).persist(StorageLevel.DISK_ONLY)
        sums = state.where("sums is not null").select(F.explode("sums").alias("s"))
        sums = sums.select("s.part", "s.entry", "s.n", F.posexplode("s.sums").alias("at", "x"))
        moved = sums.groupBy("part", "entry", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
        measured += [r["n"] for r in moved if r["part"] == MEASURED]
        if held is not None:
            held.unpersist()
        rows, held = state.where("sums is null"), state
        if turn < rounds:
            after = books.history[-1].astype(object)
            for r in moved:
                if r["part"] != MEASURED:
                    after[r["part"], r["entry"], r["at"]] = int(r["x"]) // r["n"]
            books = Codebooks([*books.history, fitting(after)])
    coded = stored(rows.select(*vectors.columns, "entry", "distance"), "codes")
    held.unpersist()
    return coded, Fit(books, measured)


def report(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every kept vector."""
    coded, fit = codes(vectors.select(key, column, label), key, column)
    total = F.aggregate("distance", F.lit(0).cast("decimal(38,0)"), lambda a, x: a + x.cast("decimal(38,0)"))
    rows = coded.select(
        key, F.lower(F.hex("entry")).alias("code"), total.try_cast("bigint").alias("error"),
        F.col(label).isNull().alias("unlabelled"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("of"),
    )
    by_label = rows.groupBy("unlabelled", "of").agg(
        F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("bigint").alias("label_error")
    )
    return lookup(rows, by_label, ["unlabelled", "of"], "inner").select(
        key, "code", "error", "label_error", F.lit(fit.digest() if fit else None).cast("string").alias("codebooks_sha256")
    )
