"""Neighbouring rows of one key folded into arrays, before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Places at which the keys differ from those of the row before; NULLs are equal."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for key in keys:
        after, before = batch.column(key).slice(1), batch.column(key).slice(0, batch.num_rows - 1)
        differs = pc.fill_null(pc.not_equal(after, before), False)
        differs = pc.or_(differs, pc.xor(after.is_null(), before.is_null()))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def first_of_runs(batch: pa.RecordBatch, keys: list[str], order: str) -> np.ndarray:
    """For each row, whether it is the first by ``order``, not NULL, of its run of equal ``keys``."""
    begin = starts(batch, keys)
    value = batch.column(order).to_numpy(zero_copy_only=False)
    least = np.repeat(np.minimum.reduceat(value, begin), np.diff(np.r_[begin, len(value)]))
    places = np.where(value == least, np.arange(len(value)), len(value))
    kept = np.zeros(len(value), bool)
    kept[np.minimum.reduceat(places, begin)] = True
    return kept


def runs(
    rows: DataFrame,
    keys: list[str],
    values: list[str],
    kept: str | None = None,
    first: tuple[list[str], str] | None = None,
) -> DataFrame:
    """One row per run of neighbouring rows of equal ``keys``: these, and an array of each of ``values``.

    Runs end where a batch ends that a task reads, so a key can have several,
    and nothing is held, sorted or shuffled.  Rows in which the boolean column
    ``kept`` is not true leave no values, but their keys stay; ``first``, keys
    and an order, keeps the first row of every run of those keys within a run.
    """
    fields = [rows.schema[k] for k in keys]
    arrays = [T.StructField(v, T.ArrayType(rows.schema[v].dataType)) for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            begin = starts(batch, keys)
            use = np.ones(batch.num_rows, bool)
            if kept is not None:
                use = pc.fill_null(batch.column(kept), False).to_numpy(zero_copy_only=False)
            if first is not None:
                use = use & first_of_runs(batch, *first)
            offsets = np.r_[0, use.cumsum()][np.r_[begin, batch.num_rows]]
            mask, offsets = pa.array(use), pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(pa.array(begin)) for k in keys]
                + [pa.ListArray.from_arrays(offsets, batch.column(v).filter(mask)) for v in values],
                names=[*keys, *values],
            )

    return rows.mapInArrow(run, T.StructType([*fields, *arrays]))
