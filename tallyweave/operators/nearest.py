"""Exact nearest neighbours by inner product, tile by tile.

Queries and pool are cut into blocks by a hash; every pair of blocks is one
tile, worked off in matrix products of bounded size that keep the best ``k``
per query.  A side has at most ``SIDE`` blocks as long as these fit a task's
memory, so rows are handed to a fixed number of tiles, however many there are.
Nothing is assumed of the vectors, so any lengths are fine.  Copies of a vector
are folded into one row beforehand: a vector that makes up much of the table
costs as much as any other.  The work is queries times pool, as an exact answer
over vectors that do not cluster needs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.lookup import lookup

#: Blocks of a side, as long as a block has room for its share of the rows.
SIDE = 8
#: Fewest rows worth a block, and rows of a tile that are multiplied at once.
FEW, ROWS, COLUMNS = 2048, 256, 8192


def _name(vector: Column | str) -> Column:
    """A 128-bit name of a vector, to join on instead of the vector."""
    return F.concat_ws(":", F.xxhash64(vector), F.xxhash64(F.lit(1), vector))


def _sound(vector: str) -> Column:
    """The vector; NULL vectors and NULLs inside are an error, as wrong lengths are in a tile."""
    bad = F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull())
    return F.when(bad, F.raise_error(F.lit("a vector is NULL or holds NULL"))).otherwise(F.col(vector))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype("float64")


def _fold(df: DataFrame, id_col: str, vec_col: str, keep: int) -> DataFrame:
    """One row per distinct vector with its ``keep`` smallest ids."""
    nth = Window.partitionBy("vec").orderBy("id")
    return (
        df.select(F.col(id_col).alias("id"), _sound(vec_col).alias("vec"))
        .withColumn("_nth", F.row_number().over(nth))
        .filter(F.col("_nth") <= keep)
        .groupBy("vec")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )


def _top(left: np.ndarray, right: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, product) of the ``wanted`` largest products of every left row, the smaller column first.

    Once a row has that many, only larger products of later columns are looked at.
    """
    found: list[tuple[np.ndarray, ...]] = []
    sound = np.isfinite(left).all() and np.isfinite(right).all()
    for at in range(0, len(left), ROWS):
        some = -left[at : at + ROWS]
        row, column, distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least, start, stop = np.full(len(some), np.inf), 0, max(wanted, FEW) if sound else len(right)
        while start < len(right):
            far = some @ right[start:stop].T
            if not sound:
                order = np.argsort(far, axis=1, kind="stable")[:, :wanted]
                row = np.repeat(np.arange(len(some)), order.shape[1])
                column, distance = order.ravel(), np.take_along_axis(far, order, axis=1).ravel()
                break
            if start == 0 and far.shape[1] > wanted:
                near = far <= np.partition(far, wanted - 1, axis=1)[:, wanted - 1 :][:, :1]
            else:
                near = far < least[:, None]
            r, c = np.nonzero(near)
            row, column = np.r_[row, r], np.r_[column, c + start]
            distance = np.r_[distance, far[r, c]]
            order = np.lexsort((column, distance, row))
            row, column, distance = row[order], column[order], distance[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            kept = place < wanted
            row, column, distance, place = row[kept], column[kept], distance[kept], place[kept]
            last = place == wanted - 1
            least[row[last]] = distance[last]
            start, stop = stop, stop + COLUMNS
        found.append((row + at, column, -distance))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _tiles(df: DataFrame, blocks: int, others: int, own: str, other: str) -> DataFrame:
    """Each row in the tiles of its own block with all blocks of the other side."""
    across = F.sequence(F.lit(0), F.lit(others - 1))
    return df.withColumns(
        {own: F.pmod(F.xxhash64("vec"), F.lit(blocks)).cast("int"), other: F.explode(across)}
    )


def _blocks(rows: int, most: int) -> int:
    return max(1, math.ceil(rows / min(most, max(FEW, math.ceil(rows / SIDE)))))


def nearest_neighbours(
    queries: DataFrame,
    pool: DataFrame,
    k: int,
    query_id: str = "vec_id",
    pool_id: str = "vec_id",
    vector: str = "embedding",
    exclude_self: bool = False,
    block_rows: int = 131_072,
) -> DataFrame:
    """The ``k`` pool rows of highest inner product for every query row.

    Returns ``query_id, rank, neighbour_id, score``; ranked by the raw score,
    equal scores by id; the score shown has four decimals.  ``exclude_self``
    drops a query's own id from its answer.  ``block_rows`` is the most rows a block has room for.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    wanted = k + 1 if exclude_self else k
    id_type = pool.schema[pool_id].dataType.simpleString()
    size = pool.count()
    if size == 0:
        raise ValueError("the pool is empty")
    pool_blocks = _blocks(size, block_rows)
    query_blocks = _blocks(queries.count(), block_rows)
    distinct = queries.select(_sound(vector).alias("vec")).distinct().withColumn("q", _name("vec"))
    left = _tiles(distinct, query_blocks, pool_blocks, "qb", "pb")
    right = _tiles(_fold(pool, pool_id, vector, wanted), pool_blocks, query_blocks, "pb", "qb")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "score": [], "ids": []})
        right = right.assign(first=[ids[0] for ids in right["ids"]]).sort_values("first")
        row, column, score = _top(_matrix(left["vec"]), _matrix(right["vec"]), wanted)
        return pd.DataFrame(
            {"q": left["q"].to_numpy()[row], "score": score, "ids": right["ids"].to_numpy()[column]}
        )

    found = (
        left.groupBy("qb", "pb")
        .cogroup(right.groupBy("qb", "pb"))
        .applyInPandas(best, f"q string, score double, ids array<{id_type}>")
    )
    rank = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    near = (
        found.withColumn("_n", F.row_number().over(rank))
        .filter(F.col("_n") <= wanted)
        .groupBy("q")
        .agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    )
    asked = queries.select(F.col(query_id).alias("query_id"), _name(vector).alias("q"))
    each = F.flatten(
        F.transform(
            "near",
            lambda n: F.transform(
                n["ids"], lambda i: F.struct((-n["score"]).alias("distance"), i.alias("id"))
            ),
        )
    )
    if exclude_self:
        each = F.filter(each, lambda n: n["id"] != F.col("query_id"))
    return (
        lookup(asked, near, ["q"], "inner")
        .select("query_id", F.posexplode(F.slice(F.array_sort(each), 1, k)).alias("_at", "n"))
        .select(
            "query_id",
            (F.col("_at") + 1).alias("rank"),
            F.col("n.id").alias("neighbour_id"),
            F.round(-F.col("n.distance"), 4).alias("score"),
        )
    )
