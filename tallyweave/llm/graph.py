"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import stored


def components(edges: DataFrame, name: str = "components", most_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of the (a, b) edges, ``root`` the smallest node of its component.

    Rounds of small-star and large-star: every node hands its neighbours on to
    the smallest node it knows, first among its smaller, then among its larger
    ones, until all edges point at roots.  Rounds grow with the logarithm of
    the longest chain.  The smallest neighbour is an aggregation, combined
    before it is shuffled, and is looked up by edges, so a node with very many
    neighbours is split like any skewed join key.  Each round is a stored table.
    """
    links = stored(_pointing_down(edges), name)
    for _ in range(most_rounds):
        # Small star: the smaller neighbours of a node, and itself, join the smallest.
        least = links.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most"))
        near = links.join(least, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        links = stored(_pointing_down(near.select("e.a", "e.b")), name)
        # Large star: the larger neighbours of a node join the smallest of its neighbours and itself.
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        far = links.join(
            least.select(F.col("a").alias("b"), "m"), "b", "left"
        ).select("a", F.coalesce("m", "b").alias("b"))
        links = stored(_pointing_down(far), name)
        ends = links.select("b").distinct()
        if not links.join(ends.withColumnRenamed("b", "a"), "a", "left_semi").take(1) and not (
            links.groupBy("a").count().where("count > 1").take(1)
        ):
            break
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _pointing_down(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct()
    )
