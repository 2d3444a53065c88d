"""Connected components of an edge table, as alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import durable


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a long, b long) -> (node long, root long): for each node that has an edge, the smallest node it reaches.

    Each round sends every node's larger neighbours to its smallest one (large star), then does the
    same for its smaller neighbours (small star). Only minima are gathered, never neighbour lists, so a
    node with very many edges costs a partial aggregate and a join that adaptive execution can split.
    Rounds grow with the logarithm of the longest path. Each round's edges are written to the
    shared folder. Null ends and self-links are ignored; an empty table gives an empty one.
    """
    now = durable(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = None
    for _ in range(most_rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.where(F.col("b") > F.col("a"))
            .join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = durable(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(small.select("a", F.col("m").alias("b")))
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
