"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import discard, materialise


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(node, root))").alias("mark")).first()
    return row["n"], row["mark"] or 0


def connected_components(links: DataFrame, hub_links: int = 1_000_000) -> DataFrame:
    """(node, root) for every node of the links (a, b), both long: root is the component's smallest node.

    Alternates large-star and small-star steps until the stars no longer change. Each step takes
    the least neighbour by a pre-aggregated minimum and joins it back. Of more than ``hub_links``
    links the minima are a written table, so both sides of the join are plain shuffles and
    adaptive execution splits the links of a node that has very many; fewer fit a task whatever
    their nodes. Null ends and links of a node to itself are no links.
    """
    stars = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct(), "links")
    state = _state(stars)
    while state[0]:
        written = []

        def held(least: DataFrame, label: str) -> DataFrame:
            if state[0] <= hub_links:
                return least
            written.append(materialise(least, label))  # noqa: B023
            return written[-1]  # noqa: B023

        both = stars.union(stars.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = held(both.groupBy("node").agg(F.min("root").alias("least")).select("node", F.least("node", "least").alias("least")), "large-least")
        large = both.join(least, "node").filter("root > node").select(F.col("root").alias("node"), F.col("least").alias("root")).filter("node <> root").distinct()
        large = materialise(large, "large-star")
        discard(stars)
        least = held(large.groupBy("node").agg(F.min("root").alias("least")), "small-least")
        small = large.join(least, "node")
        small = small.filter("root <> least").select(F.greatest("root", "least").alias("node"), F.least("root", "least").alias("root")).union(least.select("node", F.col("least").alias("root"))).distinct()
        stars = materialise(small, "small-star")
        discard(large, *written)
        before, state = state, _state(stars)
        if state == before:
            break
    roots = stars.select(F.col("root").alias("node"), "root").distinct()
    return stars.union(roots)
