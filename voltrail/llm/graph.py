"""Connected components of links between numbered rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.session import send_to_tasks, written

#: So many edges are one task's work.
TASK_EDGES = 200_000


def _fingerprint(edges: DataFrame) -> tuple[int, ...]:
    """Differs, as far as 128 bits can, between different sets of edges."""
    hashes = [F.bit_xor(F.xxhash64("a", "b", F.lit(salt))) for salt in (1, 2)]
    return tuple(edges.agg(F.count(F.lit(1)), *hashes).first())


def followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """node, component (its smallest node) for the nodes of the edges a, b."""
    above: dict[int, int] = {}

    def top(node: int) -> int:
        while (up := above.setdefault(node, node)) != node:
            above[node] = node = above[up]
        return node

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    yield pd.DataFrame([(node, top(node)) for node in list(above)], columns=["node", "component"], dtype="int64")


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of links a, b.

    Each round ties every node's larger neighbours, then its smaller ones, to its smallest neighbour, until each
    component is a star; the number of rounds grows with the logarithm of the component's size. The smallest
    neighbours are written before they meet the links again, so Spark can split the links of a node that has many.
    Up to TASK_EDGES edges are followed by one task, as a round costs a dozen stages, however few its edges.
    """
    send_to_tasks(__name__)
    a, b = F.least("a", "b"), F.greatest("a", "b")
    edges = written(links.where("a <> b").select(a.alias("a"), b.alias("b")), "links")
    if edges.count() <= TASK_EDGES:
        return edges.coalesce(1).mapInPandas(followed, "node long, component long")
    edges = written(edges.distinct(), "links")
    before = _fingerprint(edges)
    while before[0] > TASK_EDGES:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "links")
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = written(large.where("a <> b").distinct(), "links")
        # Every edge now leads from a smaller node a to b.
        least = written(large.groupBy("b").agg(F.min("a").alias("m")), "links")
        small = large.join(least, "b").select("m", "a", "b")
        tied = small.select(F.col("m").alias("a"), "b").union(small.where("a <> m").select(F.col("m"), F.col("a")))
        edges = written(tied.distinct(), "links")
        now = _fingerprint(edges)
        if now == before:
            tails = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
            return tails.union(edges.select("a", "a")).distinct()
        before = now
    return edges.coalesce(1).mapInPandas(followed, "node long, component long")
