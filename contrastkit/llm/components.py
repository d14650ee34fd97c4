"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrastkit.llm.common import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """(node, root): each node with an edge, and the smallest node reachable from it.

    Edges are bigint pairs in any order; nulls and loops are ignored; repeated edges count once. No edges: no rows.
    Every round re-hangs edges on smaller neighbours by joins and minima that combine before the shuffle, so no
    neighbour list is ever gathered; each round is written to the shared scratch folder.
    """
    low, high = F.least(F.col(a), F.col(b)).cast("long"), F.greatest(F.col(a), F.col(b)).cast("long")
    now = cut(edges.select(high.alias("v"), low.alias("u")).where("v <> u").distinct(), "edges")
    for _ in range(most_rounds):
        lowest = now.groupBy("v").agg(F.min("u").alias("m"))
        # done when no node hangs on two others and no parent hangs on anything itself
        loose = now.groupBy("v").count().where("count > 1").select("v")
        hung = now.join(lowest.select(F.col("v").alias("u")), "u", "left_semi").select("v")
        if not loose.union(hung).limit(1).count():
            break
        large = now.join(lowest.select(F.col("v").alias("u"), "m"), "u", "left").select("v", F.coalesce("m", "u").alias("u"))
        large, before = cut(large.distinct(), "large-star"), now
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        now = cut(small.union(least.select("v", F.col("m").alias("u"))).distinct(), "small-star", instead_of=[large, before])
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As few of the edges (a, b) as join what all of them join."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return np.array(out, dtype=np.int64).reshape(-1, 2)
