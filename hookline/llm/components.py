"""Connected components of a link table.

Alternates two kinds of step until the links are stars around the smallest node of
each component: a local one, in which every task contracts the links of its own
partition by union-find, and the large-star and small-star joins (Kiveris et al.,
"Connected components in MapReduce and beyond", 2014).  A partition holds about
`LOCAL_LINKS` links, so no task holds more however large the table is.  Every step is
written to the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hookline.llm import common as C

#: Links that one task contracts, about.
LOCAL_LINKS = 250_000


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars around the smallest nodes of a partition's own components."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    for part in batches:
        for u, v in zip(part["u"].tolist(), part["v"].tolist()):
            a, b = find(u), find(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pd.DataFrame({"u": nodes, "v": [find(x) for x in nodes]}, dtype="int64")


def _unfinished(links: DataFrame) -> bool:
    """Whether some node points to two nodes, or points and is pointed to."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("pointed")).unionByName(
        links.select(F.col("v").alias("node"), F.lit(0).alias("points"), F.lit(1).alias("pointed"))
    )
    nodes = ends.groupBy("node").agg(F.sum("points").alias("points"), F.max("pointed").alias("pointed"))
    return not nodes.where("points > 1 OR points = 1 AND pointed = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of `links` (u, v); component: smallest node."""
    links = C.stage(links.where("u != v").select("u", "v"), "links")
    while True:
        parts = -(-links.count() // LOCAL_LINKS)
        links = C.stage(links.coalesce(max(1, parts)).mapInPandas(_contract, "u long, v long"), "contracted")
        if not _unfinished(links):
            break
        links = C.stage(_small_star(_large_star(links)).where("u != v").distinct(), "stars")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
