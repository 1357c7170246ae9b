"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.tables import kept


def _state(links: DataFrame) -> tuple:
    row = links.selectExpr(
        "count(*)", "sum(CAST(xxhash64(a, b) AS DECIMAL(38, 0)))"
    ).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a, b``): its component's
    smallest node. The rounds needed grow with the logarithm of the longest chain.

    A round reduces each node's neighbours to their minimum before it joins back, so a
    node with very many links is never gathered in one group; only a count and a
    checksum per round reach the driver. Nulls and links to itself are left out.
    """
    links = kept(
        links.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(),
        "links",
    )
    state = _state(links)
    while True:
        both = links.select("a", "b").union(links.selectExpr("b AS a", "a AS b"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        # Large star: every larger neighbour moves to the smallest node around.
        large = both.join(least, F.expr("a = u")).where("b > a").selectExpr(
            "b AS a", "least(a, m) AS b"
        )
        large = kept(large.where("a <> b").distinct(), "large")
        # Small star: every smaller neighbour and the node itself move to the smallest.
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.expr("a = u")).selectExpr("b AS a", "m AS b")
        small = small.where("a <> b").union(least.selectExpr("u AS a", "m AS b"))
        links = kept(small.distinct(), "small")
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.selectExpr("a AS node", "b AS root")
    return roots.union(roots.selectExpr("root AS node", "root").distinct())
