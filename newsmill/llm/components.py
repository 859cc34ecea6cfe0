"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsmill.llm.common import stored


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_lowest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = _lowest(edges)
    return edges.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
        lowest.select("u", F.col("m").alias("v"))
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) -> (node, root): the smallest node of each linked node's component.

    Nodes are of any orderable type.  Nodes without a link to another do not
    appear; links of a node to itself and repeated links are ignored; no links
    give no rows.  Every step is a grouped minimum and a join, so a node with
    very many neighbours is never gathered in one task's memory.  Each round is
    written to the shared folder, and rounds go on until nothing changes.
    """
    edges = stored(_oriented(links), "edges")
    state = _state(edges)
    while state[0]:
        edges = stored(_oriented(_small_star(_oriented(_large_star(edges)))), "edges")
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
