"""Connected components by alternating large-star and small-star rounds, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import drop, table


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over (a, b) rows with a > b.

    Large star: each node's larger neighbours go to the least node of its neighbourhood.
    Small star: each node and its smaller neighbours go to the least of them.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = near.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = (
            edges.join(least, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
        )
    return moved.filter("a > b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node that can be reached.

    Any orderable type; self-links, repeated links and both directions are allowed, rows with a null end are ignored.
    Rounds grow with the logarithm of the longest path. Each round's edges are written to the scratch folder. The
    least neighbour of a node is found by a partial aggregation; the joins on a hub are left to adaptive skew splitting.
    """
    now = table(
        edges.select("a", "b").dropna().filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    nodes = now.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    start, sign = now, None
    for _ in range(max_rounds):
        nxt = table(_stars(_stars(now, True), False), "stars")
        seen = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now is not start:
            drop(now)
        now = nxt
        if (seen.n, seen.h) == sign or not seen.n:
            break
        sign = (seen.n, seen.h)
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
