"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, root: for every node of an edge table (u, v), the smallest node that it reaches.

    Self-loops are ignored, so a node that has nothing else is absent. Each round writes its edges to the
    shared folder; the driver sees a row count and a checksum only.
    """
    now = saved(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        new = saved(_small_star(_large_star(now)), "edges")
        dropped(now)
        now, was, mark = new, mark, _mark(new)
        if was == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def linked_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """components() of a graph and more links (u, v), from its roots: only the components that the links touch go through rounds, a node each."""
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    ends = links.join(end("u"), "u", "left").join(end("v"), "v", "left")
    joined = components(ends.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")))
    moved = roots.alias("a").join(joined.alias("b"), F.col("a.root") == F.col("b.node"), "left")
    return moved.select("a.node", F.coalesce("b.root", "a.root").alias("root")).union(joined)
