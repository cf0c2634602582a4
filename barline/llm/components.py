"""Connected components by alternating large and small stars, lineage cut by written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import materialize, remove_path

#: Links that one task writes, about: a few links make a few files, however many partitions a shuffle has.
EDGES_A_TASK = 200_000


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of each node (larger ones, or smaller ones and itself) to the least of them and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        return linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its least node) for each node of ``edges`` (u, v: numbers).

    Each round is one written table; the number of rounds grows with the
    logarithm of a component's size. A round sends a node's links in one group,
    aggregated before the shuffle for their least node.
    """
    now, path = materialize(edges.select("u", "v").where("u <> v").distinct(), "stars")
    before, tasks = None, max(1, -(-now.count() // EDGES_A_TASK))
    for _ in range(most_rounds):
        now_large = _stars(now, True).where("u <> v")  # repeats of a link go with the small stars' distinct
        after, new_path = materialize(_stars(now_large, False).where("u <> v").distinct().coalesce(tasks), "stars")
        # Settled once each node has one link, to a node that has no smaller one.
        said = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        remove_path(edges.sparkSession, path)
        now, path = after, new_path
        if before == said:
            break
        before = said
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined_components(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """``parts`` (node, component) after more links (u, v): components of components, of the few that the links name."""
    names = {c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part")) for c in ("u", "v")}
    between = edges.join(names["u"], "u", "left").join(names["v"], "v", "left").select(F.coalesce("u_part", "u").alias("u"), F.coalesce("v_part", "v").alias("v"))
    found, _ = materialize(components(between), "joined")
    moved = parts.join(found.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    # Nodes that had no link before are components' names of their own.
    new = found.join(parts, "node", "left_anti")
    return moved.unionByName(new.select("node", "component"))
