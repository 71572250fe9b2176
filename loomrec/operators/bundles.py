"""Bundles of connected records that are too large, dealt among their anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.session import write_through


def split_oversized(members: DataFrame, links: DataFrame, most: int = 40, most_layers: int = 1000) -> DataFrame:
    """component, node, owner: the nearest anchor of each node in components of over ``most`` nodes with two anchors or more.

    ``members``: component, node, rank (null: no anchor; least rank is the foremost). ``links``: src,
    dst, walked both ways and only within a component. Of anchors equally near, the foremost owns a
    node, the least id at equal ranks; a node that no anchor reaches goes to the component's
    foremost. In all other components the owner is null: they stay whole. All components walk
    at once, a layer a round; each layer aggregates to one owner a node and is written to the
    shared folder. An empty table has no rows.
    """
    best = F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", F.col("node").alias("owner"))))
    sizes = members.groupBy("component").agg((F.count(F.lit(1)) > most).alias("large"), F.count("rank").alias("anchors"), best.alias("foremost"))
    split = sizes.where("large and anchors > 1").select("component", "foremost")
    inside = write_through(members.join(split, "component").select("component", "node", "rank"), "split-members")

    both = links.select("src", "dst").union(links.select("dst", "src")).toDF("node", "other").where("node != other").distinct()
    here = inside.select("node", "component")
    held = both.join(here, "node").join(here.toDF("other", "its"), "other").where("component = its").select("node", "other")
    held = write_through(held, "split-links")

    front = inside.where("rank is not null").select("node", F.struct("rank", F.col("node").alias("owner")).alias("own"))
    reached = front
    for _ in range(most_layers):
        step = held.join(front.withColumnRenamed("node", "other"), "other").join(reached.select("node"), "node", "left_anti")
        front = write_through(step.groupBy("node").agg(F.min("own").alias("own")), "split-layer")
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    else:
        raise RuntimeError(f"anchors were still spreading after {most_layers} layers")
    owned = members.select("component", "node").join(split, "component", "left").join(reached, "node", "left")
    return owned.select("component", "node", F.when(F.col("foremost").isNotNull(), F.coalesce("own.owner", "foremost.owner")).alias("owner"))
