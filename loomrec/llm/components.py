"""Connected components over a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.llm.common import spread_join
from loomrec.session import drop_path, write_through


def connected(links: DataFrame, most_steps: int = 120) -> DataFrame:
    """node, component (the least node reachable) for every node of ``links`` (a, b: long), a table that is read several times.

    Steps hang every node's larger neighbours on its least neighbour (large star) and its smaller
    ones (small star) in turn, until each component is a star around its least node: a number of
    steps that grows with the logarithm of the nodes. Whether it is shows in the table of least
    neighbours that a step begins with, so links that are stars take no step. A node with very many
    neighbours is a group of rows that aggregates to one least id before the shuffle; its rows meet
    that id by a broadcast of such hubs, a thousand at the most, and neighbours are never gathered.
    Steps are written to the shared folder, each deleted when the next one is there. Self links and
    repeated links do no harm; an empty table has no nodes.
    """
    spark = links.sparkSession
    edges, mine = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), ()
    below, above = F.when(F.col("v") < F.col("node"), F.col("v")), F.when(F.col("v") > F.col("node"), F.col("v"))
    for step in range(most_steps):
        both = edges.union(edges.select("v", "u")).toDF("node", "v")
        counted = both.groupBy("node").agg(F.min(below).alias("least"), F.max(below).alias("most"), F.count(below).alias("smaller"), F.count(above).alias("larger"))
        loose = F.col("least").isNotNull() & ((F.col("least") != F.col("most")) | (F.col("larger") > 0))
        nodes = write_through(counted.select("node", F.coalesce("least", "node").alias("component"), "smaller", "larger", loose.alias("loose")), "star-nodes")
        if nodes.where("loose").isEmpty():
            for old in mine:
                drop_path(spark, old._scratch_path)
            out = nodes.select("node", "component")
            out._scratch_path = nodes._scratch_path
            return out
        total = F.lit(edges.count())
        if step % 2 == 0:
            hung = spread_join(edges.select(F.col("v").alias("node"), "u"), nodes, "node", "larger", total).select("u", F.col("component").alias("v"))
        else:
            met = spread_join(edges.select(F.col("u").alias("node"), "v"), nodes, "node", "smaller", total).select("v", "component").where("v != component")
            hung = met.union(nodes.where("node != component").select("node", "component")).distinct().toDF("u", "v")
        edges = write_through(hung, "star", drop=(nodes, *mine))
        mine = (edges,)
    raise RuntimeError(f"components did not settle in {most_steps} steps")
