"""The reference graph: walks, paths, carriers, digests, relations, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrec.session import write_through


def referencers(edges: DataFrame, seeds: DataFrame, depth: int, tags: bool = False) -> DataFrame:
    """form_id, depth, origin[, tags]: what references the seeds within ``depth`` hops, each at its least depth.

    ``seeds`` has form_id, and tag if ``tags``. A seed is no referencer. The origin is the least
    seed that reaches a node at that depth; tags of all seeds that do are united. Each hop is a
    join of the frontier with the edges and an anti-join with what was reached before, and is
    written to the shared folder, so a hop costs one scan and survives lost executors.
    """
    tag = F.array("tag") if tags else F.array().cast("array<string>")
    front = seeds.select("form_id", F.col("form_id").alias("origin"), tag.alias("tags"))
    seen = write_through(front.select("form_id").distinct(), "walk-seen")
    found = None
    for hop in range(1, depth + 1):
        step = (
            edges.select(F.col("src").alias("form_id"), "dst")
            .join(front.withColumnRenamed("form_id", "dst"), "dst")
            .join(seen, "form_id", "left_anti")
            .groupBy("form_id")
            .agg(F.min("origin").alias("origin"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"))
        )
        front = write_through(step, "walk-hop")
        row = front.withColumn("depth", F.lit(hop).cast("long"))
        found = row if found is None else found.unionByName(row)
        if hop < depth:
            seen = seen.union(front.select("form_id"))
            if front.isEmpty():
                break
    return found.select("form_id", "depth", "origin", *(["tags"] if tags else []))


def walk_statistics(rows: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """depth, n for each hop."""
    return rows.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def span(rows: DataFrame, column: str) -> Column:
    """Whether a column named ``column`` lies between the least and the greatest value that ``rows`` has of it.

    Ids of a type lie together, so this leaves out most edges that a join with ``rows`` would drop, before they are shuffled.
    """
    low, high = rows.agg(F.min(column), F.max(column)).first()
    return F.lit(False) if low is None else F.col(column).between(low, high)


def path_hops(edges: DataFrame, pairs: DataFrame, most: int = 12) -> DataFrame:
    """from_id, to_id, hops of each pair: least number of references from one to the other, null beyond ``most``.

    Walks forward from the distinct starts and back from the distinct ends, half the hops each, and
    joins the pairs where the walks meet. Edges outside the span of a hop's front are left out before its join; those of
    the last hop back also if they lead outside the span of what the walk forward reached.
    """

    def reach(end: str, here: str, there: str, hops: int, met: DataFrame | None = None) -> DataFrame:
        front = levels = write_through(pairs.select(end, F.col(end).alias("node")).distinct().withColumn("d", F.lit(0).cast("long")), "path-hop")
        for hop in range(1, hops + 1):
            near = edges.select(F.col(here).alias("node"), F.col(there).alias("next")).where(span(front, "node"))
            if met is not None and hop == most // 2:
                near = near.where(span(met.select(F.col("node").alias("next")), "next"))
            step = front.join(near, "node").select(end, F.col("next").alias("node")).distinct()
            new = step.join(levels, [end, "node"], "left_anti").withColumn("d", F.lit(hop).cast("long"))
            front = write_through(new, "path-hop")
            if front.isEmpty():
                break
            levels = levels.unionByName(front)
        return levels

    ahead = reach("from_id", "src", "dst", (most + 1) // 2)
    back = reach("to_id", "dst", "src", most // 2, ahead).withColumnRenamed("d", "e")
    met = pairs.distinct().join(ahead, "from_id").join(back, ["to_id", "node"]).groupBy("from_id", "to_id").agg(F.min(F.col("d") + F.col("e")).alias("hops"))
    return pairs.join(met, ["from_id", "to_id"], "left")


def digest(rows: DataFrame, key: str = "src_sig", item: str = "src", samples: int = 5) -> DataFrame:
    """For each group its number of distinct items and the least few of them; the lists never hold more than ``samples``."""
    distinct = rows.select(key, item).distinct()
    least = distinct.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(item))).where(F.col("r") <= samples)
    shown = least.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("samples"))
    return distinct.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(shown, key)


def top_per_group(rows: DataFrame, group: list[str], order: list, most: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col(name) <= most)


def first_edges(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Edges of both lists, the forward one where both have a pair."""
    both = forward.withColumn("is_reverse", F.lit(0)).unionByName(backward.withColumn("is_reverse", F.lit(1)))
    return both.groupBy("src", "dst").agg(F.min_by("relation", "is_reverse").alias("relation"), F.min("is_reverse").alias("is_reverse"))


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    return both.toDF("node", "other").where("node != other").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame, nodes: DataFrame, hub_degree: int = 8, most_rounds: int = 50) -> DataFrame:
    """node, component (the least node it is connected with), where nodes of more than ``hub_degree`` neighbours connect nothing.

    Least labels travel along links, and each round also jumps to the label's own label, so rounds
    grow with the logarithm of a chain's length. Rounds are written to the shared folder.
    """
    hubs = degrees(edges).where(F.col("degree") > hub_degree).select("node")
    links = edges.select("src", "dst").join(hubs.toDF("src"), "src", "left_anti").join(hubs.toDF("dst"), "dst", "left_anti")
    links = write_through(links.select("src", "dst").union(links.select("dst", "src")).toDF("node", "other").distinct(), "component-links")
    labels = write_through(nodes.select("node", F.col("node").alias("component")), "component-labels")
    for _ in range(most_rounds):
        offered = links.join(labels.toDF("other", "c"), "other").groupBy("node").agg(F.min("c").alias("c"))
        lower = labels.join(offered, "node", "left").select("node", "component", F.least("component", F.coalesce("c", "component")).alias("new"))
        jumped = lower.join(labels.toDF("new", "next"), "new", "left").select("node", F.least("new", F.coalesce("next", "new")).alias("component"), (F.col("component") != F.least("new", F.coalesce("next", "new"))).alias("changed"))
        out = write_through(jumped, "component-labels")
        labels = out.select("node", "component")
        if out.where("changed").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
