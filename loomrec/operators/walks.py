"""Walks over the reference graph with their paths, and what is read from what they reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.operators.graph import span, top_per_group
from loomrec.operators.lookup import ranked_page
from loomrec.session import write_through


def walk(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """form_id, depth, origin, path: the seeds at depth 0, and what references them within ``depth`` hops.

    Each node stands at its least depth, with the least seed that reaches it there and the least
    path from that seed, an array of ids. A hop is a join of the frontier with the edges into it,
    an aggregation that leaves one row a node, and an anti-join with the one table of what was
    reached before; it is written to the shared folder.
    """
    reached = write_through(seeds.select("form_id").distinct().select("form_id", F.lit(0).cast("long").alias("depth"), F.col("form_id").alias("origin"), F.array("form_id").alias("path")), "walk")
    front = reached
    for hop in range(1, depth + 1):
        step = (
            edges.select(F.col("src").alias("form_id"), "dst")
            .join(front.select(F.col("form_id").alias("dst"), "origin", "path"), "dst")
            .groupBy("form_id")
            .agg(F.min(F.struct("origin", "path")).alias("least"))
            .join(reached.select("form_id"), "form_id", "left_anti")
            .select("form_id", F.lit(hop).cast("long").alias("depth"), "least.origin", F.array_append("least.path", F.col("form_id")).alias("path"))
        )
        front = write_through(step, "walk-hop")
        if front.isEmpty():
            break
        reached = write_through(reached.unionByName(front), "walk", drop=(reached,))
    return reached


def walk_page(rows: DataFrame, order: list | None = None, offset: int = 0, limit: int = 0) -> DataFrame:
    """A page of a walk, by depth and id unless told otherwise, with rank."""
    return ranked_page(rows, order or ["depth", "form_id"], offset, limit)


def walk_figures(rows: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """depth, n, frontier_remaining, depth_capped for each depth of a walk of ``depth`` hops.

    ``frontier_remaining`` is what one more hop from this depth would reach that the walk has not;
    ``depth_capped`` tells at the last depth that it is not empty, so the walk was cut there.
    """
    ends = rows.select(F.col("form_id").alias("dst"), "depth")
    beyond = edges.select("src", "dst").join(ends, "dst").select(F.col("src").alias("form_id"), "depth").distinct().join(rows.select("form_id"), "form_id", "left_anti")
    left = beyond.groupBy("depth").agg(F.count(F.lit(1)).alias("frontier_remaining"))
    out = rows.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).join(left, "depth", "left").withColumn("frontier_remaining", F.coalesce("frontier_remaining", F.lit(0)))
    return out.withColumn("depth_capped", (F.col("depth") == depth) & (F.col("frontier_remaining") > 0))


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int = 12) -> DataFrame:
    """from_id, to_id, hops, path of each distinct pair: the least of its shortest paths as an array of ids; null beyond ``most`` hops.

    Half the hops are walked from the starts and half back from the ends, and the pairs are joined
    where the walks meet; a walk keeps one path for each start and node. Edges are left out beforehand as in ``graph.path_hops``.
    """

    def reach(end: str, here: str, there: str, hops: int, trail, met: DataFrame | None = None) -> DataFrame:
        front = pairs.select(end, F.col(end).alias("node"), F.array(end).alias("trail")).distinct()
        front = levels = write_through(front.withColumn("d", F.lit(0).cast("long")), "paths")
        for hop in range(1, hops + 1):
            near = edges.select(F.col(here).alias("node"), F.col(there).alias("next")).where(span(front, "node"))
            if met is not None and hop == most // 2:
                near = near.where(span(met.select(F.col("node").alias("next")), "next"))
            step = front.drop("d").join(near, "node").select(end, F.col("next").alias("node"), trail.alias("trail"))
            new = step.groupBy(end, "node").agg(F.min("trail").alias("trail")).join(levels.select(end, "node"), [end, "node"], "left_anti").withColumn("d", F.lit(hop).cast("long"))
            front = write_through(new, "path-hop")
            if front.isEmpty():
                break
            levels = levels.unionByName(front)
        return levels

    ahead = reach("from_id", "src", "dst", (most + 1) // 2, F.array_append("trail", F.col("next")))
    back = reach("to_id", "dst", "src", most // 2, F.array_prepend("trail", F.col("next")), ahead).withColumnsRenamed({"d": "e", "trail": "rest"})
    whole = F.struct((F.col("d") + F.col("e")).alias("hops"), F.concat("trail", F.slice("rest", 2, F.size("rest"))).alias("path"))
    met = pairs.distinct().join(ahead, "from_id").join(back, ["to_id", "node"]).groupBy("from_id", "to_id").agg(F.min(whole).alias("w"))
    return pairs.distinct().join(met, ["from_id", "to_id"], "left").select("from_id", "to_id", "w.hops", "w.path")


def consumers_by_type(edges: DataFrame, targets: DataFrame, most: int = 25) -> DataFrame:
    """target, src_sig, src, rank: of each type the least ``most`` records that reference a target."""
    near = edges.join(targets.select(F.col("form_id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("target"), "src_sig", "src").distinct()
    return top_per_group(near, ["target", "src_sig"], ["src"], most)


def marked_edges(edges: DataFrame, universe: DataFrame, once: bool = False) -> DataFrame:
    """The edges from records of ``universe`` (form_id), with inside: whether their targets are of it too.

    Edges have dst, or targets, an array of them, which is taken apart once its record is known to be of the universe.
    The ids are written to the shared folder first, so what they come from is worked out once. They are distinct, so an
    inner join keeps an edge once; unlike a semi-join it is one for all tables that edges are the union of.
    With ``once``, equal edges become one where they lie together by src, and only src and dst are kept.
    """
    ids = write_through(universe.select("form_id").distinct(), "universe")
    own = edges.join(ids.withColumnRenamed("form_id", "src"), "src")
    if "targets" in edges.columns:
        own = own.select("src", F.explode("targets").alias("dst")).where("dst is not null")
    if once:
        own = own.select("src", "dst").distinct()
    to = ids.select(F.col("form_id").alias("dst"), F.lit(True).alias("inside"))
    return own.join(to, "dst", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def split_edges(edges: DataFrame, universe: DataFrame, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """(inside, context): the edges from records of ``universe`` (form_id), by whether their targets are of it too."""
    marked = marked_edges(edges, universe, once)
    return marked.where("inside").drop("inside"), marked.where("not inside").drop("inside")


def incidence(context: DataFrame, members: DataFrame | Column) -> DataFrame:
    """context, bundle, n: how many members (form_id, bundle) of each bundle reference a record outside.

    ``context`` has an edge once, as ``split_edges`` gives it. Where the bundle follows from the member's id, src,
    ``members`` is that column, and nothing is joined.
    """
    if isinstance(members, Column):
        near = context.select(F.col("dst").alias("context"), members.alias("bundle"))
    else:
        near = context.select(F.col("dst").alias("context"), F.col("src").alias("form_id")).join(members, "form_id")
    return near.groupBy("context", "bundle").agg(F.count(F.lit(1)).alias("n"))


def without_live_referencer(candidates: DataFrame, edges: DataFrame, live: list[str], depth: int = 4) -> DataFrame:
    """Candidates (form_id) that no record of a ``live`` type references within ``depth`` hops.

    Walked from the live records along their references, so a candidate costs nothing until it is reached.
    """
    front = edges.where(F.col("src_sig").isin(live)).select(F.col("dst").alias("form_id")).distinct()
    reached = front = write_through(front, "live")
    for _ in range(depth - 1):
        step = edges.join(front.withColumnRenamed("form_id", "src"), "src", "left_semi").select(F.col("dst").alias("form_id")).distinct()
        front = write_through(step.join(reached, "form_id", "left_anti"), "live-hop")
        if front.isEmpty():
            break
        reached = write_through(reached.union(front), "live", drop=(reached,) if reached is not front else ())
    return candidates.join(reached, "form_id", "left_anti")


def enriched(rows: DataFrame, id_column: str, records: DataFrame) -> DataFrame:
    """Adds target (form_id, sig, editor_id, name), the record that an id stands for; null where there is none."""
    stub = records.select(F.col("form_id").alias("_id"), F.struct("form_id", "sig", "editor_id", "name").alias("target"))
    return rows.join(stub, F.col(id_column) == F.col("_id"), "left").drop("_id")
