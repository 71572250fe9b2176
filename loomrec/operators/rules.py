"""Rules and audits: ordered relations, tiers, anchors, lints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.operators.lookup import numbered


def first_rule(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for test, name in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), name).otherwise(out)
    return out


def priority(value: Column, order: list[str]) -> Column:
    """Greater is earlier in the list; 0 for what is not in it."""
    return first_rule([(value == v, str(len(order) - i)) for i, v in enumerate(order)], "0").cast("int")


def anchors(members: DataFrame, group: str) -> DataFrame:
    """group, anchor: the member of greatest (priority, weight, degree), least id on ties."""
    return members.groupBy(group).agg(F.max_by("form_id", F.struct("priority", "weight", "degree", -F.col("form_id"))).alias("anchor"))


def dangling(edges: DataFrame, *universes: DataFrame) -> DataFrame:
    """Edges to ids that none of the universes (form_id) has."""
    out = edges
    for u in universes:
        out = out.join(u.select(F.col("form_id").alias("dst")), "dst", "left_anti")
    return out


def unreferenced(records: DataFrame, edges: DataFrame) -> DataFrame:
    return records.join(edges.select(F.col("dst").alias("form_id")), "form_id", "left_anti")


def lint_rows(*found: tuple[str, DataFrame]) -> DataFrame:
    """rule, form_id of every rule's findings, numbered L0001 and on in order."""
    rows = None
    for rule, frame in found:
        one = frame.select(F.lit(rule).alias("rule"), "form_id")
        rows = one if rows is None else rows.unionByName(one)
    return numbered(rows, ["rule", "form_id"], "_number").withColumn("lint_id", F.format_string("L%04d", "_number")).drop("_number")
