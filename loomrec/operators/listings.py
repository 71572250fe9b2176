"""Small relations over changes, lists and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_type(diff: DataFrame, sig: str) -> DataFrame:
    """The rows of a snapshot difference (old, new) whose record is of one type."""
    return diff.where(F.coalesce("new.sig", "old.sig") == sig)


def suppressed_counts(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """sig, n: how many changes (leaf, value) the rules explain, by type."""
    return changes.join(rules.select("leaf", "value").distinct(), ["leaf", "value"], "left_semi").groupBy("sig").agg(F.count(F.lit(1)).alias("n"))


def membership_changes(pairs: DataFrame, key: str) -> DataFrame:
    """key, removed, added: what only one of two arrays (old, new) holds, sorted, each value once; alike pairs are left out."""
    sides = pairs.select(key, F.array_sort(F.array_except("old", "new")).alias("removed"), F.array_sort(F.array_except("new", "old")).alias("added"))
    return sides.where("size(removed) + size(added) > 0")


def first_seen(rows: DataFrame, keys: list[str], item: str, order: list[str]) -> DataFrame:
    """keys, item, rank: each item once, in the order of its first row."""
    from pyspark.sql import Window

    first = rows.groupBy(*keys, item).agg(F.min(F.struct(*order)).alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("at", item)).cast("long")).drop("at")


def dereferenced(entries: DataFrame, globals_: DataFrame, id_column: str, value: str) -> DataFrame:
    """``value`` of the entries, or that of the global (form_id, value) they name instead."""
    named = globals_.select(F.col("form_id").alias("_id"), F.col("value").alias("_value"))
    return entries.join(named, F.col(id_column) == F.col("_id"), "left").withColumn(value, F.coalesce("_value", value)).drop("_id", "_value")


def blocked_lists(entries: DataFrame) -> DataFrame:
    """list_id, n_blocked, all_blocked of lists with entries (quantity, chance_none) that never drop."""
    blocked = (F.col("quantity") == 0) | (F.col("chance_none") >= 100)
    return entries.groupBy("list_id").agg(F.count_if(blocked).alias("n_blocked"), F.bool_and(blocked).alias("all_blocked")).where("n_blocked > 0")


def uniform_picks(lists: DataFrame, pattern: str, least: int = 3) -> DataFrame:
    """Lists (name, n_entries, flags) named like a bundle that pick evenly: ``least`` entries or more, no flag set."""
    return lists.where(F.col("name").rlike(pattern) & (F.col("n_entries") >= least) & (F.coalesce("flags", F.lit(0)) == 0))


def same_anchor(members: DataFrame) -> DataFrame:
    """form_id, bundle: bundles (form_id, bundle, anchor) of one anchor are one, under the least name; a member stands once."""
    names = members.groupBy("anchor").agg(F.min("bundle").alias("least"))
    return members.join(names, "anchor").select("form_id", F.col("least").alias("bundle")).distinct()


def bundle_figures(members: DataFrame) -> DataFrame:
    """n_bundles, n_singletons, n_uncategorised over bundles (bundle, form_id, category)."""
    each = members.groupBy("bundle").agg(F.count_distinct("form_id").alias("n"), F.max("category").alias("category"))
    return each.agg(F.count(F.lit(1)).alias("n_bundles"), F.count_if(F.col("n") == 1).alias("n_singletons"), F.count_if(F.col("category").isNull()).alias("n_uncategorised"))
