"""Snapshot differences and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.operators.lookup import numbered


def snapshot_diff(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, status (added, removed, changed), one full outer join; unchanged rows are left out before anything else looks at them."""
    left = a.select(F.col(key), F.struct(*fields).alias("old"))
    right = b.select(F.col(key), F.struct(*fields).alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return left.join(right, key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("status", status)


def changed_keys(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key: those that ``snapshot_diff`` finds, from the rows of both snapshots with sides (1 old, 2 new, 3 both).

    A key is unchanged if it is on both sides with the same fields throughout; a null key is like no other. Rows are
    shuffled by the key and sorted once, and no list of a key's rows is held.
    """
    least, most = F.min(F.struct(*fields)), F.max(F.struct(*fields))
    each = rows.repartition(key).groupBy(key).agg(F.bit_or("sides").alias("sides"), least.alias("least"), most.alias("most"))
    return each.where((F.col("sides") != 3) | ~F.col("least").eqNullSafe(F.col("most")) | F.col(key).isNull()).select(key)


def field_changes(diff: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, path, from, to of each field that differs in changed rows."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("path"), F.col(f"old.{f}").cast("string").alias("from"), F.col(f"new.{f}").cast("string").alias("to")) for f in fields]))
    rows = diff.where("status = 'changed'").select(key, *[c for c in diff.columns if c not in (key, "old", "new", "status")], each.alias("c"))
    return rows.where(~F.col("c.from").eqNullSafe(F.col("c.to"))).select(*[c for c in rows.columns if c != "c"], "c.*")


def set_difference(a: DataFrame, b: DataFrame, key: str, item: str) -> DataFrame:
    """key, item, removed, added: multiset difference of the items of each key, as counts."""
    counts = a.select(key, item, F.lit(1).alias("n")).unionByName(b.select(key, item, F.lit(-1).alias("n"))).groupBy(key, item).agg(F.sum("n").alias("n")).where("n != 0")
    return counts.select(key, item, F.greatest("n", F.lit(0)).alias("removed"), F.greatest(-F.col("n"), F.lit(0)).alias("added"))


def calibrated_defaults(appearances: DataFrame, real_edits: DataFrame, least: int = 100) -> DataFrame:
    """leaf, value, n: values that appear ``least`` times or more and are nowhere a real edit."""
    often = appearances.groupBy("leaf", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return often.join(real_edits.select("leaf", "value").distinct(), ["leaf", "value"], "left_anti")


def suppress(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """Changes without those that a (leaf, value) rule explains."""
    return changes.join(rules.select("leaf", "value"), ["leaf", "value"], "left_anti")


def common_changes(changes: DataFrame, least: int = 5) -> DataFrame:
    """The same change of the same type in ``least`` records or more, numbered CC001 and on in order."""
    groups = changes.groupBy("sig", "path", "from", "to").agg(F.count_distinct("form_id").alias("n")).where(F.col("n") >= least)
    order = ["sig", "path", F.col("from").asc_nulls_first(), F.col("to").asc_nulls_first()]
    return numbered(groups, order, "_number").withColumn("cc_id", F.format_string("CC%03d", "_number")).drop("_number")


def rollout_shapes(changes: DataFrame, least: int = 20, examples: int = 3) -> DataFrame:
    """sig, shape (the changed paths of a record), n records, and the least few of them."""
    from loomrec.operators.graph import top_per_group

    shaped = changes.groupBy("sig", "form_id").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("shape"))
    counts = shaped.groupBy("sig", "shape").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    shown = top_per_group(shaped, ["sig", "shape"], ["form_id"], examples).groupBy("sig", "shape").agg(F.array_join(F.array_sort(F.collect_list("form_id")), ",").alias("examples"))
    return counts.join(shown, ["sig", "shape"])


def change_kind(from_: str, to: str) -> F.Column:
    """added, removed or changed, from the two sides of a field change."""
    return F.when(F.col(from_).isNull(), "added").when(F.col(to).isNull(), "removed").otherwise("changed")


def redundant_counts(changes: DataFrame) -> DataFrame:
    """Adds redundant: a scalar whose path ends in Count and that goes from and to what an array of the same record's lengths do (count_from, count_to)."""
    lengths = changes.where("count_from is not null").selectExpr("form_id as f", "cast(count_from as string) as a", "cast(count_to as string) as b").distinct()
    hit = (F.col("form_id") == F.col("f")) & (F.col("from") == F.col("a")) & (F.col("to") == F.col("b"))
    return changes.join(lengths, hit, "left").withColumn("redundant", F.col("path").endswith("Count") & F.col("f").isNotNull()).drop("f", "a", "b")
