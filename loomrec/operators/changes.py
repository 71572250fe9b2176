"""What change rows are read for: cut markers, stale texts, names of references, columns side by side."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrec.functions.scalar import has_number


def marker_of(editor_id: Column, markers: list[str], doubtful: tuple[str, ...] = ("POST",)) -> Column:
    """struct (marker, confidence) of the first marker that an editor id carries; null if none does.

    A marker counts in upper or lower case: with an underscore in front of the rest (high), directly
    before a capital or digit (medium), or after the last underscore (low). A doubtful marker also
    starts ordinary words, so it counts a step lower and never at the end.
    """
    found = []
    for marker in markers:
        weak = marker in doubtful
        word = f"(?:{re.escape(marker)}|{re.escape(marker.lower())})"
        shapes = [(f"^{word}_", "medium" if weak else "high"), (rf"^{word}[\p{{Lu}}\p{{Nd}}]", "low" if weak else "medium")]
        if not weak:
            shapes.append((rf"_{word}\z", "low"))
        found += [F.when(editor_id.rlike(shape), F.struct(F.lit(marker).alias("marker"), F.lit(sure).alias("confidence"))) for shape, sure in shapes]
    return F.coalesce(*found)


def cut_kind(editor_id: Column, previous: Column, markers: list[str]) -> Column:
    """still_cut, newly_deprecated or added_cut of a marked record by its editor id before; null if it is not marked."""
    kind = F.when(previous.isNull(), "added_cut").when(marker_of(previous, markers).isNotNull(), "still_cut").otherwise("newly_deprecated")
    return F.when(marker_of(editor_id, markers).isNotNull(), kind)


def _number(side: str) -> Column:
    return F.col(side).cast("string").try_cast("double")


def text_only_changes(changes: DataFrame, text_path: str = "description") -> DataFrame:
    """form_id of records whose text changed while no number did. Changes: form_id, path, from, to."""
    is_text = F.col("path") == text_path
    numeric = ~is_text & (_number("from").isNotNull() | _number("to").isNotNull())
    flags = changes.groupBy("form_id").agg(F.bool_or(is_text).alias("text"), F.bool_or(numeric).alias("number"))
    return flags.where("text and not number").select("form_id")


def stale_numbers(changes: DataFrame, texts: DataFrame, text_path: str = "description") -> DataFrame:
    """form_id, path, was: numbers that changed while the record's text (form_id, text), itself unchanged, still quotes them."""
    numbers = changes.select("form_id", "path", _number("from").alias("was")).where("was is not null")
    rewritten = changes.where(F.col("path") == text_path).select("form_id")
    quoted = numbers.join(rewritten, "form_id", "left_anti").join(texts.select("form_id", "text"), "form_id")
    return quoted.where(has_number(F.col("text"), F.col("was"))).select("form_id", "path", "was")


def strip_fields(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """Changes without those that a rule (sig, path) names; a rule with a null sig is for all types."""
    rule = rules.select(F.col("sig").alias("for_sig"), F.col("path").alias("for_path")).distinct()
    return changes.join(rule, (F.col("path") == F.col("for_path")) & F.coalesce(F.col("sig") == F.col("for_sig"), F.col("for_sig").isNull()), "left_anti")


#: Fields (type, name) that appear by themselves when a record is saved again.
APPEARING = [("INFO", "Previous INFO")]


def without_restamps(changes: DataFrame, appearing: list[tuple[str, str]] = APPEARING) -> DataFrame:
    """Changes (sig, path, from and to as JSON texts) without what saving a record again explains.

    That is raw bytes, all zero, on one side with nothing on the other, and the fields of ``appearing`` (type,
    last name of the path) where nothing was before. A null side, SQL or JSON, is nothing.
    """
    value = lambda side: F.when(F.col(side) != "null", F.try_parse_json(side))
    zero = lambda side: F.coalesce(F.try_variant_get(value(side), "$._raw", "boolean") & F.try_variant_get(value(side), "$.hex", "string").rlike(r"^(00)*\z"), F.lit(False))
    nothing = lambda side: value(side).isNull()
    tabled = F.lit(False)
    for sig, name in appearing:
        tabled = tabled | ((F.col("sig") == sig) & (F.element_at(F.split("path", r"\."), -1) == name))
    noise = (nothing("from") & zero("to")) | (nothing("to") & zero("from")) | (nothing("from") & ~nothing("to") & F.coalesce(tabled, F.lit(False)))
    return changes.where(~noise)


def reference_names(ids: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """form_id, sig, editor_id, name of every distinct id of ``ids`` that either snapshot has; the new one's record if both do."""
    told = F.struct("sig", "editor_id", "name")
    fresh, stale = new.select("form_id", told.alias("n")), old.select("form_id", told.alias("o"))
    named = ids.select("form_id").distinct().join(fresh, "form_id", "left").join(stale, "form_id", "left")
    return named.withColumn("r", F.coalesce("n", "o")).where("r is not null").select("form_id", "r.*")


def aligned_fields(snapshots: dict[str, DataFrame], key: str, fields: list[str]) -> DataFrame:
    """key, path, a column of text for each snapshot, conflict: all snapshots' fields side by side, in one shuffle.

    A conflict is a field that differs, or a record that some snapshot lacks. Keys are unique
    within a snapshot; a null field is like one that is not there.
    """
    rows = None
    for name, frame in snapshots.items():
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("path"), F.col(f).cast("string").alias("value")) for f in fields]))
        one = frame.select(key, F.lit(name).alias("snapshot"), each.alias("e")).select(key, "snapshot", "e.*")
        rows = one if rows is None else rows.unionByName(one)
    columns = [F.max(F.when(F.col("snapshot") == name, F.col("value"))).alias(name) for name in snapshots]
    wide = rows.groupBy(key, "path").agg(*columns, F.count(F.lit(1)).alias("held"))
    first, *others = snapshots
    conflict = F.col("held") < len(snapshots)
    for name in others:
        conflict = conflict | ~F.col(first).eqNullSafe(F.col(name))
    return wide.select(key, "path", *snapshots, conflict.alias("conflict"))


def lints_by_group(members: DataFrame, lints: DataFrame, group: str) -> DataFrame:
    """group, form_id, rule, number: the findings on each group's members, numbered within it; a group without findings has one row of nulls."""
    found = members.join(lints.select("form_id", "rule"), "form_id").select(group, "form_id", "rule")
    numbered = found.withColumn("number", F.row_number().over(Window.partitionBy(group).orderBy("rule", "form_id")).cast("long"))
    return members.select(group).distinct().join(numbered, group, "left")


def first_category(members: DataFrame, group: str, categories: list[tuple[str, Column]], otherwise: str) -> DataFrame:
    """group, category: the first category of the list that any member of the group fits."""
    fits = F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(i)) for i, (_, test) in enumerate(categories)])
    names = F.array(*[F.lit(name) for name, _ in categories])
    best = members.groupBy(group).agg(F.min(fits).alias("best"))
    return best.select(group, F.coalesce(F.get(names, F.col("best")), F.lit(otherwise)).alias("category"))


def merge_assessment(tiers: DataFrame, assessment: DataFrame, key: str, open_tier: str = "ambiguous") -> DataFrame:
    """Tiers, with the assessed one (key, assessed) where the tier was left open."""
    both = tiers.join(assessment.select(key, "assessed"), key, "left")
    settled = F.when(F.col("tier") == open_tier, F.coalesce("assessed", "tier")).otherwise(F.col("tier"))
    return both.withColumn("tier", settled).drop("assessed")
