"""Odds of weighted selection lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrec.session import write_through



def use_all(p: Column) -> Column:
    """Chance that any of the entries is chosen, as an aggregate."""
    return 1 - F.product(1 - p)


def gate_probability(gates: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """keys, gate: conditions joined by OR are runs, each passes unless all fail; runs are joined by AND.

    ``gates`` has p and or_next (whether the row is joined to the next one by OR).
    """
    order = Window.partitionBy(*keys).orderBy(ordinal)
    starts = F.when(F.coalesce(F.lag("or_next").over(order), F.lit(False)), 0).otherwise(1)
    runs = gates.withColumn("starts", starts).withColumn("run", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(use_all(F.col("p")).alias("g")).groupBy(*keys).agg(F.product("g").alias("gate"))


def first_match(entries: DataFrame, list_id: str, ordinal: str = "ordinal") -> DataFrame:
    """Adds chosen: p times the chance that no entry before passes."""
    before = Window.partitionBy(list_id).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("chosen", F.col("p") * F.coalesce(F.product(1 - F.col("p")).over(before), F.lit(1.0)))


def pool(entries: DataFrame, list_id: str, ordinal: str = "ordinal", estimate_over: int | None = None) -> DataFrame:
    """list, ordinal, p, chosen: the odds that an entry is drawn when one of those that pass is, evenly.

    Exactly p times the mean of 1 / (1 + K), K the number of other entries that pass: its
    distribution is folded together from the other entries' chances, in time that grows with the cube
    of a list's length. Only where ``estimate_over`` is given do lists of more entries than that use
    p / max(1, sum of p) instead, without being gathered.
    """
    whole = Window.partitionBy(list_id)
    sized = entries.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("total", F.sum("p").over(whole))
    is_long = F.lit(False) if estimate_over is None else F.col("n") > estimate_over
    long = sized.where(is_long).select(list_id, ordinal, "p", (F.col("p") / F.greatest(F.lit(1.0), "total")).alias("chosen"))
    lists = sized.where(~is_long).groupBy(list_id).agg(F.array_sort(F.collect_list(F.struct(ordinal, "p"))).alias("all"))
    each = lists.select(list_id, "all", F.posexplode("all").alias("i", "own")).withColumn("rest", F.expr("filter(all, (e, k) -> k != i)"))
    spread = "aggregate(rest, array(1.0D), (d, e) -> transform(sequence(0, size(d)), k -> coalesce(get(d, k), 0.0D) * (1 - e.p) + coalesce(get(d, k - 1), 0.0D) * e.p))"
    mean = f"aggregate(transform({spread}, (x, k) -> x / (k + 1)), 0.0D, (a, x) -> a + x)"
    exact = each.select(list_id, F.col(f"own.{ordinal}").alias(ordinal), F.col("own.p").alias("p"), (F.col("own.p") * F.expr(mean)).alias("chosen"))
    return exact.unionByName(long)


def drop_tables(entries: DataFrame, depth: int = 8) -> DataFrame:
    """list_id, item, presence, expected for every list.

    ``entries``: list_id, ordinal, mode (all, first or pool), target, is_list, p, quantity, list_factor.
    Level by level, a list's table is made of its items and the tables of its lists one level
    down, to ``depth`` levels; so shared lists are worked out once and cycles end. Contributions
    are merged as independent for mode all and as disjoint for modes first and pool. Any other mode
    is an error.
    """
    known = F.when(F.col("mode").isin("all", "first", "pool"), F.col("mode")).otherwise(F.raise_error(F.concat(F.lit("unknown mode "), F.coalesce("mode", F.lit("null")))))
    entries = entries.withColumn("mode", known)
    # Ordinals may repeat; rows that agree in all of these are alike.
    place = F.row_number().over(Window.partitionBy("list_id").orderBy("ordinal", "target", "is_list", "p", "quantity"))
    pooled = entries.where("mode = 'pool'").withColumn("place", place)
    odds_of = pool(pooled, "list_id", "place").select("list_id", "place", "chosen")
    chosen = (
        first_match(entries.where("mode = 'first'"), "list_id")
        .unionByName(pooled.join(odds_of, ["list_id", "place"]).select(*entries.columns, "chosen"))
        .unionByName(entries.where("mode = 'all'").withColumn("chosen", F.col("p")))
    )
    chosen = write_through(chosen.withColumn("quantity", F.when(F.col("quantity") == 0, 1.0).otherwise(F.col("quantity"))), "drop-entries")
    items = chosen.where("not is_list").select("list_id", "mode", "list_factor", F.col("target").alias("item"), F.col("chosen").alias("p"), (F.col("chosen") * F.col("quantity")).alias("e"))
    lists = chosen.where("is_list")
    deepest = 1 if lists.isEmpty() else depth
    table = None
    for _ in range(deepest):
        rows = items
        if table is not None:
            below = table.select(F.col("list_id").alias("target"), "item", "presence", "expected")
            nested = lists.join(below, "target").select("list_id", "mode", "list_factor", "item", (F.col("chosen") * F.col("presence")).alias("p"), (F.col("chosen") * F.col("quantity") * F.col("expected")).alias("e"))
            rows = items.unionByName(nested)
        merged = rows.groupBy("list_id", "item").agg(
            F.first("mode").alias("mode"), F.first("list_factor").alias("factor"), use_all(F.col("p")).alias("independent"), F.least(F.sum("p"), F.lit(1.0)).alias("disjoint"), F.sum("e").alias("e")
        )
        presence = F.when(F.col("mode") != "all", F.col("disjoint")).otherwise(F.col("independent"))
        table = write_through(merged.select("list_id", "item", (presence * F.col("factor")).alias("presence"), (F.col("e") * F.col("factor")).alias("expected")), "drop-level")
    return table


def starved(entries: DataFrame, list_id: str, threshold: float = 0.95) -> DataFrame:
    """First-match entries that pass nearly always and still have others after them, with the number they starve."""
    after = F.count(F.lit(1)).over(Window.partitionBy(list_id).orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing))
    return entries.withColumn("starves", after).where((F.col("p") >= threshold) & (F.col("starves") > 0))


def ladders(entries: DataFrame, list_id: str, least: int = 2) -> DataFrame:
    """Lists of ``least`` gated entries or more: list, ordinal, pool and cascade odds side by side."""
    gated = entries.where("p > 0 and p < 1").withColumn("gates", F.count(F.lit(1)).over(Window.partitionBy(list_id))).where(F.col("gates") >= least)
    a = pool(gated, list_id).withColumnRenamed("chosen", "pool_odds")
    b = first_match(gated, list_id).select(list_id, "ordinal", F.col("chosen").alias("cascade_odds"))
    return a.join(b, [list_id, "ordinal"])
