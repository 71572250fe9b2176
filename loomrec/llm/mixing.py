"""Mixing sources to target weights (native).

Words are packed into blocks of a fixed length, source by source. Every output shard draws its
source counts from a multinomial, one uniform number a slot. Over all shards a source's count then
differs from its quota by about the root of it; what was drawn over a quota, in the last shards, is
given to the sources that fall short, so every source meets its quota. The slots of a source are
numbered across shards and mapped through pseudorandom permutations of the source's block numbers,
a new permutation for each epoch; slots and blocks meet in an equi-join on (source, block number).

A slot costs time in proportion to the number of sources, which may be some thousands.

Defined cases: a null text has size 0 and takes nothing; very long texts are many blocks; null
sources are one source, last in order; a null doc_id is a row like any other; repeated rows each
take their own share; an empty table gives an empty result. Other columns of the input are ignored
by the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrec.llm.common import WHITE_CLASS, WORD_CLASS, let, n_words, stored
from loomrec.session import write_through

#: Rows of a bin, in which running sums are made by one task.
BIN_ROWS = 2000


def source_targets(sized: DataFrame, weights=(5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """One row a source: src (rank by code point, null last), source_size, target.

    Targets share the sum of all sizes by weight, none above ``max_repeat`` times its source's
    size: sorted by cap per weight, the capped sources are a prefix of that order, and what they
    leave is shared by weight among the others. One row a source goes through the two windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("src") - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("src", F.row_number().over(by_name)).withColumn("weight", weight)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * float(max_repeat)
    leveled = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(rest))
        .withColumn("capped", F.col("level") * F.col("weight") >= cap)
        .withColumn("common", F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), "src", "level"))).over(everything)["level"])
    )
    target = F.when(F.col("capped"), cap).otherwise(F.col("common") * F.col("weight"))
    return leveled.select("source", "src", "source_size", "total", target.alias("target"))


def _running(rows: DataFrame, by: list[str], at: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same ``by`` that have a smaller ``at`` (unique numbers there).

    Sums within runs of ``width`` numbers, and the runs' own sums: a task has one run, or one row a run.
    """
    run = F.floor(F.col(at) / width)
    part = rows.withColumn("_run", run)
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    inner = part.withColumn("_inner", F.coalesce(F.sum(value).over(before.partitionBy(*by, "_run")), F.lit(0)))
    above = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    tops = part.groupBy(*by, "_run").agg(F.sum(value).alias("_n")).withColumn("_top", F.coalesce(F.sum("_n").over(above.partitionBy(*by) if by else above), F.lit(0))).drop("_n")
    return inner.join(tops, [*by, "_run"]).withColumn(name, F.col("_top") + F.col("_inner")).drop("_run", "_inner", "_top")


def _shuffled(slots: DataFrame) -> DataFrame:
    """Adds block: slot modulo n_blocks under a pseudorandom permutation of 0..n_blocks-1 chosen by salt.

    Within the first ``pow2`` numbers (the largest power of two up to n_blocks) two halves of the
    bits are shifted by hashes of each other; then all numbers are rotated, first so that the rest
    comes to be among those, then by a hash. All steps are one to one for up to 2^61 blocks.
    """
    n, power, low_n, high_n = (F.col(c) for c in ("n_blocks", "pow2", "low_n", "high_n"))

    def step(block: Column, k: Column) -> Column:
        def mixed(low: Column) -> Column:
            high = (F.call_function("div", block, low_n) + F.pmod(F.xxhash64("salt", low, k, F.lit(1)), high_n)) % high_n
            turn = F.when(k % 2 == 0, power).otherwise(F.pmod(F.xxhash64("salt", k, F.lit(2)), n))
            return (F.when(block < power, high * low_n + low).otherwise(block) + turn) % n

        return let((block % low_n + F.pmod(F.xxhash64("salt", F.call_function("div", block, low_n), k), low_n)) % low_n, mixed)

    halves = slots.withColumn("low_n", F.pow(F.lit(2.0), F.floor(F.round(F.log2(power.cast("double"))) / 2)).cast("long")).withColumn("high_n", F.expr("pow2 div low_n"))
    return halves.withColumn("block", F.aggregate(F.array(*[F.lit(k) for k in range(4)]), F.col("slot") % n, step))


def shard_counts(quotas: DataFrame, shard_blocks: int = 4096, seed: int = 7) -> DataFrame:
    """shard, src, drawn: the multinomial counts of every shard, from src, quota (slots over all shards)."""
    spark = quotas.sparkSession
    n_slots = quotas.agg(F.sum("quota")).first()[0] or 0
    highs = (
        quotas.withColumn("high", F.sum("quota").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy()
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("src", "high"))), lambda x: F.struct(x["src"].alias("src"), (x["high"] / max(n_slots, 1)).alias("high"))).alias("highs"))
    )
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_slots // shard_blocks + 1))
    u = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / float(1 << 53)
    slots = spark.range(0, n_slots, 1, tasks).select(F.floor(F.col("id") / shard_blocks).alias("shard"), u.alias("u")).withColumn("highs", highs.scalar())
    # The first source whose stretch of [0, 1) ends above the number.
    at = F.size(F.filter("highs", lambda x: x["high"] <= F.col("u")))
    return slots.select("shard", F.get("highs", at)["src"].alias("src")).groupBy("shard", "src").agg(F.count(F.lit(1)).alias("drawn"))


def shard_slots(quotas: DataFrame, shard_blocks: int = 4096, seed: int = 7) -> DataFrame:
    """shard, src, slot: every slot of every shard; those of a source are numbered from 0 up to its quota."""
    drawn = write_through(_running(shard_counts(quotas, shard_blocks, seed), ["src"], "shard", "drawn", "slot0"), "mix-drawn")
    limited = drawn.join(quotas.select("src", "quota"), "src").withColumn("own", F.greatest(F.lit(0).cast("long"), F.least(F.col("slot0") + F.col("drawn"), "quota") - F.col("slot0")))
    deal = int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = limited.where("own > 0").repartition(deal, "src", "shard").select("shard", "src", F.explode(F.sequence(F.col("slot0"), F.col("slot0") + F.col("own") - 1)).alias("slot"))
    # What is left over and what is short are as many; both are numbered, and meet by number.
    over = limited.where("own < drawn").groupBy("shard").agg(F.sum(F.col("drawn") - F.col("own")).alias("n"))
    freed = _running(over, [], "shard", "n", "first").select("shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("k"))
    totals = quotas.select("src", "quota").join(drawn.groupBy("src").agg(F.sum("drawn").alias("got")), "src", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    short = totals.where("got < quota").withColumn("n", F.col("quota") - F.col("got"))
    wanted = _running(short, [], "src", "n", "first").select("src", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.struct((F.col("first") + i).alias("k"), (F.col("got") + i).alias("slot")))).alias("w")).select("src", "w.k", "w.slot")
    return own.unionByName(freed.join(wanted.hint("merge"), "k").select("shard", "src", "slot"))


def block_plan(sized: DataFrame, weights=(5, 2, 1), max_repeat: int = 3, block_words: int = 32, shard_blocks: int = 4096, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(targets, spans): what each source shall take, and each document's span of each block with its draws.

    ``sized`` has rid (unique), doc_id, key (a hash of id and text), source, size. A span has rid,
    first (the span's first word in its document), words, draws.
    """
    targets = write_through(source_targets(sized, weights, max_repeat), "mix-targets")
    keyed = sized.where("size > 0").join(targets.select(F.col("source").alias("s"), "src", "source_size"), sized["source"].eqNullSafe(F.col("s"))).drop("s", "source")
    bins = sized.count() // BIN_ROWS + 1
    keyed = keyed.withColumn("bin", F.pmod("key", F.lit(bins)))
    # A running sum within small bins, and the bins' own running sum: no source meets in one task.
    in_bin = Window.partitionBy("src", "bin").orderBy("doc_id", "key", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    within = keyed.withColumn("within", F.coalesce(F.sum("size").over(in_bin), F.lit(0)))
    bases = _running(keyed.groupBy("src", "bin").agg(F.sum("size").alias("n")), ["src"], "bin", "n", "base").drop("n")
    placed = within.join(bases, ["src", "bin"]).withColumn("start", F.col("base") + F.col("within"))
    length = F.lit(block_words).cast("long")
    spans = (
        placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("size") - 1) / length))))
        .withColumn("from", F.greatest("start", F.col("block") * length))
        .select("rid", "src", "block", (F.col("from") - F.col("start")).alias("first"), (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * length) - F.col("from")).alias("words"))
    )
    # A source's quota of slots: its target in blocks, of the source's mean length (its last block may be short).
    upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    quotas = (
        targets.where("source_size > 0")
        .withColumn("n_blocks", F.ceil(F.col("source_size") / length))
        .withColumn("end", F.round(F.sum(F.col("target") * F.col("n_blocks") / F.col("source_size")).over(upto)).cast("long"))
        .withColumn("quota", F.col("end") - F.coalesce(F.lag("end").over(Window.orderBy("src")), F.lit(0)))
        .withColumn("quota", F.least("quota", max_repeat * F.col("n_blocks")))
        .withColumn("pow2", F.pow(F.lit(2.0), F.floor(F.log2(F.col("n_blocks").cast("double")))).cast("long"))
        .select("src", "quota", "n_blocks", "pow2")
    )
    quotas = write_through(quotas, "mix-quotas")
    slots = shard_slots(quotas, shard_blocks, seed).join(quotas.drop("quota"), "src").withColumn("salt", F.xxhash64("src", F.expr("slot div n_blocks"), F.lit(seed)))
    draws = _shuffled(slots).groupBy("src", "block").agg(F.count(F.lit(1)).alias("draws"))
    # The planner knows nothing of how many rows an explode makes, so it is told not to broadcast them.
    return targets, spans.join(draws.hint("merge"), ["src", "block"]).select("rid", "first", "words", "draws")


def _sized(rid: Column, doc_id: Column, source: Column, text: Column) -> list[Column]:
    return [rid.alias("rid"), doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), source.alias("source"), n_words(text).alias("size")]


def mix_report(docs: DataFrame, **params) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    sized = write_through(docs.select(*_sized(F.monotonically_increasing_id(), F.col("doc_id"), F.col("source"), F.col("text"))), "mix-sizes")
    targets, spans = block_plan(sized, **params)
    taken = spans.groupBy("rid").agg(F.sum(F.col("words") * F.col("draws")).alias("taken"))
    mine = targets.select(F.col("source").alias("s"), "source_size", "target")
    return (
        sized.join(mine, sized["source"].eqNullSafe(F.col("s")), "left")
        .join(taken, "rid", "left")
        .select("doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: rows with the columns of ``docs``, a document once for each epoch that takes of it.

    A row of epoch e has the spans drawn e times or more, in the document's order, with the white
    space that follows each word; a whole document keeps its text as it is. Documents of which
    nothing is taken are absent.
    """
    table = stored(docs, "mix-docs")
    sized = write_through(table.select("loc", *_sized(F.monotonically_increasing_id(), F.col("row.doc_id"), F.col("row.source"), F.col("row.text"))), "mix-sizes")
    _, spans = block_plan(sized.drop("loc"), **params)
    of_doc = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("first", "words", "draws"))).alias("spans"), F.max("draws").alias("epochs"))
    located = write_through(of_doc.join(sized.select("rid", "loc", "size").hint("merge"), "rid").drop("rid"), "mix-spans", drop=(sized,))
    epochs = (
        table.join(located.hint("merge"), "loc")
        .withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs"))))
        .withColumn("mine", F.filter("spans", lambda s: s["draws"] >= F.col("epoch")))
    )
    whole = F.aggregate("mine", F.lit(0).cast("long"), lambda a, s: a + s["words"]) == F.col("size")
    pieces = F.regexp_extract_all(F.coalesce(F.col("row.text"), F.lit("")), F.lit(f"({WORD_CLASS}+{WHITE_CLASS}*)"), 1)
    part = let(pieces, lambda p: F.array_join(F.transform("mine", lambda s: F.array_join(F.slice(p, (s["first"] + 1).cast("int"), s["words"].cast("int")), "")), ""))
    text = F.when(whole, F.col("row.text")).otherwise(part)
    return epochs.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
