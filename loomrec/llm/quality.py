"""Quality rules (native): a hashed n-gram log-likelihood ratio, and plain rules on words.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials are counted over
whole tables: the raw corpus, and the trusted target (documents labelled good). A document's score
is the mean over its words and pairs of log(target share / raw share), so length does not matter;
documents below a fixed threshold go.

The bucket weights are one array of ``buckets`` numbers, whatever the size of the corpus. Both
multinomials are smoothed by a fixed share of their totals, so a corpus and its labels repeated
k times give the same weights and verdicts. Five-word windows of a document are compared by 64-bit
hashes.

All that is worked out of a text is one expression that binds the words and their hashes once, so a
filter on any result column may be pushed below it and still splits a text a fixed number of times.

Defined cases: a null text has no words and fails the base rules; texts under five words have no
windows; very long texts are judged whole, in time in proportion to their words (and a sort of the
windows, where some repeat); null doc_ids are never labelled; of several labels of a document the
best counts; without any labelled document all weights are 0 and only the base rules decide;
repeated rows are judged alike; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.llm.common import WHITE, let, words_of

#: The symbols that are counted.
NOT_SYMBOLS = r"[^#*$%&|<>]+"
BUCKETS = 1 << 15
#: Of either multinomial's total, what is spread evenly over the buckets.
SMOOTHING = 0.3
THRESHOLD = -0.11
COUNTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _buckets(hashes: Column, buckets: int) -> Column:
    """Bucket numbers from 1 of the words and the word pairs of a text, from its bound word hashes."""
    n = F.size(hashes)

    def numbered(h: Column) -> Column:
        return (F.pmod(h, F.lit(buckets)) + 1).cast("int")

    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: numbered(F.xxhash64(hashes[i], hashes[i + 1])))
    return F.when(n >= 2, F.concat(F.transform(hashes, numbered), pairs)).otherwise(F.transform(hashes, numbered))


def bucket_weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row, weights: log(target share / raw share) of each bucket, the shares smoothed by ``SMOOTHING``."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("good", F.lit(1))
    # Labels grow with the corpus: the join is a merge join at every size, never a broadcast.
    grams = docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left").select("good", F.explode(let(_hashes(words_of(F.col("text"))), lambda h: _buckets(h, buckets))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("target"))
    every = docs.sparkSession.range(1, buckets + 1).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    listed = filled.groupBy().agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("all"), F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    even = SMOOTHING / buckets
    known = F.transform("all", lambda b: F.log((b["target"] / F.col("targets") + even) / (b["raw"] / F.col("raws") + even)))
    return listed.select(F.when(F.col("targets") > 0, known).otherwise(F.transform("all", lambda b: F.lit(0.0))).alias("weights"))


def _repeated(hashes: Column) -> Column:
    """Words in windows of five that occur twice or more, from a text's bound word hashes."""
    n = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[hashes[i + k] for k in range(5)]))

    def among(found: Column) -> Column:
        # In the order of hashes, equal windows are neighbours.
        marked = F.filter(found, lambda x, k: ((k > 0) & (F.get(found, k - 1)["h"] == x["h"])) | F.coalesce(F.get(found, k + 1)["h"] == x["h"], F.lit(False)))
        at = F.sort_array(F.transform(marked, lambda x: x["i"]))
        # Each window adds its five words less those that the window before it has covered.
        state = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, state, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n")), lambda a: a["n"])

    def counted(w: Column) -> Column:
        in_order = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(in_order, among)).otherwise(F.lit(0))

    return F.when(n >= 5, let(windows, counted)).otherwise(F.lit(0))


def measured(text: Column, weights: Column, buckets: int) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score of a text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    symbols = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_SYMBOLS, ""))

    def of_words(words: Column) -> Column:
        def of_hashes(hashes: Column) -> Column:
            n = F.size(hashes)
            total = F.aggregate(_buckets(hashes, buckets), F.lit(0.0), lambda a, b: a + F.element_at(weights, b))
            return F.struct(
                n.cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                symbols.cast("long").alias("n_symbols"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                _repeated(hashes).cast("long").alias("n_repeat_words"),
                F.when(n > 0, total / (2 * n - 1)).otherwise(F.lit(0.0)).alias("score"),
            )

        return let(_hashes(words), of_hashes)

    return let(words_of(text), of_words)


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, the base columns, base_failed, score and kept."""
    rows = docs.select(F.struct(*keep).alias("row"), "text").withColumn("weights", bucket_weights(docs, labels, buckets).scalar())

    def decided(m: Column) -> Column:
        failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
        return F.struct(*[m[c].alias(c) for c in COUNTED], failed.alias("base_failed"), (~failed & (m["score"] >= threshold)).alias("kept"), m["score"].alias("score"))

    # The verdict is part of the same value, so that a filter on it repeats that value once at most.
    return rows.select("row", let(measured(F.col("text"), F.col("weights"), buckets), decided).alias("m")).select("row.*", "m.*")


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns."""
    packed = docs.select(F.struct("*").alias("doc"), "doc_id", "text")
    return judge(packed, labels, keep=("doc",), **params).where("kept").select("doc.*")
