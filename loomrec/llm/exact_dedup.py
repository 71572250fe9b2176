"""Exact deduplication (native): a stream of digests into keyed state on disk.

Texts are equal when they are identical without white space. Digests, stable identifiers and
content locators (a file and the row's number in it) are streamed into a keyed aggregation whose
state (RocksDB, no watermark, so nothing expires) holds a count and the best row of each digest.
Hits are then checked on full bytes: least and greatest normalised text of a digest must be one (of
a digest without a second row they are). Where they differ the rows are grouped by the normalised
text itself.

Defined cases: a null text counts as empty; very long texts are compared whole; of equal texts the
one with most code points stays, then the smallest doc_id, null doc_ids last, then the first row;
repeated rows are members of their group like any other; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrec.llm.common import WHITE_CLASS, is_table, stored
from loomrec.session import drop_path, fresh_path, write_through

#: Settings of the state: in RocksDB files below the checkpoint, with bounded memory.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # Many small stores: room is not set aside ahead of the writes.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.metricsEnabled": "false",
}


@contextmanager
def _conf(spark: SparkSession, settings: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_CLASS + "+", "")


def digest_ledger(spark: SparkSession, source: str, schema, files_per_batch: int = 64, checkpoint: str | None = None) -> DataFrame:
    """Stream the digest rows under ``source`` into keyed state; returns digest, n, keep_id and keep_rid of every key.

    With the same ``checkpoint`` a later call reads only files that are new, against the kept state.
    """
    own = checkpoint is None
    checkpoint = checkpoint or fresh_path(spark, "dedup-state")
    updates = f"{checkpoint}-updates"
    rank = F.struct((-F.col("n_chars")).alias("chars"), F.col("doc_id").isNull().alias("none"), "doc_id", "rid")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    with _conf(spark, STATE_CONF):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        states = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("best"))
        query = states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
        query.awaitTermination()
    shape = f"digest string, n long, best struct<chars:int,none:boolean,doc_id:{schema['doc_id'].dataType.simpleString()},rid:{schema['rid'].dataType.simpleString()}>, batch int"
    try:
        seen = spark.read.schema(shape).option("basePath", updates).parquet(updates)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        seen = spark.createDataFrame([], shape)
    last = seen.groupBy("digest").agg(F.max(F.struct("batch", "n", "best")).alias("s"))
    ledger = write_through(last.select("digest", "s.n", F.col("s.best.doc_id").alias("keep_id"), F.col("s.best.rid").alias("keep_rid")), "dedup-ledger")
    if own:
        drop_path(spark, updates)
        drop_path(spark, checkpoint)
    return ledger


def _decide(table: DataFrame, digest_chars: int = 64, files_per_batch: int = 64) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """rid, doc_id, keep_id, group_size, kept, text_sha256 for every row of ``table`` (loc, row, as stored() gives it), and the scratch tables this reads."""
    spark = table.sparkSession
    text = F.col("row.text")
    chars = F.length(F.coalesce(text, F.lit("")))
    digests = table.select(F.col("loc").alias("rid"), F.col("row.doc_id").alias("doc_id"), chars.alias("n_chars"), F.sha2(normalised(text), 256).alias("text_sha256")).withColumn("digest", F.substring("text_sha256", 1, digest_chars))
    digests = write_through(digests, "digests")
    ledger = digest_ledger(spark, digests._scratch_path, digests.schema, files_per_batch)

    # Least and greatest text are found in each task first, so of a large group of copies little is sent.
    texts = table.select(F.col("loc").alias("rid"), F.col("row.doc_id").alias("doc_id"), chars.alias("n_chars"), normalised(text).alias("norm")).withColumn("digest", F.substring(F.sha2("norm", 256), 1, digest_chars))
    checked = texts.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    collided = write_through(checked.where("low != high").select("digest"), "dedup-collided")

    # Both grow with the input: a merge join at every size, whose hot groups Spark may split.
    result = digests.join(ledger.hint("merge"), "digest").select("digest", "rid", "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")
    if not collided.isEmpty():
        same = Window.partitionBy("norm")
        first = same.orderBy(F.desc("n_chars"), F.col("doc_id").asc_nulls_last(), "rid")
        apart = texts.join(collided, "digest", "left_semi").select(
            "digest", "rid", "doc_id", F.first("doc_id").over(first).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size"), (F.row_number().over(first) == 1).alias("kept"), F.sha2("norm", 256).alias("text_sha256")
        )
        result = result.join(collided, "digest", "left_anti").unionByName(apart)
    return result.drop("digest"), (digests, ledger, collided)


def decide(docs: DataFrame, digest_chars: int = 64, files_per_batch: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    ``digest_chars`` shortens the key of the state, which makes collisions (for tests).
    """
    return _decide(stored(docs.select("doc_id", "text") if not is_table(docs) else docs, "dedup-docs"), digest_chars, files_per_batch)[0].drop("rid")


def drop_copies(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    table = stored(docs, "dedup-docs")
    result, scratch = _decide(table, **params)
    kept = write_through(result.where("kept").select(F.col("rid").alias("loc")), "dedup-kept", drop=scratch)
    # Both grow with the input: a merge join at every size, never a broadcast.
    return table.join(kept.hint("merge"), "loc", "left_semi").select("row.*")
