"""What the training-data operators share: words, row numbers, checked columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.session import write_through

#: The white space of the contracts, [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    clean = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, WHITE_CLASS + "+"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it.

    A plain column gives no such promise: the planner may put its expression in place of each name,
    and in a lambda over an array that would be once an element.
    """
    return F.transform(F.array(value), body)[0]


def n_words(text: Column) -> Column:
    """Number of words, as a long."""
    return F.size(words_of(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def is_table(docs: DataFrame) -> bool:
    """Whether ``docs`` is a table of files as ``spark.read.parquet`` gives it."""
    return docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in docs.columns


def stored(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` as rows loc (file, number in the file) and row (all its columns), which can be read again with the same locators.

    A table as ``spark.read.parquet`` gives it is read where it is: its files tell where a row
    stands, however they are split among tasks. Any other DataFrame is written first.
    """
    if is_table(docs):
        return docs.select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("loc"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    loc = F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("at"))
    return write_through(docs.select(loc.alias("loc"), F.struct("*").alias("row")), name)


def spread_join(rows: DataFrame, counted: DataFrame, key: str, n: str, total: Column) -> DataFrame:
    """``rows`` joined with ``counted``, which has one row for each value of ``key`` and in ``n`` how many of ``rows`` have it.

    Values that over a thousandth of the ``total`` rows have, a thousand at the most, are broadcast:
    their rows stay where they are. The others meet in a merge join, whose groups are small.
    """
    hot = F.broadcast(counted.where(F.col(n) * 1000 > total))
    cold = counted.where(F.col(n) * 1000 <= total).hint("merge")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))
