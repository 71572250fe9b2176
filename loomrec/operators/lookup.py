"""Lookups, listing, search and predicates over records and nested bodies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrec.functions.scalar import parse_id, wildcard
from loomrec.session import write_through


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Adds ``name``: the rows' numbers from 1 in an order of all of them.

    Rows are dealt out by ranges of the order and sorted there; a task's rows are numbered from the
    number of rows in the ranges before it. Only those counts, one a task, meet in one place. Rows
    that the order holds equal stay together, in any order.
    """
    place = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The low 33 bits count within a task, the others are the task.
    held = write_through(dealt.select("*", F.shiftright(place, 33).alias("_task"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "numbered")
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.groupBy("_task").agg(F.count(F.lit(1)).alias("_n")).select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return held.join(F.broadcast(bases), "_task").withColumn(name, F.col("_base") + F.col("_at") + 1).drop("_task", "_at", "_base")


def ranked_page(rows: DataFrame, order: list, offset: int = 0, limit: int = 0) -> DataFrame:
    """A page of rows in order, with rank (1 is the first of all); limit 0 is no limit.

    A page with a limit is cut first, by a top-k that merges the tasks' own; only the page is
    numbered. Without a limit the rows are numbered where a range partitioning puts them.
    """
    if not limit:
        every = numbered(rows, order, "rank")
        return every.where(F.col("rank") > offset) if offset else every
    page = rows.orderBy(*order)
    page = (page.offset(offset) if offset else page).limit(limit)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long") + offset)


def list_type(records: DataFrame, sig: str, offset: int = 0, limit: int = 0) -> DataFrame:
    return ranked_page(records.where(F.col("sig") == sig), ["form_id"], offset, limit)


def search(records: DataFrame, pattern: str, sigs: list[str] | None = None, field: str = "both", limit: int = 0) -> DataFrame:
    """Records whose editor_id and/or name match a wildcard, in id order. ``field``: editor_id, name or both."""
    if not pattern:
        raise ValueError("an empty pattern")
    found = {"editor_id": wildcard(F.col("editor_id"), pattern), "name": wildcard(F.col("name"), pattern)}
    match = found["editor_id"] | F.coalesce(found["name"], F.lit(False)) if field == "both" else found[field]
    rows = records.where(F.col("sig").isin(sigs)) if sigs else records
    return ranked_page(rows.where(match), ["form_id"], 0, limit)


def resolve(selectors: DataFrame, records: DataFrame) -> DataFrame:
    """ordinal, selector, form_id, matched_by (id, editor_id or null): an id if there is such a record, else an editor id; of several records the last by id."""
    wanted = selectors.select("ordinal", "selector", parse_id(F.col("selector")).alias("id"))
    ids = records.select(F.col("form_id").alias("by_id"))
    names = records.groupBy("editor_id").agg(F.max("form_id").alias("by_name"))
    hit = wanted.join(ids, F.col("id") == F.col("by_id"), "left").join(names, F.col("selector") == F.col("editor_id"), "left")
    kind = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_name").isNotNull(), "editor_id")
    return hit.select("ordinal", "selector", F.coalesce("by_id", "by_name").alias("form_id"), kind.alias("matched_by"))


def bulk_get(selectors: DataFrame, records: DataFrame) -> DataFrame:
    """A row for every selector, numbered by its ordinal: the record, or an error text."""
    found = resolve(selectors, records)
    named = records.withColumnRenamed("form_id", "f")
    out = found.join(named, F.col("form_id") == F.col("f"), "left").drop("f")
    return out.withColumn("error", F.when(F.col("form_id").isNull(), F.concat(F.lit("no record for "), F.col("selector"))))


def type_directory(records: DataFrame) -> DataFrame:
    return records.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("form_id").alias("first_id"), F.max("form_id").alias("last_id"))


def at_path(body: Column, path: str) -> Column:
    """The values (array of variant) at a dot path of a variant body; [] is every element. Missing is an empty array."""

    def step(values: Column, at: str, kind: str) -> Column:
        return F.filter(F.transform(values, lambda v: F.try_variant_get(v, at, kind)), lambda v: v.isNotNull())

    here = F.array(body)
    for part in path.split("."):
        name, any_element = part.removesuffix("[]"), part.endswith("[]")
        if name:
            here = step(here, f"$['{name}']", "variant")
        if any_element:
            here = F.flatten(step(here, "$", "array<variant>"))
    return here


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _number(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "double"), _text(value).try_cast("double"))


def value_test(value: Column, op: str, operand: str) -> Column:
    """One predicate on one value: exists, eq, contains, gt, gte, lt, lte."""
    if op == "exists":
        return F.lit(True)
    if op == "contains":
        return F.coalesce(F.lower(_text(value)).contains(operand.lower()), F.lit(False))
    try:
        wanted = float(operand)
    except ValueError:
        wanted = None
    if op == "eq":
        same = F.lower(_text(value)) == operand.lower()
        if wanted is None:
            return F.coalesce(same, F.lit(False))
        kind = F.schema_of_variant(value)
        return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.coalesce(_number(value) == wanted, F.lit(False))).otherwise(F.coalesce(same, F.lit(False)))
    if wanted is None:
        return F.lit(False)
    number = _number(value)
    test = {"gt": number > wanted, "gte": number >= wanted, "lt": number < wanted, "lte": number <= wanted}[op]
    return F.coalesce(test, F.lit(False))


def filter_path(rows: DataFrame, body: str, path: str, op: str, operand: str = "") -> DataFrame:
    """Rows with a value at ``path`` of the variant column ``body`` that passes."""
    return rows.where(F.exists(at_path(F.col(body), path), lambda v: value_test(v, op, operand)))


#: Levels of a body that one job takes apart.
LEVELS = 4


def leaves(rows: DataFrame, key: str, body: str, whole: Callable[[Column], Column] | None = None, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """key, path, leaf (variant): every scalar of a variant body; array elements have [] in the path.

    Containers that ``whole`` holds for are leaves, too. Where ``wanted`` is given, only leaves that it holds for are kept.

    What is a container is exploded again, four levels in one job; what is still a container then is
    the next job's input. Jobs' results are written to the shared folder, each leaf once, so bodies have any depth.
    """
    spark = rows.sparkSession
    front, found = rows.select(F.col(key), F.lit("").alias("path"), F.col(body).alias("v"), F.lit(True).alias("open")).where("v is not null"), None
    inner = F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
    still_open = ~F.coalesce(whole(F.col("value")), F.lit(False)) if whole is not None else F.lit(True)
    container = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
    child = F.col("value").isNotNull()
    while True:
        level = front
        for n in range(LEVELS):
            # The front are containers. Later a scalar, and what is known as a leaf, passes as its one row, without a child.
            explode = spark.tvf.variant_explode_outer if n else spark.tvf.variant_explode
            opened = level.withColumnRenamed(key, "_id").lateralJoin(explode(F.when(F.col("open"), F.col("v")).outer()))
            if n:
                opened = opened.where(child | ~F.col("open") | ~container)
            level = opened.select(F.col("_id").alias(key), F.when(child, inner).otherwise(F.col("path")).alias("path"), F.coalesce("value", "v").alias("v"), F.when(child, still_open).otherwise(F.lit(False)).alias("open"))
        level = level.withColumn("open", F.col("open") & container)
        level = write_through(level if wanted is None else level.where(F.col("open") | wanted(F.col("v"))), "leaves")
        own = level.where("not open").select(key, "path", F.col("v").alias("leaf"))
        found = own if found is None else found.unionByName(own)
        front = level.where("open")
        if front.isEmpty():
            return found


def field_paths(rows: DataFrame, key: str, body: str, most: int | None = None) -> DataFrame:
    """The distinct paths of the bodies; the first ``most`` by path where that is given."""
    paths = leaves(rows, key, body).select("path").distinct()
    return paths if most is None else paths.orderBy("path").limit(most)


def deep_scan(rows: DataFrame, key: str, body: str, op: str, operand: str) -> DataFrame:
    """Rows with any scalar anywhere in the body that passes."""
    hits = leaves(rows, key, body).where(value_test(F.col("leaf"), op, operand)).select(key).distinct()
    return rows.join(hits, key, "left_semi")


def nulls_last(column: str, descending: bool = False) -> Column:
    """A sort order that has null and empty last both ways."""
    value = F.nullif(F.col(column), F.lit(""))
    return value.desc_nulls_last() if descending else value.asc_nulls_last()
