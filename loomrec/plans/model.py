"""The record model: any keyed tables as records, edges between them, and a second snapshot.

A record has a signature (its type), a form_id unique over all types (type number times 2^32 plus
the key), an editor_id, a name and a numeric value. Line numbers repeat within an order: the second
line of a number and those after it have ids of their own, 8 times 2^32 apart, and the first has the
id that edges give. Edges are the foreign keys. The second snapshot
is derived: records whose key is a multiple of 17 are gone, those of a multiple of 19 come again
under a new id, and values change where the key is a multiple of 7.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = 1 << 32
#: Lines that agree in all of these columns are alike, so any order among them gives the same records.
COPIES = f" + (row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1) * {8 * BASE}"
#: The last columns of that order: lines that tie before them have the same name and value, so records do without.
ALIKE = ", l_linestatus, l_shipdate"
#: Type number, table, key, editor id, name and value of each record type.
TYPES = {
    "REGN": (1, "region", "r_regionkey", "r_name", "r_name", "cast(null as double)"),
    "NATN": (2, "nation", "n_nationkey", "n_name", "n_name", "cast(null as double)"),
    "CUST": (3, "customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal"),
    "SUPP": (4, "supplier", "s_suppkey", "s_name", "s_name", "s_acctbal"),
    "PART": (5, "part", "p_partkey", "p_name", "p_type", "p_retailprice"),
    "ORDR": (6, "orders", "o_orderkey", "concat('Order#', o_orderkey)", "o_orderpriority", "o_totalprice"),
    "LINE": (7, "lineitem", "l_orderkey * 8 + l_linenumber" + COPIES, "concat('Line#', l_orderkey, '-', l_linenumber)", "l_returnflag", "l_extendedprice"),
}
#: Referencing type, referenced type and the referenced key in the referencing table.
LINKS = [("NATN", "REGN", "n_regionkey"), ("CUST", "NATN", "c_nationkey"), ("SUPP", "NATN", "s_nationkey"), ("ORDR", "CUST", "o_custkey"), ("LINE", "ORDR", "l_orderkey"), ("LINE", "PART", "l_partkey"), ("LINE", "SUPP", "l_suppkey")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(number: int, key: str) -> str:
    return f"{number * BASE} + ({key})"


def records(spark: SparkSession, sf_dir: str, sigs: tuple[str, ...] = tuple(TYPES)) -> DataFrame:
    """sig, form_id, editor_id, name, value of the given types."""
    out = None
    for sig in sigs:
        number, source, key, editor, name, value = TYPES[sig]
        one = table(spark, sf_dir, source).selectExpr(f"'{sig}' as sig", f"{_id(number, key.replace(ALIKE, ''))} as form_id", f"{editor} as editor_id", f"{name} as name", f"{value} as value")
        out = one if out is None else out.unionByName(one)
    return out


def records_sql(sigs: tuple[str, ...] = tuple(TYPES)) -> str:
    """The same as a query of the tables."""
    return " UNION ALL ".join(f"SELECT '{s}' AS sig, {_id(n, k)} AS form_id, {e} AS editor_id, {m} AS name, {v} AS value FROM {t}" for s, (n, t, k, e, m, v) in ((s, TYPES[s]) for s in sigs))


def edges(spark: SparkSession, sf_dir: str, sources: tuple[str, ...] | None = None) -> DataFrame:
    """src, src_sig, dst, dst_sig: who references whom."""
    out = None
    for a, b, key in LINKS:
        if sources and a not in sources:
            continue
        number, source, own, *_ = TYPES[a]
        one = table(spark, sf_dir, source).selectExpr(f"{_id(number, own.removesuffix(COPIES))} as src", f"'{a}' as src_sig", f"{_id(TYPES[b][0], key)} as dst", f"'{b}' as dst_sig")
        out = one if out is None else out.unionByName(one)
    return out.where("dst is not null")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, targets: the edges again, with all that a row references, or null, in one array, so a table is read once."""
    out = None
    for a in dict.fromkeys(a for a, *_ in LINKS):
        number, source, own, *_ = TYPES[a]
        targets = ", ".join(_id(TYPES[b][0], key) for c, b, key in LINKS if c == a)
        one = table(spark, sf_dir, source).selectExpr(f"{_id(number, own.removesuffix(COPIES))} as src", f"array({targets}) as targets")
        out = one if out is None else out.unionByName(one)
    return out


def edges_sql(sources: tuple[str, ...] | None = None) -> str:
    picked = [(a, b, k) for a, b, k in LINKS if not sources or a in sources]
    return " UNION ALL ".join(f"SELECT {_id(TYPES[a][0], TYPES[a][2].removesuffix(COPIES))} AS src, '{a}' AS src_sig, {_id(TYPES[b][0], k)} AS dst, '{b}' AS dst_sig FROM {TYPES[a][1]}" for a, b, k in picked)


def key_of(form_id: Column) -> Column:
    return form_id % BASE


def _second(key: Column) -> tuple[Column, Column, Column, Column]:
    """Whether a record of this key stays, whether it comes again under a new id, and its name and value if it stays."""
    stays = key % 17 != 0
    name = F.when(key % 21 == 0, F.lower("name")).otherwise(F.col("name"))
    value = F.when(key % 7 == 0, F.col("value") + 1).otherwise(F.col("value"))
    return stays, (key % 19 == 0) & stays, name, value


def second_snapshot(first: DataFrame) -> DataFrame:
    """The derived second snapshot of records."""
    stays, again, name, value = _second(key_of(F.col("form_id")))
    kept = first.where(stays).withColumns({"name": name, "value": value})
    added = first.where(again).withColumn("form_id", F.col("form_id") + (1 << 30)).withColumn("editor_id", F.concat("editor_id", F.lit("_new")))
    return kept.unionByName(added)


def both_snapshots(first: DataFrame) -> DataFrame:
    """form_id, name, value, sides: the records of the first snapshot (1) and of its second (2), those that are the same in both once (3).

    The first is read once, so its lines are numbered once, and what did not change is half as many rows.
    """
    stays, again, name, value = _second(key_of(F.col("form_id")))
    each = first.select("form_id", "name", "value", stays.alias("stays"), again.alias("again"), name.alias("new_name"), value.alias("new_value"))
    same = F.col("stays") & F.col("name").eqNullSafe(F.col("new_name")) & F.col("value").eqNullSafe(F.col("new_value"))
    each = each.withColumn("same", F.coalesce(same, F.lit(False))).withColumn("row", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    each = each.where((F.col("row") == 1) | ((F.col("row") == 2) & F.col("stays") & ~F.col("same")) | ((F.col("row") == 3) & F.col("again")))
    return each.select(
        F.when(F.col("row") == 3, F.col("form_id") + (1 << 30)).otherwise(F.col("form_id")).alias("form_id"),
        F.when(F.col("row") == 2, F.col("new_name")).otherwise(F.col("name")).alias("name"),
        F.when(F.col("row") == 2, F.col("new_value")).otherwise(F.col("value")).alias("value"),
        F.when(F.col("row") != 1, 2).when(F.col("same"), 3).otherwise(1).alias("sides"),
    )


def second_sql(first: str) -> str:
    return (
        f"SELECT sig, form_id, editor_id, CASE WHEN (form_id % {BASE}) % 21 = 0 THEN lower(name) ELSE name END AS name, CASE WHEN (form_id % {BASE}) % 7 = 0 THEN value + 1 ELSE value END AS value FROM {first} WHERE (form_id % {BASE}) % 17 <> 0"
        f" UNION ALL SELECT sig, form_id + {1 << 30}, editor_id || '_new', name, value FROM {first} WHERE (form_id % {BASE}) % 19 = 0 AND (form_id % {BASE}) % 17 <> 0"
    )
