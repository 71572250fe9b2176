"""Registered queries on changes, bundles and labels, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrec.functions.labels import group_label
from loomrec.operators import bundles, changes, diff
from loomrec.plans.model import BASE, edges, records, records_sql, second_snapshot, second_sql, table

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
PAIR = f"WITH a AS ({records_sql()}), b AS ({second_sql('a')})"
#: The markers of the cut query.
MARKERS = ["ZZZ", "CUT", "POST"]


def query(sql: str):
    def add(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def _pair(spark, d):
    a = records(spark, d)
    return a, second_snapshot(a)


NEW_ID = "CASE o_orderkey % 6 WHEN 0 THEN concat('ZZZ_', o_orderkey) WHEN 1 THEN concat('zzz', o_orderkey) WHEN 2 THEN 'Ore_cut' WHEN 3 THEN concat('POST', o_orderkey) WHEN 4 THEN 'Poster' ELSE concat('Ore', o_orderkey) END"
OLD_ID = "CASE o_custkey % 3 WHEN 1 THEN 'Ore' WHEN 2 THEN 'CUT_Ore' END"


@query(
    f"WITH r AS (SELECT o_orderkey, {NEW_ID} AS n, {OLD_ID} AS o FROM orders), m AS (SELECT *, CASE WHEN regexp_matches(n, '^(ZZZ|zzz)(_|[A-Z0-9])') THEN 'ZZZ' WHEN regexp_matches(n, '_(CUT|cut)$') THEN 'CUT' WHEN regexp_matches(n, '^(POST|post)[A-Z0-9]') THEN 'POST' END AS marker FROM r)"
    " SELECT o_orderkey, marker, CASE WHEN n LIKE 'ZZZ\\_%' ESCAPE '\\' THEN 'high' WHEN marker = 'ZZZ' THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN o IS NULL THEN 'added_cut' WHEN o LIKE 'CUT%' THEN 'still_cut' ELSE 'newly_deprecated' END AS kind FROM m WHERE marker IS NOT NULL"
)
def cut_classifier(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey", f"{NEW_ID} as n", f"{OLD_ID} as o")
    told = rows.select("o_orderkey", changes.marker_of(F.col("n"), MARKERS).alias("m"), changes.cut_kind(F.col("n"), F.col("o"), MARKERS).alias("kind"))
    return told.where("m is not null").select("o_orderkey", "m.marker", "m.confidence", "kind")


TEXTS = "c AS (SELECT p_partkey AS form_id, 'size' AS path, p_size::VARCHAR AS \"from\" FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'double', (p_size * 2)::VARCHAR FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 'description', p_name FROM part WHERE p_partkey % 5 = 0)"


def _text_changes(spark, d):
    part = table(spark, d, "part")
    one = lambda path, value, step: part.where(f"p_partkey % {step} = 0").selectExpr("p_partkey as form_id", f"'{path}' as path", f"cast({value} as string) as from", f"concat({value}, '!') as to")
    return one("size", "p_size", 3).union(one("double", "p_size * 2", 4)).union(one("description", "p_name", 5))


@query(f"WITH {TEXTS} SELECT form_id FROM c GROUP BY form_id HAVING bool_or(path = 'description') AND NOT bool_or(path <> 'description')")
def text_only_change(spark, d):
    return changes.text_only_changes(_text_changes(spark, d))


@query(f"WITH {TEXTS}, t AS (SELECT p_partkey AS form_id, p_name || ' of ' || p_size || ' units' AS text FROM part) SELECT c.form_id, c.path, c.\"from\"::DOUBLE AS was FROM c JOIN t USING (form_id) WHERE c.path <> 'description' AND form_id NOT IN (SELECT form_id FROM c WHERE path = 'description') AND list_contains(list_transform(regexp_extract_all(t.text, '-?\\d+(?:\\.\\d+)?'), lambda s: s::DOUBLE), c.\"from\"::DOUBLE)")
def stale_description(spark, d):
    texts = table(spark, d, "part").selectExpr("p_partkey as form_id", "concat(p_name, ' of ', p_size, ' units') as text")
    return changes.stale_numbers(_text_changes(spark, d), texts)


@query(PAIR + ", x AS (SELECT a.sig, a.form_id, a.name AS n1, b.name AS n2, a.value AS v1, b.value AS v2 FROM a JOIN b USING (form_id)), c AS (SELECT sig, form_id, 'name' AS path FROM x WHERE n1 IS DISTINCT FROM n2 UNION ALL SELECT sig, form_id, 'value' FROM x WHERE v1 IS DISTINCT FROM v2) SELECT sig, form_id, path FROM c WHERE path <> 'value' AND NOT (sig = 'CUST' AND path = 'name')")
def noise_fields(spark, d):
    a, b = _pair(spark, d)
    both = diff.snapshot_diff(a, b, "form_id", ["sig", "name", "value"]).withColumn("sig", F.coalesce("new.sig", "old.sig"))
    rules = spark.createDataFrame([(None, "value"), ("CUST", "name")], "sig string, path string")
    return changes.strip_fields(diff.field_changes(both, "form_id", ["name", "value"]), rules).select("sig", "form_id", "path")


@query(PAIR + f", i AS (SELECT DISTINCT {3 * BASE} + o_custkey + CASE WHEN o_custkey % 2 = 0 THEN {1 << 30} ELSE 0 END AS form_id FROM orders) SELECT i.form_id, CASE WHEN b.form_id IS NULL THEN a.sig ELSE b.sig END AS sig, CASE WHEN b.form_id IS NULL THEN a.editor_id ELSE b.editor_id END AS editor_id, CASE WHEN b.form_id IS NULL THEN a.name ELSE b.name END AS name FROM i LEFT JOIN b USING (form_id) LEFT JOIN a USING (form_id) WHERE a.form_id IS NOT NULL OR b.form_id IS NOT NULL")
def reference_names(spark, d):
    a, b = _pair(spark, d)
    ids = edges(spark, d, ("ORDR",)).selectExpr(f"dst + case when (dst % {BASE}) % 2 = 0 then {1 << 30} else 0 end as form_id")
    return changes.reference_names(ids, b, a)


@query(PAIR + ", w AS (SELECT coalesce(a.form_id, b.form_id) AS form_id, a.form_id IS NULL OR b.form_id IS NULL AS lone, a.editor_id AS e1, b.editor_id AS e2, a.name AS n1, b.name AS n2 FROM a FULL JOIN b ON a.form_id = b.form_id) SELECT form_id, 'editor_id' AS path, e1 AS old, e2 AS new, lone OR e1 IS DISTINCT FROM e2 AS conflict FROM w UNION ALL SELECT form_id, 'name', n1, n2, lone OR n1 IS DISTINCT FROM n2 FROM w")
def aligned_columns(spark, d):
    a, b = _pair(spark, d)
    return changes.aligned_fields({"old": a, "new": b}, "form_id", ["editor_id", "name"])


LETTERS = "65 + o_orderkey % 26 + 256 * (65 + o_orderkey % 25) + 65536 * (65 + o_orderkey % 7) + 16777216 * (65 + o_orderkey % 11)"
LABELS = f"SELECT o_orderkey, o_orderkey % 12 AS kind, CASE WHEN o_orderkey % 12 = 0 THEN {LETTERS} ELSE (o_orderkey * 2654435761) % 4294967296 END AS label FROM orders"


@query(
    f"WITH g AS ({LABELS}), h AS (SELECT *, (label & 65535)::BIGINT AS x, (label >> 16)::BIGINT AS y FROM g) SELECT o_orderkey, CASE WHEN kind = 0 THEN chr((label & 255)::INTEGER) || chr(((label >> 8) & 255)::INTEGER) || chr(((label >> 16) & 255)::INTEGER) || chr((label >> 24)::INTEGER)"
    " WHEN kind IN (1, 6, 7, 8, 9, 10) THEN printf('0x%08X', label) WHEN kind IN (2, 3) THEN (label - CASE WHEN label >= 2147483648 THEN 4294967296 ELSE 0 END)::VARCHAR WHEN kind IN (4, 5) THEN (x - CASE WHEN x >= 32768 THEN 65536 ELSE 0 END)::VARCHAR || ',' || (y - CASE WHEN y >= 32768 THEN 65536 ELSE 0 END)::VARCHAR ELSE label::VARCHAR END AS label FROM h"
)
def group_labels(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderkey % 12 as kind", f"case when o_orderkey % 12 = 0 then {LETTERS} else (o_orderkey * 2654435761) % 4294967296 end as label")
    return rows.select("o_orderkey", group_label(F.col("kind"), F.col("label")).alias("label"))


SPLIT = f"""WITH n AS (SELECT {2 * BASE} + n_nationkey AS node, n_regionkey AS rank FROM nation), o AS (SELECT {6 * BASE} + o_orderkey AS node, {2 * BASE} + o_orderkey % 25 AS anchor, {3 * BASE} + o_custkey AS customer FROM orders),
    c AS (SELECT {3 * BASE} + c_custkey AS node FROM customer), k AS (SELECT o.customer AS node, arg_min(n.node, ROW(n.rank, n.node)) AS owner FROM o JOIN n ON n.node = o.anchor GROUP BY o.customer)
    SELECT node, node AS owner FROM n UNION ALL SELECT node, anchor FROM o UNION ALL SELECT c.node, coalesce(k.owner, (SELECT arg_min(node, ROW(rank, node)) FROM n)) FROM c LEFT JOIN k USING (node)"""


@query(SPLIT)
def split_owners(spark, d):
    nations = table(spark, d, "nation").selectExpr("0L as component", f"{2 * BASE} + n_nationkey as node", "cast(n_regionkey as long) as rank")
    orders = table(spark, d, "orders").selectExpr(f"{6 * BASE} + o_orderkey as node", f"{2 * BASE} + o_orderkey % 25 as anchor", f"{3 * BASE} + o_custkey as customer")
    others = orders.select("node").union(table(spark, d, "customer").selectExpr(f"{3 * BASE} + c_custkey"))
    members = nations.union(others.selectExpr("0L", "node", "cast(null as long)"))
    links = orders.select(F.col("node").alias("src"), F.col("anchor").alias("dst")).union(orders.select("customer", "node"))
    return bundles.split_oversized(members, links).select("node", "owner")


@query("WITH m AS (SELECT o_custkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 0 WHEN o_totalprice > 450000 THEN 1 WHEN o_orderstatus = 'F' THEN 2 END AS k FROM orders) SELECT o_custkey, CASE min(k) WHEN 0 THEN 'urgent' WHEN 1 THEN 'large' WHEN 2 THEN 'filled' ELSE 'other' END AS category FROM m GROUP BY o_custkey")
def bundle_categories(spark, d):
    tests = [("urgent", (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")), ("large", F.col("o_totalprice") > 450000), ("filled", F.col("o_orderstatus") == "F")]
    return changes.first_category(table(spark, d, "orders"), "o_custkey", tests, "other")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'brief' WHEN c_custkey % 3 = 0 THEN 'deep' ELSE 'ambiguous' END AS tier FROM customer")
def assessment_merge(spark, d):
    customers = table(spark, d, "customer")
    tiers = customers.selectExpr("c_custkey", "case when c_acctbal > 0 then 'brief' else 'ambiguous' end as tier")
    return changes.merge_assessment(tiers, customers.where("c_custkey % 3 = 0").selectExpr("c_custkey", "'deep' as assessed"), "c_custkey")


@query("WITH f AS (SELECT c_nationkey, c_custkey AS form_id, 'negative' AS rule FROM customer WHERE c_acctbal < -900 UNION ALL SELECT c_nationkey, c_custkey, 'orderless' FROM customer ANTI JOIN orders ON o_custkey = c_custkey), g AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY rule, form_id) AS number FROM f) SELECT n.c_nationkey, g.form_id, g.rule, g.number FROM (SELECT DISTINCT c_nationkey FROM customer) n LEFT JOIN g USING (c_nationkey)")
def bundle_lints(spark, d):
    customers = table(spark, d, "customer").withColumnRenamed("c_custkey", "form_id")
    poor = customers.where("c_acctbal < -900").selectExpr("form_id", "'negative' as rule")
    idle = customers.join(table(spark, d, "orders").selectExpr("o_custkey as form_id"), "form_id", "left_anti").selectExpr("form_id", "'orderless' as rule")
    return changes.lints_by_group(customers.select("c_nationkey", "form_id"), poor.union(idle), "c_nationkey")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items()}
