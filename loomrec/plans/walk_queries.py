"""Registered queries on walks, lists, bundles and scalars, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrec.functions import scalar
from loomrec.operators import diff, graph, listings, walks
from loomrec.plans.model import BASE, both_snapshots, edges, edges_sql, records, records_sql, references, second_snapshot, second_sql, table

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
PAIR = f"a AS ({records_sql()}), b AS ({second_sql('a')})"


def query(sql: str):
    def add(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return add


# Walks

SEEDS = f"seeds AS (SELECT {BASE} + r_regionkey AS form_id FROM region WHERE r_regionkey < 2)"
#: Every path of a depth, of which the least by (seed, path) stays; depths are layers, so a node's least depth has its least paths.
WALK = f"""WITH RECURSIVE edges AS ({edges_sql()}), {SEEDS},
w AS (SELECT form_id AS node, form_id AS origin, [form_id] AS path, 0 AS depth FROM seeds
    UNION ALL SELECT e.src, w.origin, list_append(w.path, e.src), w.depth + 1 FROM w JOIN edges e ON e.dst = w.node WHERE w.depth < 3),
d AS (SELECT node, min(depth) AS depth FROM w GROUP BY node),
g AS (SELECT node AS form_id, depth::BIGINT AS depth, origin, path FROM (SELECT w.*, row_number() OVER (PARTITION BY w.node ORDER BY w.origin, w.path) AS k FROM w JOIN d ON d.node = w.node AND d.depth = w.depth) WHERE k = 1) """


def _walk(spark, d, depth=3):
    seeds = table(spark, d, "region").where("r_regionkey < 2").selectExpr(f"{BASE} + r_regionkey as form_id")
    return walks.walk(edges(spark, d), seeds, depth)


@query(WALK + "SELECT form_id, depth, origin, array_to_string(path, '>') AS path FROM g")
def refs_paths(spark, d):
    return _walk(spark, d).select("form_id", "depth", "origin", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(WALK + "SELECT form_id, depth, row_number() OVER (ORDER BY depth, form_id) AS rank FROM g ORDER BY rank LIMIT 200 OFFSET 20")
def refs_page(spark, d):
    return walks.walk_page(_walk(spark, d).select("form_id", "depth"), offset=20, limit=200)


@query(WALK + ", b AS (SELECT DISTINCT e.src, g.depth FROM g JOIN edges e ON e.dst = g.form_id WHERE e.src NOT IN (SELECT form_id FROM g)), c AS (SELECT depth, count(*) AS m FROM b GROUP BY depth) SELECT g.depth, count(*) AS n, coalesce(any_value(c.m), 0) AS frontier_remaining, g.depth = 3 AND coalesce(any_value(c.m), 0) > 0 AS depth_capped FROM g LEFT JOIN c ON c.depth = g.depth GROUP BY g.depth")
def refs_figures(spark, d):
    return walks.walk_figures(_walk(spark, d), edges(spark, d), 3)


@query(
    f"""WITH RECURSIVE edges AS ({edges_sql(("ORDR", "CUST", "NATN"))}), p AS (SELECT DISTINCT {6 * BASE} + o_orderkey AS from_id, {BASE} + o_custkey % 5 AS to_id FROM orders),
    w AS (SELECT from_id, from_id AS node, [from_id] AS path FROM p UNION SELECT w.from_id, e.dst, list_append(w.path, e.dst) FROM w JOIN edges e ON e.src = w.node),
    m AS (SELECT from_id, node, path FROM (SELECT *, row_number() OVER (PARTITION BY from_id, node ORDER BY len(path), path) AS k FROM w) WHERE k = 1)
    SELECT p.from_id, p.to_id, (len(m.path) - 1)::BIGINT AS hops, array_to_string(m.path, '>') AS path FROM p LEFT JOIN m ON m.from_id = p.from_id AND m.node = p.to_id"""
)
def ref_path_nodes(spark, d):
    pairs = table(spark, d, "orders").selectExpr(f"{6 * BASE} + o_orderkey as from_id", f"{BASE} + o_custkey % 5 as to_id")
    found = walks.shortest_paths(edges(spark, d), pairs, 6)
    return found.select("from_id", "to_id", "hops", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(f"WITH edges AS ({edges_sql()}), n AS (SELECT DISTINCT dst AS target, src_sig, src FROM edges WHERE dst IN (SELECT {4 * BASE} + s_suppkey FROM supplier)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, src_sig ORDER BY src) AS rank FROM n) WHERE rank <= 25")
def consumers_by_type(spark, d):
    return walks.consumers_by_type(edges(spark, d), table(spark, d, "supplier").selectExpr(f"{4 * BASE} + s_suppkey as form_id"))


def _universe(spark, d):
    a = records(spark, d)
    return diff.snapshot_diff(a, second_snapshot(a), "form_id", ["sig", "name", "value"])


def _universe_ids(spark, d):
    """The form_id of the universe's records, without those (copies of lines above all) that lie outside the span of what edges give."""
    ends = references(spark, d).select(F.explode(F.concat(F.array("src"), "targets")).alias("form_id"))
    return diff.changed_keys(both_snapshots(records(spark, d)).where(graph.span(ends, "form_id")), "form_id", ["name", "value"])


UNIVERSE = f"WITH edges AS ({edges_sql()}), {PAIR}, u AS (SELECT coalesce(a.form_id, b.form_id) AS form_id FROM a FULL JOIN b ON a.form_id = b.form_id WHERE a.form_id IS NULL OR b.form_id IS NULL OR a.name IS DISTINCT FROM b.name OR a.value IS DISTINCT FROM b.value), o AS (SELECT * FROM edges WHERE src IN (SELECT form_id FROM u))"


@query(UNIVERSE + " SELECT src, dst, CASE WHEN dst IN (SELECT form_id FROM u) THEN 'inside' ELSE 'context' END AS kind FROM o")
def edge_split(spark, d):
    return walks.marked_edges(references(spark, d), _universe_ids(spark, d)).select("src", "dst", F.when(F.col("inside"), "inside").otherwise("context").alias("kind"))


@query(UNIVERSE + f" SELECT dst AS context, src // {BASE} AS bundle, count(DISTINCT src) AS n FROM o WHERE dst NOT IN (SELECT form_id FROM u) GROUP BY ALL")
def context_incidence(spark, d):
    _, context = walks.split_edges(references(spark, d), _universe_ids(spark, d), once=True)
    return walks.incidence(context, F.floor(F.col("src") / BASE))


@query(f"WITH RECURSIVE edges AS ({edges_sql()}), l AS (SELECT dst AS node, 1 AS depth FROM edges WHERE src_sig = 'SUPP' UNION SELECT e.dst, l.depth + 1 FROM l JOIN edges e ON e.src = l.node WHERE l.depth < 4), c AS (SELECT {2 * BASE} + n_nationkey AS form_id FROM nation UNION ALL SELECT {3 * BASE} + c_custkey FROM customer) SELECT form_id FROM c WHERE form_id NOT IN (SELECT node FROM l)")
def orphaned_unique(spark, d):
    nations = table(spark, d, "nation").selectExpr(f"{2 * BASE} + n_nationkey as form_id")
    customers = table(spark, d, "customer").selectExpr(f"{3 * BASE} + c_custkey as form_id")
    return walks.without_live_referencer(nations.union(customers), edges(spark, d), ["SUPP"], 4)


@query(f"WITH records AS ({records_sql()}), edges AS ({edges_sql(('ORDR',))}) SELECT e.src, e.dst, r.sig, r.editor_id, r.name FROM edges e LEFT JOIN records r ON r.form_id = e.dst")
def id_enrichment(spark, d):
    return walks.enriched(edges(spark, d, ("ORDR",)), "dst", records(spark, d)).select("src", "dst", "target.sig", "target.editor_id", "target.name")


# Lists, changes and bundles


@query(f"WITH {PAIR} SELECT coalesce(a.form_id, b.form_id) AS form_id, CASE WHEN a.form_id IS NULL THEN 'added' WHEN b.form_id IS NULL THEN 'removed' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.form_id = b.form_id WHERE coalesce(b.sig, a.sig) = 'PART' AND (a.form_id IS NULL OR b.form_id IS NULL OR a.name IS DISTINCT FROM b.name OR a.value IS DISTINCT FROM b.value)")
def diff_type_filter(spark, d):
    return listings.of_type(_universe(spark, d), "PART").select("form_id", "status")


@query("WITH c AS (SELECT o_orderpriority AS sig, o_orderstatus AS leaf, (o_orderkey % 10)::BIGINT AS value FROM orders), r AS (SELECT DISTINCT l_linestatus AS leaf, l_linenumber::BIGINT AS value FROM lineitem WHERE l_linenumber <= 3) SELECT sig, count(*) AS n FROM c SEMI JOIN r USING (leaf, value) GROUP BY sig")
def suppressed_counts(spark, d):
    changes = table(spark, d, "orders").selectExpr("o_orderpriority as sig", "o_orderstatus as leaf", "o_orderkey % 10 as value")
    return listings.suppressed_counts(changes, table(spark, d, "lineitem").where("l_linenumber <= 3").selectExpr("l_linestatus as leaf", "cast(l_linenumber as bigint) as value"))


@query("WITH n AS (SELECT l_orderkey, l_partkey % 7 AS v, bool_or(l_linenumber <= 4) AS o, bool_or(l_linenumber >= 2) AS w FROM lineitem GROUP BY ALL), s AS (SELECT l_orderkey, coalesce(string_agg(v::VARCHAR, ',' ORDER BY v) FILTER (o AND NOT w), '') AS removed, coalesce(string_agg(v::VARCHAR, ',' ORDER BY v) FILTER (w AND NOT o), '') AS added FROM n GROUP BY l_orderkey) SELECT * FROM s WHERE removed <> '' OR added <> ''")
def membership_changes(spark, d):
    lines = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_partkey % 7 as v", "l_linenumber as n")
    sides = lines.groupBy("l_orderkey").agg(*[F.coalesce(F.array_compact(F.collect_list(F.when(test, F.col("v")))), F.array().cast("array<bigint>")).alias(c) for c, test in (("old", F.col("n") <= 4), ("new", F.col("n") >= 2))])
    found = listings.membership_changes(sides, "l_orderkey")
    return found.select("l_orderkey", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("removed", "added")])


@query("WITH f AS (SELECT o_custkey, o_orderpriority, min((o_orderdate, o_orderkey)) AS place FROM orders GROUP BY ALL) SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY place, o_orderpriority) AS rank FROM f")
def key_union(spark, d):
    return listings.first_seen(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", ["o_orderdate", "o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 = 0 THEN coalesce(p_size, l_quantity) ELSE l_quantity END::DOUBLE AS quantity FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def global_values(spark, d):
    entries = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "case when l_partkey % 5 = 0 then l_partkey end as global_id", "l_quantity as quantity")
    return listings.dereferenced(entries, table(spark, d, "part").selectExpr("p_partkey as form_id", "cast(p_size as double) as value"), "global_id", "quantity").drop("global_id")


@query("WITH e AS (SELECT l_orderkey AS list_id, l_quantity <= 3 OR round(l_discount * 1000) >= 100 AS blocked FROM lineitem) SELECT list_id, count(*) FILTER (blocked) AS n_blocked, bool_and(blocked) AS all_blocked FROM e GROUP BY list_id HAVING count(*) FILTER (blocked) > 0")
def blocked_entries(spark, d):
    return listings.blocked_lists(table(spark, d, "lineitem").selectExpr("l_orderkey as list_id", "greatest(l_quantity - 3, 0) as quantity", "round(l_discount * 1000) as chance_none"))


@query("SELECT o_orderkey AS list_id, o_orderpriority AS name, n::BIGINT AS n_entries FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE regexp_matches(o_orderpriority, 'URGENT|HIGH') AND n >= 3 AND o_orderkey % 4 = 0")
def bundle_name_pick(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_entries"))
    lists = table(spark, d, "orders").selectExpr("o_orderkey as list_id", "o_orderpriority as name", "o_orderkey % 4 as flags").join(n, F.col("list_id") == F.col("l_orderkey"))
    return listings.uniform_picks(lists, "URGENT|HIGH").select("list_id", "name", "n_entries")


MEMBERS = "m AS (SELECT o_orderkey AS form_id, o_custkey AS bundle, o_custkey % 40 AS anchor, CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority END AS category FROM orders)"


def _members(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey as form_id", "o_custkey as bundle", "o_custkey % 40 as anchor", "case when o_custkey % 3 > 0 then o_orderpriority end as category")


@query(f"WITH {MEMBERS} SELECT DISTINCT form_id, min(bundle) OVER (PARTITION BY anchor) AS bundle FROM m")
def same_anchor(spark, d):
    return listings.same_anchor(_members(spark, d))


@query(f"WITH {MEMBERS}, e AS (SELECT bundle, count(DISTINCT form_id) AS n, max(category) AS category FROM m GROUP BY bundle) SELECT count(*) AS n_bundles, count(*) FILTER (n = 1) AS n_singletons, count(*) FILTER (category IS NULL) AS n_uncategorised FROM e")
def bundle_figures(spark, d):
    return listings.bundle_figures(_members(spark, d))


@query("WITH e AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS expected FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_partkey, expected, row_number() OVER (PARTITION BY l_suppkey ORDER BY expected DESC, l_partkey) AS rank FROM e")
def drop_row_order(spark, d):
    from loomrec.operators.graph import top_per_group

    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("expected"))
    return top_per_group(rows, ["l_suppkey"], [F.desc("expected"), "l_partkey"], 1 << 62)


# Scalars


@query("SELECT p_partkey, lower(hex(p_brand)) AS hexed, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_name END AS inline, list_filter(['big', 'odd', 'late'], lambda x, i: (p_size >> (i - 1)::INTEGER) & 1 = 1) AS flags, p_size % 2 = 1 AS set, p_retailprice::FLOAT::VARCHAR::DOUBLE AS short, list_transform(string_split(p_type, ' '), lambda x: upper(x)) AS kinds FROM part")
def scalar_forms(spark, d):
    part = table(spark, d, "part")
    mark = F.concat(F.lit("<ID=7>  "), F.when(F.col("p_size") % 4 == 0, F.lit("")).otherwise(F.col("p_name")))
    return part.select(
        "p_partkey",
        scalar.hex_lower(F.encode("p_brand", "utf-8")).alias("hexed"),
        scalar.inline_text(mark).alias("inline"),
        scalar.flag_names(F.col("p_size"), ["big", "odd", "late"]).alias("flags"),
        scalar.truthy(F.when(F.col("p_size") % 2 == 1, "yes").otherwise("False")).alias("set"),
        scalar.short_float(F.col("p_retailprice")).alias("short"),
        scalar.type_list(F.replace("p_type", F.lit(" "), F.lit(" , "))).alias("kinds"),
    )


@query("SELECT p_partkey, p_name AS text FROM part")
def zstring(spark, d):
    data = F.encode(F.concat("p_name", F.lit("\0"), "p_brand"), "utf-8")
    return table(spark, d, "part").select("p_partkey", scalar.zstring(data).alias("text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items()}
