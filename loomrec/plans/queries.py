"""The registered queries over the record model, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrec.functions import scalar
from loomrec.operators import diff, graph, lookup, odds, rules
from loomrec.plans import model
from loomrec.plans.model import BASE, edges, edges_sql, records, records_sql, second_snapshot, second_sql, table

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
R = f"WITH records AS ({records_sql()})"
E = f"WITH edges AS ({edges_sql()})"
PAIR = f"WITH a AS ({records_sql()}), b AS ({second_sql('a')})"


def query(sql: str | None):
    def add(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return add


# Lookups and listing


@query(R + "SELECT sig, form_id, editor_id, name, row_number() OVER (ORDER BY form_id) AS rank FROM records WHERE sig IN ('NATN', 'PART', 'REGN') AND (lower(editor_id) LIKE '%a%i%' OR lower(name) LIKE '%a%i%')")
def search_wildcard(spark, d):
    return lookup.search(records(spark, d), "*A*i*", ["NATN", "PART", "REGN"]).drop("value")


@query(R + "SELECT sig, form_id, editor_id, row_number() OVER (ORDER BY form_id) AS rank FROM records WHERE lower(editor_id) LIKE '%00001%' ORDER BY form_id LIMIT 50")
def search_substring(spark, d):
    return lookup.search(records(spark, d), "00001", field="editor_id", limit=50).select("sig", "form_id", "editor_id", "rank")


@query(R + "SELECT form_id, editor_id, name, row_number() OVER (ORDER BY form_id) AS rank FROM records WHERE sig = 'CUST' ORDER BY form_id LIMIT 25 OFFSET 40")
def list_type_page(spark, d):
    return lookup.list_type(records(spark, d, ("CUST",)), "CUST", 40, 25).select("form_id", "editor_id", "name", "rank")


@query(R + "SELECT sig, count(*) AS n, min(form_id) AS first_id, max(form_id) AS last_id FROM records GROUP BY sig")
def type_directory(spark, d):
    return lookup.type_directory(records(spark, d))


def _selectors(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey as ordinal", f"case when c_custkey % 2 = 0 then cast({3 * BASE} + c_custkey * 2 as string) else c_name end as selector")


SELECTORS = f"s AS (SELECT c_custkey AS ordinal, CASE WHEN c_custkey % 2 = 0 THEN ({3 * BASE} + c_custkey * 2)::VARCHAR ELSE c_name END AS selector FROM customer), f AS (SELECT s.ordinal, s.selector, coalesce(i.form_id, n.form_id) AS form_id, CASE WHEN i.form_id IS NOT NULL THEN 'id' WHEN n.form_id IS NOT NULL THEN 'editor_id' END AS matched_by FROM s LEFT JOIN records i ON i.form_id::VARCHAR = s.selector LEFT JOIN records n ON n.editor_id = s.selector)"


@query(f"{R}, {SELECTORS} SELECT * FROM f")
def selector_resolve(spark, d):
    return lookup.resolve(_selectors(spark, d), records(spark, d))


@query(f"{R}, {SELECTORS} SELECT f.ordinal, f.selector, f.form_id, f.matched_by, r.sig, r.editor_id, r.name, r.value, CASE WHEN f.form_id IS NULL THEN 'no record for ' || f.selector END AS error FROM f LEFT JOIN records r ON r.form_id = f.form_id")
def bulk_get(spark, d):
    return lookup.bulk_get(_selectors(spark, d), records(spark, d))


@query("SELECT o_orderkey, printf('0x%08X', o_orderkey) AS id_text, o_orderkey AS back, regexp_matches(printf('%x', o_orderkey), '^[0-9a-f]{1,8}$') AS looks FROM orders")
def id_round_trip(spark, d):
    ids = table(spark, d, "orders").select("o_orderkey", scalar.id_text(F.col("o_orderkey")).alias("id_text"))
    return ids.select("o_orderkey", "id_text", scalar.parse_id(F.col("id_text")).alias("back"), scalar.looks_like_id(F.col("id_text")).alias("looks"))


@query("SELECT r_name, n_name, count(c_custkey) AS n_customers, row_number() OVER (ORDER BY r_name, n_name) AS rank FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name")
def group_children(spark, d):
    tree = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    rows = tree.join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("r_name", "n_name", F.coalesce("n", F.lit(0)).alias("n_customers"))
    return lookup.ranked_page(rows, ["r_name", "n_name"])


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN '' ELSE n_name END AS v, row_number() OVER (ORDER BY CASE WHEN n_nationkey % 3 = 2 THEN n_name END DESC NULLS LAST, n_nationkey) AS rank FROM nation")
def nulls_last_sort(spark, d):
    rows = table(spark, d, "nation").selectExpr("n_nationkey", "n_name as name", "case when n_nationkey % 3 = 0 then null when n_nationkey % 3 = 1 then '' else n_name end as v")
    return lookup.ranked_page(rows, [lookup.nulls_last("v", True), "n_nationkey"]).drop("n_nationkey")


# Predicates on nested bodies


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", "user_id", "value", F.parse_json("props").alias("body"))


def _orders(spark, d):
    """Customers with their orders as one nested body each."""
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("Key"), F.col("o_orderstatus").alias("Status"), F.col("o_totalprice").alias("Price")))).alias("Orders"))
    return rows.select("o_custkey", F.to_variant_object(F.struct("Orders", F.struct(F.size("Orders").alias("Count")).alias("Meta"))).alias("body"))


@query("SELECT event_id FROM events WHERE (props::JSON->>'k')::DOUBLE = 42")
def filter_eq(spark, d):
    return lookup.filter_path(_events(spark, d), "body", "k", "eq", "42").select("event_id")


@query("SELECT event_id FROM events WHERE (props::JSON->>'k')::DOUBLE > 90")
def filter_gt(spark, d):
    return lookup.filter_path(_events(spark, d), "body", "k", "gt", "90").select("event_id")


@query("SELECT event_id FROM events WHERE (props::JSON->>'k') LIKE '%7%'")
def filter_contains(spark, d):
    return lookup.filter_path(_events(spark, d), "body", "k", "contains", "7").select("event_id")


@query("SELECT event_id FROM events WHERE json_exists(props, '$.k')")
def filter_exists(spark, d):
    return lookup.filter_path(_events(spark, d), "body", "k", "exists").select("event_id")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def filter_any_element(spark, d):
    return lookup.filter_path(_orders(spark, d), "body", "Orders[].Status", "eq", "f").select("o_custkey")


@query("SELECT unnest(['Meta.Count', 'Orders[].Key', 'Orders[].Price', 'Orders[].Status']) AS path")
def field_paths(spark, d):
    return lookup.field_paths(_orders(spark, d), "o_custkey", "body")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def deep_scan(spark, d):
    return lookup.deep_scan(_orders(spark, d), "o_custkey", "body", "eq", "o").select("o_custkey")


@query("SELECT coalesce(event_type, '(all)') AS event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_high, count(*) FILTER (props IS NULL) AS n_raw FROM events GROUP BY ROLLUP (event_type)")
def coverage_rollup(spark, d):
    rows = table(spark, d, "events").rollup("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_high"), F.count_if(F.col("props").isNull()).alias("n_raw"))
    return rows.withColumn("event_type", F.coalesce("event_type", F.lit("(all)")))


# The reference graph

WALK = f"""WITH RECURSIVE edges AS ({edges_sql()}), seeds AS (SELECT {BASE} + r_regionkey AS form_id, r_name AS tag FROM region WHERE r_regionkey < 2),
w AS (SELECT form_id AS node, form_id AS origin, tag, 0 AS depth FROM seeds UNION SELECT e.src, w.origin, w.tag, w.depth + 1 FROM w JOIN edges e ON e.dst = w.node WHERE w.depth < 3),
f AS (SELECT node, min(depth) AS depth FROM w GROUP BY node HAVING min(depth) > 0),
g AS (SELECT f.node AS form_id, f.depth::BIGINT AS depth, min(w.origin) AS origin, string_agg(DISTINCT w.tag, ',' ORDER BY w.tag) AS tags FROM f JOIN w ON w.node = f.node AND w.depth = f.depth GROUP BY f.node, f.depth) """


def _walk(spark, d, depth=3):
    seeds = table(spark, d, "region").where("r_regionkey < 2").selectExpr(f"{BASE} + r_regionkey as form_id", "r_name as tag")
    return graph.referencers(edges(spark, d), seeds, depth, tags=True)


@query(E + f" SELECT e.src, e.src_sig FROM edges e WHERE e.dst = {2 * BASE + 7}")
def refs_depth1(spark, d):
    return edges(spark, d).where(F.col("dst") == 2 * BASE + 7).select("src", "src_sig")


@query(WALK + "SELECT form_id, depth, origin FROM g")
def refs_depth3(spark, d):
    return _walk(spark, d).drop("tags")


@query(WALK + "SELECT form_id, depth, tags FROM g WHERE depth <= 2")
def carriers_tags(spark, d):
    return _walk(spark, d, 2).select("form_id", "depth", F.array_join("tags", ",").alias("tags"))


@query(WALK + f"SELECT form_id, depth FROM g WHERE form_id // {BASE} = 6")
def refs_type_filter(spark, d):
    return _walk(spark, d).where(F.floor(F.col("form_id") / BASE) == 6).select("form_id", "depth")


@query(WALK + "SELECT depth, count(*) AS n FROM g GROUP BY depth")
def refs_per_depth(spark, d):
    return graph.walk_statistics(_walk(spark, d), edges(spark, d), 3)


@query(
    f"""WITH RECURSIVE edges AS ({edges_sql(("ORDR", "CUST", "NATN"))}), p AS (SELECT {6 * BASE} + o_orderkey AS from_id, {BASE} + o_custkey % 5 AS to_id FROM orders),
    w AS (SELECT from_id, from_id AS node, 0 AS d FROM p UNION SELECT w.from_id, e.dst, w.d + 1 FROM w JOIN edges e ON e.src = w.node),
    m AS (SELECT from_id, node, min(d)::BIGINT AS hops FROM w GROUP BY ALL)
    SELECT p.from_id, p.to_id, m.hops FROM p LEFT JOIN m ON m.from_id = p.from_id AND m.node = p.to_id"""
)
def ref_path_hops(spark, d):
    pairs = table(spark, d, "orders").selectExpr(f"{6 * BASE} + o_orderkey as from_id", f"{BASE} + o_custkey % 5 as to_id")
    return graph.path_hops(edges(spark, d), pairs, 6)


@query(E + f", x AS (SELECT DISTINCT src_sig, src FROM edges WHERE dst // {BASE} = 2), r AS (SELECT *, row_number() OVER (PARTITION BY src_sig ORDER BY src) AS k FROM x) SELECT src_sig, count(*) AS n, string_agg(src::VARCHAR, ',' ORDER BY src) FILTER (k <= 5) AS samples FROM r GROUP BY src_sig")
def refs_digest(spark, d):
    return graph.digest(edges(spark, d).where(F.floor(F.col("dst") / BASE) == 2))


@query(E + " SELECT DISTINCT src, dst FROM edges WHERE src_sig = 'LINE'")
def outgoing_ids(spark, d):
    return edges(spark, d, ("LINE",)).select("src", "dst").distinct()


RELATED = f"""WITH edges AS ({edges_sql()}), f AS (SELECT src, dst, CASE WHEN src_sig = 'LINE' AND dst_sig = 'ORDR' THEN 'contained_in' WHEN src_sig = 'LINE' THEN 'uses' WHEN dst_sig = 'NATN' THEN 'found_in' ELSE 'references' END AS relation, 0 AS is_reverse FROM edges WHERE src_sig <> 'LINE' OR dst_sig <> 'SUPP'
UNION ALL SELECT src, dst, 'used_by', 1 FROM edges WHERE src_sig = 'LINE' AND dst_sig <> 'ORDR')"""


@query(RELATED + " SELECT src, dst, arg_min(relation, is_reverse) AS relation, min(is_reverse)::BIGINT AS is_reverse FROM f GROUP BY src, dst")
def edge_relation(spark, d):
    e = edges(spark, d)
    named = rules.first_rule([((F.col("src_sig") == "LINE") & (F.col("dst_sig") == "ORDR"), "contained_in"), (F.col("src_sig") == "LINE", "uses"), (F.col("dst_sig") == "NATN", "found_in")], "references")
    forward = e.where("src_sig <> 'LINE' or dst_sig <> 'SUPP'").select("src", "dst", named.alias("relation"))
    backward = e.where("src_sig = 'LINE' and dst_sig <> 'ORDR'").select("src", "dst", F.lit("used_by").alias("relation"))
    return graph.first_edges(forward, backward).withColumn("is_reverse", F.col("is_reverse").cast("long"))


CONNECT = "e AS (SELECT c_custkey AS src, c_custkey - c_nationkey - 1 AS dst FROM customer WHERE c_custkey - c_nationkey - 1 >= 1), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), g AS (SELECT src AS node, count(DISTINCT dst) AS degree FROM b GROUP BY src)"


def _connect(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey as src", "c_custkey - c_nationkey - 1 as dst").where("dst >= 1")


@query(f"WITH {CONNECT} SELECT node, degree FROM g")
def degrees(spark, d):
    return graph.degrees(_connect(spark, d))


@query(
    f"WITH RECURSIVE {CONNECT}, h AS (SELECT node FROM g WHERE degree > 3), l AS (SELECT src, dst FROM b WHERE src NOT IN (SELECT node FROM h) AND dst NOT IN (SELECT node FROM h)), r AS (SELECT node, node AS reach FROM g UNION SELECT r.node, l.dst FROM r JOIN l ON l.src = r.reach) SELECT node, min(reach) AS component FROM r GROUP BY node"
)
def components_hub(spark, d):
    links = _connect(spark, d)
    nodes = links.selectExpr("src as node").union(links.selectExpr("dst")).distinct()
    return graph.components(links, nodes, 3)


ORDER_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '5-LOW' THEN 1 ELSE 0 END"


@query(f"SELECT o_custkey, arg_max(o_orderkey, ROW({ORDER_SQL}, o_totalprice, -o_orderkey)) AS anchor FROM orders GROUP BY o_custkey")
def anchor_pick(spark, d):
    order = rules.priority(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    members = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("form_id"), order.alias("priority"), F.col("o_totalprice").alias("weight"), F.lit(0).alias("degree"))
    return rules.anchors(members, "o_custkey")


@query("SELECT * FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 12")
def topk_context(spark, d):
    return graph.top_per_group(table(spark, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], 12).select("c_nationkey", "c_custkey", "rank")


# Snapshot differences


def _pair(spark, d):
    a = records(spark, d)
    return a, second_snapshot(a)


FIELDS = ["name", "value"]
CHANGED = PAIR + ", x AS (SELECT a.sig, a.form_id, a.name AS n1, b.name AS n2, a.value AS v1, b.value AS v2 FROM a JOIN b USING (form_id)), c AS (SELECT sig, form_id, 'name' AS path, n1 AS \"from\", n2 AS \"to\", NULL::DOUBLE AS from_number, NULL::DOUBLE AS to_number FROM x WHERE n1 IS DISTINCT FROM n2 UNION ALL SELECT sig, form_id, 'value', NULL, NULL, v1, v2 FROM x WHERE v1 IS DISTINCT FROM v2)"


def _changes(spark, d):
    a, b = _pair(spark, d)
    both = diff.snapshot_diff(a, b, "form_id", ["sig", *FIELDS]).withColumn("sig", F.coalesce("new.sig", "old.sig"))
    return diff.field_changes(both, "form_id", FIELDS)


@query(PAIR + " SELECT b.form_id, b.sig FROM b ANTI JOIN a ON a.form_id = b.form_id")
def diff_added(spark, d):
    a, b = _pair(spark, d)
    return diff.snapshot_diff(a, b, "form_id", ["sig", *FIELDS]).where("status = 'added'").select("form_id", "new.sig")


@query(PAIR + " SELECT a.form_id, a.sig FROM a ANTI JOIN b ON a.form_id = b.form_id")
def diff_removed(spark, d):
    a, b = _pair(spark, d)
    return diff.snapshot_diff(a, b, "form_id", ["sig", *FIELDS]).where("status = 'removed'").select("form_id", "old.sig")


@query(CHANGED + ' SELECT sig, form_id, path, "from", "to", from_number, to_number FROM c')
def diff_changed_fields(spark, d):
    rows = _changes(spark, d)
    # Texts of numbers differ between engines, so numbers have columns of their own.
    sides = [F.when(F.col("path") == "name", F.col(c)).alias(c) for c in ("from", "to")]
    return rows.select("sig", "form_id", "path", *sides, *[F.when(F.col("path") == "value", F.col(c).cast("double")).alias(f"{c}_number") for c in ("from", "to")])


@query(CHANGED + " SELECT sig, path, count(*) AS n FROM c GROUP BY sig, path")
def diff_counts(spark, d):
    return _changes(spark, d).groupBy("sig", "path").agg(F.count(F.lit(1)).alias("n"))


@query(CHANGED + """, g AS (SELECT sig, path, "from", "to", count(DISTINCT form_id) AS n FROM c WHERE path = 'name' GROUP BY ALL HAVING count(DISTINCT form_id) >= 5) SELECT sig, path, "from", "to", n, printf('CC%03d', row_number() OVER (ORDER BY sig, path, "from" NULLS FIRST, "to" NULLS FIRST)) AS cc_id FROM g""")
def common_changes(spark, d):
    return diff.common_changes(_changes(spark, d).where("path = 'name'"), 5)


@query(CHANGED + ", s AS (SELECT sig, form_id, string_agg(DISTINCT path, ',' ORDER BY path) AS shape FROM c GROUP BY sig, form_id), k AS (SELECT *, row_number() OVER (PARTITION BY sig, shape ORDER BY form_id) AS r FROM s) SELECT sig, shape, count(*) AS n, string_agg(form_id::VARCHAR, ',' ORDER BY form_id) FILTER (r <= 3) AS examples FROM k GROUP BY sig, shape HAVING count(*) >= 20")
def rollout_shapes(spark, d):
    return diff.rollout_shapes(_changes(spark, d))


SETS = "WITH a AS (SELECT l_orderkey, l_partkey % 7 AS item FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT l_orderkey, l_partkey % 7 AS item FROM lineitem WHERE l_linenumber >= 2), n AS (SELECT l_orderkey, item, sum(k) AS n FROM (SELECT l_orderkey, item, 1 AS k FROM a UNION ALL SELECT l_orderkey, item, -1 FROM b) GROUP BY ALL)"


@query(SETS + " SELECT l_orderkey, item, greatest(n, 0)::BIGINT AS removed, greatest(-n, 0)::BIGINT AS added FROM n WHERE n <> 0")
def diff_set_array(spark, d):
    lines = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_partkey % 7 as item", "l_linenumber")
    return diff.set_difference(lines.where("l_linenumber <= 4").drop("l_linenumber"), lines.where("l_linenumber >= 2").drop("l_linenumber"), "l_orderkey", "item").withColumns({c: F.col(c).cast("long") for c in ("removed", "added")})


@query("WITH x AS (SELECT l_shipmode AS leaf, v AS value FROM (SELECT l_returnflag AS l_shipmode, l_quantity::BIGINT AS v, l_linenumber FROM lineitem) WHERE l_linenumber <= 2), y AS (SELECT DISTINCT l_returnflag AS leaf, l_quantity::BIGINT AS value FROM lineitem WHERE l_linenumber = 7 AND l_discount = 0.1 AND l_tax = 0.08) SELECT leaf, value, count(*) AS n FROM x ANTI JOIN y USING (leaf, value) GROUP BY leaf, value HAVING count(*) >= 100")
def calibrated_defaults(spark, d):
    lines = table(spark, d, "lineitem").selectExpr("l_returnflag as leaf", "cast(l_quantity as bigint) as value", "l_linenumber", "l_discount", "l_tax")
    return diff.calibrated_defaults(lines.where("l_linenumber <= 2"), lines.where("l_linenumber = 7 and l_discount = 0.1 and l_tax = 0.08"), 100)


# Odds of selection lists

#: Line numbers repeat within an order; rows that agree in all of these are alike.
LINE_ORDER = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_extendedprice)"
LISTS = f"WITH e AS (SELECT l_orderkey AS list_id, {LINE_ORDER} AS ordinal, l_discount * 4.7123 AS p, l_quantity AS quantity, l_partkey FROM lineitem)"


def _lists(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey as list_id", f"cast({LINE_ORDER} as bigint) as ordinal", "l_discount * 4.7123D as p", "l_quantity as quantity", "l_partkey")


@query(LISTS + " SELECT list_id, ordinal, round(p * coalesce(product(1 - p) OVER (PARTITION BY list_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1), 6) AS chosen FROM e")
def first_match_odds(spark, d):
    return odds.first_match(_lists(spark, d), "list_id").select("list_id", "ordinal", F.round("chosen", 6).alias("chosen"))


@query(LISTS + " SELECT list_id, round(1 - product(1 - p), 6) AS presence, round(sum(p * quantity), 6) AS expected FROM e GROUP BY list_id")
def use_all_odds(spark, d):
    return _lists(spark, d).groupBy("list_id").agg(F.round(odds.use_all(F.col("p")), 6).alias("presence"), F.round(F.sum(F.col("p") * F.col("quantity")), 6).alias("expected"))


@query(
    LISTS
    + """, l AS (SELECT list_id, list(p ORDER BY ordinal) AS ps, count(*) AS n FROM e GROUP BY list_id),
    s AS (SELECT list_id, ps, n, unnest(range(1, (1 << n::INTEGER)::BIGINT)) AS mask FROM l),
    m AS (SELECT list_id, n, mask, bit_count(mask) AS k, list_product(list_transform(range(1, n + 1), lambda i: CASE WHEN (mask >> (i - 1)::BIGINT) & 1 = 1 THEN ps[i] ELSE 1 - ps[i] END)) AS w FROM s)
    SELECT list_id, i AS ordinal, round(sum(w / k), 6) AS chosen FROM (SELECT list_id, w, k, mask, unnest(range(1, n + 1)) AS i FROM m) WHERE (mask >> (i - 1)::BIGINT) & 1 = 1 GROUP BY list_id, i"""
)
def pool_odds(spark, d):
    return odds.pool(_lists(spark, d), "list_id").select("list_id", "ordinal", F.round("chosen", 6).alias("chosen"))


@query(LISTS + ", r AS (SELECT *, sum(CASE WHEN lag_or THEN 0 ELSE 1 END) OVER (PARTITION BY list_id ORDER BY ordinal) AS run FROM (SELECT *, coalesce(lag(quantity > 25) OVER (PARTITION BY list_id ORDER BY ordinal), false) AS lag_or FROM e)), g AS (SELECT list_id, run, 1 - product(1 - p) AS g FROM r GROUP BY list_id, run) SELECT list_id, round(product(g), 6) AS gate FROM g GROUP BY list_id")
def gate_probability(spark, d):
    gates = _lists(spark, d).withColumn("or_next", F.col("quantity") > 25)
    return odds.gate_probability(gates, ["list_id"]).select("list_id", F.round("gate", 6).alias("gate"))


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, 0.4937 AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal FROM orders),
    c AS (SELECT o_custkey, o_orderkey, p * power(1 - p, ordinal - 1) AS chosen FROM o),
    t AS (SELECT l_orderkey, l_partkey, 1 - product(1 - l_discount * 0.9713) AS presence, sum(l_discount * 0.9713 * l_quantity) AS expected FROM lineitem GROUP BY ALL)
    SELECT o_custkey AS list_id, l_partkey AS item, round(least(sum(chosen * presence), 1), 6) AS presence, round(sum(chosen * expected), 6) AS expected FROM c JOIN t ON t.l_orderkey = c.o_orderkey GROUP BY o_custkey, l_partkey"""
)
def drop_table(spark, d):
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("list_id").orderBy("target")).cast("long")
    orders = table(spark, d, "orders")
    upper = orders.selectExpr("o_custkey as list_id", "'first' as mode", f"o_orderkey + {BASE} as target", "true as is_list", "0.4937D as p", "1.0D as quantity", "1.0D as list_factor").withColumn("ordinal", number)
    lower = table(spark, d, "lineitem").selectExpr(f"l_orderkey + {BASE} as list_id", "'all' as mode", "l_partkey as target", "false as is_list", "l_discount * 0.9713D as p", "l_quantity as quantity", "1.0D as list_factor", "cast(l_linenumber as bigint) as ordinal")
    out = odds.drop_tables(upper.unionByName(lower), 2).where(F.col("list_id") < BASE)
    return out.select("list_id", "item", F.round("presence", 6).alias("presence"), F.round("expected", 6).alias("expected"))


@query(LISTS + " SELECT list_id, ordinal, n AS starves FROM (SELECT list_id, ordinal, p, count(*) OVER (PARTITION BY list_id ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM e) WHERE p >= 0.45 AND n > 0")
def starvation_audit(spark, d):
    return odds.starved(_lists(spark, d), "list_id", 0.45).select("list_id", "ordinal", "starves")


@query(LISTS + ", g AS (SELECT *, count(*) OVER (PARTITION BY list_id) AS n FROM e WHERE p > 0 AND p < 1) SELECT list_id, ordinal, round(p * coalesce(product(1 - p) OVER (PARTITION BY list_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1), 6) AS cascade_odds FROM g WHERE n >= 2")
def overlap_ladder(spark, d):
    return odds.ladders(_lists(spark, d), "list_id").select("list_id", "ordinal", F.round("cascade_odds", 6).alias("cascade_odds"))


@query("SELECT l_orderkey AS list_id, count(DISTINCT floor(l_quantity / 10)) AS tiers FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT floor(l_quantity / 10)) > 1")
def level_tiers(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("list_id")).agg(F.count_distinct(F.floor(F.col("l_quantity") / 10)).alias("tiers")).where("tiers > 1")


# Curves

CURVE = "WITH c AS (SELECT p_brand, p_size AS x, avg(p_retailprice) AS y FROM part GROUP BY ALL), q AS (SELECT DISTINCT p_brand, p_partkey % 60 + 0.5 AS x FROM part), b AS (SELECT p_brand, min(x) AS lo, max(x) AS hi, arg_min(y, x) AS ylo, arg_max(y, x) AS yhi FROM c GROUP BY p_brand), s AS (SELECT p_brand, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM c WINDOW w AS (PARTITION BY p_brand ORDER BY x))"


def _curves(spark, d):
    points = table(spark, d, "part").groupBy("p_brand", F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("y"))
    return points.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points"))


@query(CURVE + " SELECT q.p_brand, q.x::DOUBLE AS x, round(CASE WHEN q.x <= b.lo THEN ylo WHEN q.x >= b.hi THEN yhi ELSE (SELECT s.y + (s.y2 - s.y) * (q.x - s.x) / (s.x2 - s.x) FROM s WHERE s.p_brand = q.p_brand AND s.x < q.x AND s.x2 >= q.x) END, 4) AS y FROM q JOIN b USING (p_brand)")
def curve_eval(spark, d):
    asked = table(spark, d, "part").selectExpr("p_brand", "cast(p_partkey % 60 + 0.5 as double) as x").distinct()
    return asked.join(_curves(spark, d), "p_brand").select("p_brand", "x", F.round(scalar.curve_value(F.col("points"), F.col("x")), 4).alias("y"))


@query("SELECT p_brand, round(min(y), 4) AS low, round(max(y), 4) AS high FROM (SELECT p_brand, p_size, avg(p_retailprice) AS y FROM part GROUP BY ALL) GROUP BY p_brand")
def curve_range(spark, d):
    span = scalar.curve_range(F.col("points"))
    return _curves(spark, d).select("p_brand", F.round(span["low"], 4).alias("low"), F.round(span["high"], 4).alias("high"))


@query("SELECT p_partkey, round(p_retailprice * greatest(0.01, least(0.99, power(0.15 * p_retailprice / p_size, 0.365))), 4) AS through FROM part WHERE p_size > 0")
def resistance(spark, d):
    return table(spark, d, "part").where("p_size > 0").select("p_partkey", F.round(scalar.resisted(F.col("p_retailprice"), F.col("p_size")), 4).alias("through"))


# Rules


@query("SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_partkey % 17 = 0 AND l_partkey % 19 <> 0")
def dangling_refs(spark, d):
    parts = table(spark, d, "part").selectExpr("p_partkey as form_id")
    lines = table(spark, d, "lineitem").selectExpr("l_orderkey as src", "l_partkey as dst")
    return rules.dangling(lines, parts.where("form_id % 17 <> 0"), parts.where("form_id % 19 = 0")).select("src", "dst")


@query("SELECT c_custkey AS form_id FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') o ON o_custkey = c_custkey")
def unreferenced(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return rules.unreferenced(table(spark, d, "customer").selectExpr("c_custkey as form_id"), urgent.selectExpr("o_custkey as dst"))


@query("SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'rollout' WHEN bool_or(o_totalprice > 400000) THEN 'deep' WHEN count(*) < 5 THEN 'drop' WHEN max(o_totalprice) < 300000 THEN 'brief' ELSE 'ambiguous' END AS tier FROM orders GROUP BY o_custkey")
def tiers(spark, d):
    flags = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_totalprice") > 400000).alias("deep"), F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("m"))
    return flags.select("o_custkey", rules.first_rule([(F.col("f"), "rollout"), (F.col("deep"), "deep"), (F.col("n") < 5, "drop"), (F.col("m") < 300000, "brief")], "ambiguous").alias("tier"))


@query("WITH f AS (SELECT 'negative' AS rule, c_custkey AS form_id FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'orderless', c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey) SELECT rule, form_id, printf('L%04d', row_number() OVER (ORDER BY rule, form_id)) AS lint_id FROM f")
def lints(spark, d):
    customers = table(spark, d, "customer").withColumnRenamed("c_custkey", "form_id")
    return rules.lint_rows(("negative", customers.where("c_acctbal < 0")), ("orderless", rules.unreferenced(customers, table(spark, d, "orders").selectExpr("o_custkey as dst"))))


@query("SELECT p_partkey, regexp_matches(lower(p_name), '^.*a.*$') AS glob, lower(p_brand) = 'brand#13' AS exact FROM part")
def name_match(spark, d):
    return table(spark, d, "part").select("p_partkey", scalar.any_of(F.col("p_name"), ["*A*"]).alias("glob"), scalar.exact_or_glob(F.col("p_brand"), "Brand #13", spaces=False).alias("exact"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
