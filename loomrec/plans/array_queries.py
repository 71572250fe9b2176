"""Registered queries on nested arrays, change entries and carriers, each with its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrec.operators import arrays, carriers, changes
from loomrec.plans.model import table

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def add(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def _lines(spark, d):
    """l_orderkey, lines: an order's lines in order, with component, rank, count and slot."""
    line = F.struct(F.col("l_linenumber").cast("int").alias("n"), F.col("l_partkey").alias("p"), F.col("l_quantity").cast("int").alias("q"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return rows.withColumn("lines", F.expr("transform(lines, (l, i) -> struct(concat('0x', hex(l.p)) as Component, l.q as Count, l.n as Rank, i as Slot, l.p as p))"))


def _line_pairs(spark, d):
    """Orders as bodies: the second lacks parts of 11, counts those of 7 one higher, and has copies of those of 13 at the end."""
    plain = "l -> struct(l.Component as Component, l.Count as Count, l.Rank as Rank, l.Slot as Slot)"
    kept = "transform(filter(lines, l -> l.p % 11 != 0), l -> struct(l.Component as Component, l.Count + if(l.p % 7 = 0, 1, 0) as Count, l.Rank as Rank, l.Slot as Slot))"
    copies = "transform(filter(lines, l -> l.p % 13 = 0), l -> struct(l.Component as Component, 1 as Count, 9 as Rank, l.Slot + 100 as Slot))"
    sides = {"old": f"transform(lines, {plain})", "new": f"concat({kept}, {copies})"}
    return _lines(spark, d).select("l_orderkey", *[F.to_variant_object(F.struct(F.expr(e).alias("Lines"))).alias(s) for s, e in sides.items()])


LINES = "o AS (SELECT l_orderkey AS k, l_partkey AS p, l_linenumber::INT AS n, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity::INT) - 1 AS slot FROM lineitem)"
#: Keys widen by what comes next in order of names (count, rank, slot) until they are unique on both sides.
MET = f"""WITH {LINES}, s AS (SELECT 'old' AS side, k, slot AS at, p, q, n, slot FROM o UNION ALL
    SELECT 'new', k, row_number() OVER (PARTITION BY k ORDER BY slot) - 1, p, q, n, slot FROM (SELECT k, p, q + CASE WHEN p % 7 = 0 THEN 1 ELSE 0 END AS q, n, slot FROM o WHERE p % 11 <> 0 UNION ALL SELECT k, p, 1, 9, slot + 100 FROM o WHERE p % 13 = 0)),
c AS (SELECT k, count(*) OVER (PARTITION BY k, side, p) AS c1, count(*) OVER (PARTITION BY k, side, p, q) AS c2, count(*) OVER (PARTITION BY k, side, p, q, n) AS c3 FROM s),
l AS (SELECT k, CASE WHEN max(c1) = 1 THEN 1 WHEN max(c2) = 1 THEN 2 WHEN max(c3) = 1 THEN 3 ELSE 4 END AS level FROM c WHERE k IN (SELECT k FROM o WHERE p % 7 = 0 OR p % 11 = 0 OR p % 13 = 0) GROUP BY k),
t AS (SELECT s.*, level, '"0x' || printf('%X', p) || '"' || CASE WHEN level > 1 THEN '|' || q ELSE '' END || CASE WHEN level > 2 THEN '|' || n ELSE '' END || CASE WHEN level > 3 THEN '|' || slot ELSE '' END AS id FROM s JOIN l USING (k)),
m AS (SELECT coalesce(a.k, b.k) AS l_orderkey, array_to_string(['Component', 'Count', 'Rank', 'Slot'][1:coalesce(a.level, b.level)], ',') AS key_fields, coalesce(a.id, b.id) AS id, a.at::INT AS index_from, b.at::INT AS index_to,
    CASE WHEN b.k IS NULL THEN 'removed' WHEN a.k IS NULL THEN 'added' WHEN (a.q, a.n, a.slot) <> (b.q, b.n, b.slot) THEN 'changed' ELSE 'same' END AS status
    FROM (SELECT * FROM t WHERE side = 'old') a FULL JOIN (SELECT * FROM t WHERE side = 'new') b ON a.k = b.k AND a.id = b.id)"""


@query(MET + " SELECT l_orderkey, key_fields, id, index_from, index_to, status FROM m")
def array_keyed(spark, d):
    found = arrays.array_pairs(_line_pairs(spark, d), "l_orderkey", "Lines")
    return found.select("l_orderkey", "key_fields", F.array_join("id", "|").alias("id"), "index_from", "index_to", "status")


@query(MET + " SELECT l_orderkey, 'keyed' AS strategy, key_fields, count(index_from) AS count_from, count(index_to) AS count_to, count(*) FILTER (status = 'removed') AS n_removed, count(*) FILTER (status = 'added') AS n_added, count(*) FILTER (status = 'changed') AS n_changed, count(*) FILTER (status = 'same') AS unchanged_count FROM m GROUP BY l_orderkey, key_fields")
def array_envelopes(spark, d):
    return arrays.envelopes(arrays.array_pairs(_line_pairs(spark, d), "l_orderkey", "Lines"), "l_orderkey")


@query(f"WITH {LINES}, h AS (SELECT DISTINCT k FROM o WHERE p % 7 = 0) SELECT k AS l_orderkey, slot::INT AS at, CASE WHEN p % 7 = 0 THEN 'changed' ELSE 'same' END AS status, '[' || p || ',' || (q + CASE WHEN p % 7 = 0 THEN 1 ELSE 0 END) || ']' AS \"to\" FROM o JOIN h USING (k)")
def array_positional(spark, d):
    each = lambda more: f"transform(lines, l -> array(l.p, l.Count + {more}))"
    bodies = _lines(spark, d).select("l_orderkey", *[F.to_variant_object(F.struct(F.expr(each(m)).alias("Rows"))).alias(s) for s, m in (("old", "0"), ("new", "if(l.p % 7 = 0, 1, 0)"))])
    return arrays.array_pairs(bodies, "l_orderkey", "Rows").select("l_orderkey", F.col("index_from").alias("at"), "status", "to")


@query(None)
def array_ordered(spark, d):
    """Lines that nothing identifies, aligned in order; tested against brute force."""
    texts = {"old": "transform(lines, l -> struct(l.Count % 5 as Turn))", "new": "transform(filter(lines, l -> l.p % 3 != 0), l -> struct(l.Count % 5 as Turn))"}
    bodies = _lines(spark, d).select("l_orderkey", *[F.to_variant_object(F.struct(F.expr(e).alias("Turns"))).alias(s) for s, e in texts.items()])
    return arrays.array_pairs(bodies, "l_orderkey", "Turns").select("l_orderkey", "strategy", "index_from", "index_to", "status")


@query(
    """SELECT p_partkey, 'Name' AS path, 'string' AS kind, '"' || p_name || '"' AS "from", '"' || upper(p_name) || '"' AS "to" FROM part WHERE p_partkey % 2 = 0 AND upper(p_name) <> p_name
    UNION ALL SELECT p_partkey, 'Data.Size', 'scalar', p_size::VARCHAR, (p_size + 1)::VARCHAR FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, 'Data.Kind', 'enum', '{"name":"k' || p_size % 5 || '","value":' || p_size % 5 || '}', CASE WHEN p_partkey % 10 <> 0 THEN '{"name":"k9","value":9}' END FROM part WHERE p_partkey % 5 = 0
    UNION ALL SELECT p_partkey, 'Set', 'flags', '{"flags":["a"]}', '{"flags":["a","b"]}' FROM part WHERE p_partkey % 7 = 0
    UNION ALL SELECT p_partkey, 'Maker', 'formid', '"0x' || printf('%X', p_size) || '"', '"0x0"' FROM part WHERE p_partkey % 4 = 0 AND p_size > 0
    UNION ALL SELECT p_partkey, 'Sizes', 'array', '[' || p_size || ']', '[' || p_size || ',1]' FROM part WHERE p_partkey % 6 = 0"""
)
def change_entries(spark, d):
    was = "struct(p_name as Name, struct(cast(p_size as int) as Size, struct(concat('k', p_size % 5) as name, cast(p_size % 5 as int) as value) as Kind) as Data, struct(array('a') as flags) as Set, concat('0x', hex(p_size)) as Maker, array(cast(p_size as int)) as Sizes)"
    kind = "case when p_partkey % 10 = 0 then null when p_partkey % 5 = 0 then struct('k9' as name, 9 as value) else struct(concat('k', p_size % 5) as name, cast(p_size % 5 as int) as value) end"
    now = (
        f"struct(if(p_partkey % 2 = 0, upper(p_name), p_name) as Name, struct(cast(p_size as int) + if(p_partkey % 3 = 0, 1, 0) as Size, {kind} as Kind) as Data, struct(if(p_partkey % 7 = 0, array('a', 'b'), array('a')) as flags) as Set,"
        " if(p_partkey % 4 = 0, '0x0', concat('0x', hex(p_size))) as Maker, if(p_partkey % 6 = 0, array(cast(p_size as int), 1), array(cast(p_size as int))) as Sizes)"
    )
    # The table is small beside its bodies, so few tasks would read it; bodies are made where its rows are dealt to.
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_size").repartition("p_partkey")
    bodies = rows.select("p_partkey", *[F.to_variant_object(F.expr(e)).alias(s) for s, e in (("old", was), ("new", now))])
    return arrays.change_entries(bodies, "p_partkey")


@query("SELECT DISTINCT l_orderkey, 'Lines[].Component' AS path, '0x' || printf('%X', l_partkey) AS form_id FROM lineitem")
def references_out(spark, d):
    return arrays.references_out(_line_pairs(spark, d), "l_orderkey", "old")


BLOB = """'{{"_raw":true,"hex":"' || CASE WHEN {} THEN '0000' ELSE '00A0' END || '"}}'"""
SAVED = f"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'INFO' ELSE 'QUST' END AS sig, CASE WHEN o_custkey % 3 = 0 THEN 'Data.Previous INFO' ELSE 'Data.Bytes' END AS path,
    CASE WHEN o_orderkey % 5 = 0 THEN {BLOB.format("o_custkey % 2 = 0")} WHEN o_orderkey % 5 = 1 THEN 'null' WHEN o_orderkey % 5 = 2 THEN '1' END AS old,
    CASE WHEN o_custkey % 4 = 0 THEN {BLOB.format("o_orderkey % 3 = 0")} WHEN o_custkey % 4 = 1 THEN '2' END AS new FROM orders"""


@query(
    f"WITH s AS ({SAVED}), t AS (SELECT *, coalesce(old, 'null') = 'null' AS none_old, new IS NULL AS none_new FROM s)"
    """ SELECT o_orderkey, sig, path, old AS "from", new AS "to" FROM t WHERE NOT (none_old AND coalesce(new LIKE '%"0000"}', false) OR none_new AND coalesce(old LIKE '%"0000"}', false) OR none_old AND NOT none_new AND sig = 'INFO' AND path = 'Data.Previous INFO')"""
)
def restamp_noise(spark, d):
    blob = lambda test: f"concat('{{\"_raw\":true,\"hex\":\"', if({test}, '0000', '00A0'), '\"}}')"
    rows = table(spark, d, "orders").selectExpr(
        "o_orderkey",
        "if(o_orderkey % 2 = 0, 'INFO', 'QUST') as sig",
        "if(o_custkey % 3 = 0, 'Data.Previous INFO', 'Data.Bytes') as path",
        f"case when o_orderkey % 5 = 0 then {blob('o_custkey % 2 = 0')} when o_orderkey % 5 = 1 then 'null' when o_orderkey % 5 = 2 then '1' end as from",
        f"case when o_custkey % 4 = 0 then {blob('o_orderkey % 3 = 0')} when o_custkey % 4 = 1 then '2' end as to",
    )
    return changes.without_restamps(rows)


def _carriers(spark, d):
    """Customers whose orders are effects: an entry point from the key, and the priority as scope."""
    point = F.struct(F.struct((F.col("o_orderkey") % 9).alias("value"), F.concat(F.lit("Mod Part "), F.col("o_orderkey") % 9).alias("name")).alias("Point"), F.col("o_orderstatus").alias("Scope"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(point).alias("Effects")).select("o_custkey", F.to_variant_object(F.struct("Effects")).alias("body"))


TAGS = "SELECT o_custkey, min(v) AS first_id, string_agg(v || ' Mod Part ' || v, ',' ORDER BY v) AS tags FROM (SELECT DISTINCT o_custkey, o_orderkey % 9 AS v FROM orders WHERE {}) GROUP BY o_custkey"


def _told(found):
    return found.select("o_custkey", "first_id", F.array_join(F.transform("tags", lambda t: F.concat_ws(" ", t["id"].cast("string"), t["name"])), ",").alias("tags"))


@query(TAGS.format("o_orderkey % 9 IN (3, 4)"))
def entry_point_carriers(spark, d):
    found = _carriers(spark, d)
    return _told(carriers.carriers(found, "o_custkey", "body", "Effects", "$.Point", "*part 3")).unionByName(_told(carriers.carriers(found, "o_custkey", "body", "Effects", "$.Point", "4"))).groupBy("o_custkey").agg(F.min("first_id").alias("first_id"), F.array_join(F.array_sort(F.collect_list("tags")), ",").alias("tags"))


@query(TAGS.format("o_orderstatus = 'F' AND o_orderkey % 9 = 5"))
def property_carriers(spark, d):
    return _told(carriers.carriers(_carriers(spark, d), "o_custkey", "body", "Effects", "$.Point", "5", "F", "$.Scope"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
