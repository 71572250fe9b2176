"""Walks, paths, numbering, leaves and pool odds against brute force; the queries on them against their SQL."""

import json
import random
from collections import deque
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from loomrec.operators import graph as graph_operators
from loomrec.operators import listings, lookup, odds, walks
from loomrec.plans import walk_queries

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.mark.parametrize("name", ["refs_paths", "refs_figures", "ref_path_nodes", "consumers_by_type", "edge_split", "orphaned_unique", "membership_changes", "key_union", "blocked_entries", "scalar_forms"])
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    frame = walk_queries.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    cursor = con.execute(walk_queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    wanted = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr) == wanted


def graph(rnd, n, m):
    return sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)})


def test_walk_against_brute_force(spark):
    rnd = random.Random(5)
    links = graph(rnd, 40, 70)
    edges = spark.createDataFrame(links, "src long, dst long")
    for depth in (0, 1, 3, 9):
        rows = walks.walk(edges, spark.createDataFrame([(3,), (7,), (7,), (39,)], "form_id long"), depth)
        least = {s: (0, s, [s]) for s in (3, 7, 39)}
        front = dict(least)
        for hop in range(1, depth + 1):
            new = {}
            for a, b in links:
                if b in front and a not in least:
                    offer = (hop, front[b][1], front[b][2] + [a])
                    new[a] = min(new.get(a, offer), offer)
            least |= new
            front = new
        assert {r["form_id"]: (r["depth"], r["origin"], r["path"]) for r in rows.collect()} == least
        figures = {r["depth"]: r for r in walks.walk_figures(rows, edges, depth).collect()}
        for d, r in figures.items():
            beyond = {a for a, b in links if b in least and least[b][0] == d and a not in least}
            assert (r["n"], r["frontier_remaining"], r["depth_capped"]) == (sum(x[0] == d for x in least.values()), len(beyond), d == depth and bool(beyond))


def test_shortest_paths_against_brute_force(spark):
    rnd = random.Random(6)
    links = graph(rnd, 30, 55)
    after = {}
    for a, b in links:
        after.setdefault(a, []).append(b)
    pairs = sorted({(rnd.randrange(30), rnd.randrange(30)) for _ in range(120)})
    for most in (4, 12):
        got = {(r["from_id"], r["to_id"]): (r["hops"], r["path"]) for r in walks.shortest_paths(spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame(pairs, "from_id long, to_id long"), most).collect()}
        for a, b in pairs:
            best, queue = {}, deque([[a]])
            while queue:
                path = queue.popleft()
                if path[-1] in best and (len(path), path) >= best[path[-1]] or len(path) > most + 1:
                    continue
                best[path[-1]] = (len(path), path)
                queue.extend(path + [x] for x in after.get(path[-1], []))
            assert got[a, b] == ((best[b][0] - 1, best[b][1]) if b in best else (None, None))


def test_hops_leave_out_edges_that_cannot_join(spark):
    rows = spark.createDataFrame([(5,), (9,)], "node long")
    kept = spark.range(20).withColumnRenamed("id", "node")
    assert [r["node"] for r in kept.where(graph_operators.span(rows, "node")).orderBy("node").collect()] == list(range(5, 10))
    assert kept.where(graph_operators.span(rows.limit(0), "node")).count() == 0
    rnd = random.Random(9)
    links = graph(rnd, 30, 55)
    pairs = sorted({(rnd.randrange(30), rnd.randrange(30)) for _ in range(120)})
    for most in (1, 4, 12):
        got = {(r["from_id"], r["to_id"]): r["hops"] for r in graph_operators.path_hops(spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame(pairs, "from_id long, to_id long"), most).collect()}
        for a, b in pairs:
            depth, front, seen = 0, {a}, {a}
            while b not in front and front and depth < most:
                front = {y for x, y in links if x in front} - seen
                seen |= front
                depth += 1
            assert got[a, b] == (depth if b in front else None)


def test_live_referencers(spark):
    edges = spark.createDataFrame([(1, "A", 2), (2, "B", 3), (3, "B", 4), (4, "B", 5), (5, "B", 6), (9, "B", 8), (6, "B", 6)], "src long, src_sig string, dst long")
    ids = spark.createDataFrame([(k,) for k in range(2, 9)], "form_id long")
    for depth, alone in ((1, {3, 4, 5, 6, 7, 8}), (2, {4, 5, 6, 7, 8}), (4, {6, 7, 8}), (9, {7, 8})):
        assert {r["form_id"] for r in walks.without_live_referencer(ids, edges, ["A"], depth).collect()} == alone


def test_numbered_is_the_order_of_all_rows(spark):
    rnd = random.Random(7)
    rows = [(rnd.randrange(50) if rnd.random() < 0.9 else None, k) for k in range(3000)]
    frame = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = lookup.numbered(frame, [F.col("a").desc_nulls_last(), "b"], "n").orderBy("n").collect()
    assert [(r["a"], r["b"]) for r in got] == sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1])) and [r["n"] for r in got] == list(range(1, 3001))
    assert lookup.numbered(frame.limit(0), ["a"], "n").count() == 0


def test_leaves_of_many_bodies(spark):
    bodies = [{"a": 1, "b": {"c": [1, {"d": None}, [2, "x"]], "e": {}}, "f.g": []}, [1, [2]], 5, None, {"z": "t"}]

    def walk(v, path):
        if isinstance(v, dict):
            return [x for k in v for x in walk(v[k], f"{path}.{k}" if path else k)]
        if isinstance(v, list):
            return [x for e in v for x in walk(e, path + "[]")]
        return [(path, json.dumps(v))] if path else []

    frame = spark.createDataFrame([(k, json.dumps(b)) for k, b in enumerate(bodies)], "id int, t string").select("id", F.parse_json("t").alias("body"))
    got = sorted((r["id"], r["path"], r["leaf"]) for r in lookup.leaves(frame, "id", "body").select("id", "path", F.to_json("leaf").alias("leaf")).collect())
    assert got == sorted((k, p, v) for k, b in enumerate(bodies) for p, v in walk(b, ""))
    many = spark.range(600_000).select(F.col("id"), F.parse_json(F.lit('{"a": 1, "b": [2, 3]}')).alias("body"))
    assert lookup.leaves(many, "id", "body").groupBy("path").count().orderBy("path").collect() == [("a", 600_000), ("b[]", 1_200_000)]


def test_pool_odds_of_long_lists(spark):
    rnd = random.Random(8)
    chances = [round(rnd.random(), 3) for _ in range(40)]
    rows = spark.createDataFrame([(1, k, p) for k, p in enumerate(chances)], "list_id long, ordinal long, p double")
    got = {r["ordinal"]: r["chosen"] for r in odds.pool(rows, "list_id").collect()}
    for i in (0, 17, 39):
        spread = [Fraction(1)]
        for j, p in enumerate(chances):
            if j != i:
                q = Fraction(str(p))
                spread = [(spread[k] if k < len(spread) else 0) * (1 - q) + (spread[k - 1] if k else 0) * q for k in range(len(spread) + 1)]
        assert got[i] == pytest.approx(float(Fraction(str(chances[i])) * sum(x / (k + 1) for k, x in enumerate(spread))))
    rough = {r["ordinal"]: r["chosen"] for r in odds.pool(rows, "list_id", estimate_over=20).collect()}
    assert rough[3] == pytest.approx(chances[3] / sum(chances))


def test_memberships(spark):
    rows = [(1, [1, 1, 2], [2, 3]), (2, [5], [5, 5]), (3, [], [1]), (4, [None, 1], [1])]
    got = {r["k"]: (r["removed"], r["added"]) for r in listings.membership_changes(spark.createDataFrame(rows, "k int, old array<int>, new array<int>"), "k").collect()}
    assert got == {1: ([1], [3]), 3: ([], [1]), 4: ([None], [])}


def test_the_universe_is_worked_out_once(spark, sf_dir):
    plan = walk_queries.edge_split(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "FullOuter" not in plan
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 1), (3, 1)], "src long, dst long")
    inside, context = walks.split_edges(edges, spark.createDataFrame([(1,), (2,), (2,)], "form_id long"))
    assert sorted(map(tuple, inside.select("src", "dst").collect())) == [(1, 2), (2, 1), (2, 1)] and list(map(tuple, context.select("src", "dst").collect())) == [(1, 3)]


def test_leaves_of_four_levels_are_one_job(spark, monkeypatch):
    written = []
    real = lookup.write_through
    monkeypatch.setattr(lookup, "write_through", lambda *a, **b: written.append(real(*a, **b)) or written[-1])
    text = '{"a": [{"b": {"c": 1}, "d": {}, "e": [], "f": null}], "g": "0x1", "h": {"formid": "0x2"}}'
    body = spark.createDataFrame([(1, text)], "id int, t string").select("id", F.parse_json("t").alias("body"))
    told = lambda rows: sorted((r["path"], r["j"]) for r in rows.select("path", F.to_json("leaf").alias("j")).collect())
    assert told(lookup.leaves(body, "id", "body")) == [("a[].b.c", "1"), ("a[].f", "null"), ("g", '"0x1"'), ("h.formid", '"0x2"')] and len(written) == 1
    assert told(lookup.leaves(body, "id", "body", lambda v: F.try_variant_get(v, "$.formid", "variant").isNotNull(), lambda v: F.to_json(v).contains("0x"))) == [("g", '"0x1"'), ("h", '{"formid":"0x2"}')]
    deep = spark.createDataFrame([(1, '{"a": ' * 9 + "[7]" + "}" * 9)], "id int, t string").select("id", F.parse_json("t").alias("body"))
    assert told(lookup.leaves(deep, "id", "body")) == [(".".join("a" * 9) + "[]", "7")]
