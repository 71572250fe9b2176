"""What changed between two snapshots, and the edges from it, without working either out twice."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomrec.operators import diff, walks
from loomrec.plans import model, walk_queries

TABLES = "region nation customer supplier part orders lineitem".split()


def test_context_incidence_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    wanted = con.execute(f"SELECT context, bundle, n FROM ({walk_queries.oracle_sql()['context_incidence']})").fetchall()
    assert sorted(tuple(r) for r in walk_queries.context_incidence(spark, sf_dir).select("context", "bundle", "n").collect()) == sorted(wanted)


@pytest.mark.parametrize("name", ["context_incidence", "edge_split"])
def test_lines_are_shuffled_once_to_be_numbered_and_once_as_edges(spark, sf_dir, monkeypatch, name):
    plans = []
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    real = walks.write_through
    monkeypatch.setattr(walks, "write_through", lambda df, *a, **b: plans.append(shown(df)) or real(df, *a, **b))
    plans.append(shown(walk_queries.queries()[name](spark, sf_dir)))
    universe, rest = plans
    assert universe.count("Exchange hashpartitioning(l_orderkey") == 1 and universe.count("Scan parquet") == 7 and "Join" not in universe
    assert rest.count("Scan parquet") <= 5 + 2 and "Window" not in rest and "FullOuter" not in rest and rest.count("Join") <= 2


def test_changed_keys_are_those_of_the_full_join(spark):
    rnd = random.Random(11)
    side = lambda: [(rnd.choice([None, *range(400)]), rnd.choice([None, "a", "b"]), rnd.choice([None, 1.0, 2.0, float("nan")])) for _ in range(300)]
    kind = "form_id long, name string, value double"
    old, new = side(), side()
    new += rnd.sample(old, 150)
    a, b = spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)
    wanted = {r["form_id"] for r in diff.snapshot_diff(a, b, "form_id", ["name", "value"]).select("form_id").distinct().collect()}
    apart = a.withColumn("sides", F.lit(1)).unionByName(b.withColumn("sides", F.lit(2)))
    got = [r["form_id"] for r in diff.changed_keys(apart, "form_id", ["name", "value"]).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and len({k for k, *_ in old} - wanted) > 5
    once = spark.createDataFrame([(1, "a", None, 3), (2, None, None, 3), (2, None, None, 1), (3, "a", 1.0, 3), (3, "a", 2.0, 2), (4, "a", 1.0, 1), (5, "a", 1.0, 2)], kind + ", sides int")
    assert sorted(r["form_id"] for r in diff.changed_keys(once, "form_id", ["name", "value"]).collect()) == [3, 4, 5]


def test_both_snapshots_are_the_first_and_the_second(spark, sf_dir):
    odd = [("CUST", 3 * model.BASE + k, f"e{k}", n, v) for k in range(800) for n, v in [("Name", 1.0), ("low", None), (None, 1e300)][k % 3 : k % 3 + 1]]
    odd += [("CUST", 3 * model.BASE + 19 + (1 << 30), "e", "Name", 1.0), ("CUST", None, "e", "Name", 1.0), *odd[:60]]
    for first in (spark.createDataFrame(odd, "sig string, form_id long, editor_id string, name string, value double"), model.records(spark, sf_dir)):
        rows = model.both_snapshots(first)
        for bit, snapshot in ((1, first), (2, model.second_snapshot(first))):
            told = rows.where(F.col("sides").bitwiseAND(bit) != 0).drop("sides")
            plain = snapshot.select("form_id", "name", "value")
            assert told.exceptAll(plain).isEmpty() and plain.exceptAll(told).isEmpty()
        assert rows.where("sides = 3").count() > 0.5 * rows.count()
        ids = {r["form_id"] for r in diff.changed_keys(rows, "form_id", ["name", "value"]).collect()}
        assert ids == {r["form_id"] for r in diff.snapshot_diff(first, model.second_snapshot(first), "form_id", ["name", "value"]).select("form_id").collect()}


def test_references_are_the_edges(spark, sf_dir):
    taken = model.references(spark, sf_dir).select("src", F.explode("targets").alias("dst")).where("dst is not null")
    plain = model.edges(spark, sf_dir).select("src", "dst")
    assert taken.exceptAll(plain).isEmpty() and plain.exceptAll(taken).isEmpty()


def test_targets_and_bundles_of_an_id(spark):
    rows = [(11, [2, None, 11]), (11, [2, 12]), (12, [2]), (21, [2, 3, 3]), (30, [2]), (None, [2])]
    universe = spark.createDataFrame([(11,), (12,), (21,), (11,), (None,)], "form_id long")
    packed = spark.createDataFrame(rows, "src long, targets array<long>")
    apart = spark.createDataFrame([(a, b) for a, bs in rows for b in bs if b is not None], "src long, dst long")
    told = lambda edges: sorted(tuple(r) for r in walks.marked_edges(edges, universe).select("src", "dst", "inside").collect())
    assert told(packed) == told(apart) == [(11, 2, False), (11, 2, False), (11, 11, True), (11, 12, True), (12, 2, False), (21, 2, False), (21, 3, False), (21, 3, False)]
    inside, context = walks.split_edges(packed, universe, once=True)
    assert sorted(tuple(r) for r in inside.select("src", "dst").collect()) == [(11, 11), (11, 12)]
    bundle = F.floor(F.col("src") / 10)
    members = universe.distinct().select("form_id", F.floor(F.col("form_id") / 10).alias("bundle"))
    for given in (bundle, members):
        assert sorted(tuple(r) for r in walks.incidence(context, given).select("context", "bundle", "n").collect()) == [(2, 1, 2), (2, 2, 1), (3, 2, 1)]
