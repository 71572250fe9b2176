"""Registered queries against their SQL, and operators against brute force."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomrec.functions import scalar
from loomrec.operators import diff, graph, lookup, odds
from loomrec.plans import queries as record_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A query of each family; the driver runs them all.
CHECKED = ["search_wildcard", "list_type_page", "bulk_get", "nulls_last_sort", "filter_any_element", "field_paths", "carriers_tags", "ref_path_hops", "refs_digest", "components_hub", "diff_changed_fields", "common_changes", "diff_set_array", "pool_odds", "gate_probability", "drop_table", "curve_eval", "lints"]


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    frame = record_queries.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    cursor = con.execute(record_queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr) == wanted


def test_pool_odds_by_enumeration(spark):
    chances = [0.08, 0.20, 0.37, 0.55, 0.75, 1.0]
    rows = spark.createDataFrame([(1, k, p) for k, p in enumerate(chances)], "list_id long, ordinal long, p double")
    got = {r["ordinal"]: r["chosen"] for r in odds.pool(rows, "list_id").collect()}
    for i in range(len(chances)):
        total = 0.0
        for mask in itertools.product([0, 1], repeat=len(chances)):
            if mask[i]:
                w = 1.0
                for m, p in zip(mask, chances, strict=True):
                    w *= p if m else 1 - p
                total += w / sum(mask)
        assert got[i] == pytest.approx(total)
    # The published ladder.
    assert [round(got[k], 4) for k in range(6)] == [0.0220, 0.0566, 0.1096, 0.1719, 0.2522, 0.3877]


def test_drop_table_nests_and_ends_on_cycles(spark):
    rows = [(1, 0, "all", 2, True, 1.0, 0.0, 1.0), (1, 1, "all", 10, False, 0.5, 2.0, 1.0), (2, 0, "first", 10, False, 0.5, 1.0, 0.5), (2, 1, "first", 11, False, 1.0, 1.0, 0.5), (3, 0, "all", 3, True, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "list_id long, ordinal long, mode string, target long, is_list boolean, p double, quantity double, list_factor double")
    got = {(r["list_id"], r["item"]): (r["presence"], r["expected"]) for r in odds.drop_tables(frame, 4).collect()}
    assert got[2, 10] == pytest.approx((0.25, 0.25)) and got[2, 11] == pytest.approx((0.25, 0.25))
    assert got[1, 10] == pytest.approx((1 - 0.5 * 0.75, 1.25)) and got[1, 11] == pytest.approx((0.25, 0.25))
    assert not any(k[0] == 3 for k in got)


def test_walk_against_plain_search(spark):
    rnd = random.Random(4)
    pairs = sorted({(rnd.randrange(40), rnd.randrange(40)) for _ in range(70)})
    edges = spark.createDataFrame([(a, "X", b, "X") for a, b in pairs], "src long, src_sig string, dst long, dst_sig string")
    seeds = spark.createDataFrame([(0, "a"), (1, "b")], "form_id long, tag string")
    seen, front, wanted = {0, 1}, {0, 1}, {}
    for hop in (1, 2, 3, 4):
        front = {a for a, b in pairs if b in front} - seen
        seen |= front
        wanted |= {a: hop for a in front}
    assert {r["form_id"]: r["depth"] for r in graph.referencers(edges, seeds, 4).collect()} == wanted


def test_diff_of_a_snapshot_with_itself_is_empty(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, None, None)], "form_id long, name string, value double")
    assert diff.snapshot_diff(rows, rows, "form_id", ["name", "value"]).count() == 0


def test_wildcards_and_ids(spark):
    rows = spark.createDataFrame([("Iron_Sword",), ("100%",), ("a\\b",), (None,)], "t string")
    pick = lambda p: [r["t"] for r in rows.where(scalar.wildcard(F.col("t"), p)).collect()]
    assert pick("SWORD") == ["Iron_Sword"] and pick("*_s*") == ["Iron_Sword"] and pick("*%") == ["100%"] and pick("a\\*") == ["a\\b"] and pick("iron") == ["Iron_Sword"] and pick("iron*d") == ["Iron_Sword"]
    ids = spark.createDataFrame([("0x1F", 31), ("1F", 31), ("31", 31), (" 0Xff ", 255), ("zz", None), ("", None)], "t string, v long")
    assert ids.where(~scalar.parse_id(F.col("t")).eqNullSafe(F.col("v"))).count() == 0


def test_curve_ends_and_steps(spark):
    rows = spark.createDataFrame([([(1.0, 10.0), (2.0, 20.0), (2.0, 30.0), (4.0, 50.0)],)], "points array<struct<x:double,y:double>>")
    xs = [0.0, 1.0, 1.5, 2.0, 3.0, 9.0]
    got = rows.select(*[scalar.curve_value(F.col("points"), F.lit(x)).alias(f"c{k}") for k, x in enumerate(xs)]).first()
    assert list(got) == [10.0, 10.0, 15.0, 20.0, 40.0, 50.0]


def test_empty_pattern(spark):
    with pytest.raises(ValueError):
        lookup.search(spark.createDataFrame([], "sig string, form_id long, editor_id string, name string"), "")
