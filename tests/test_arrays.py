"""Nested differences: hand-made cases, random arrays against their definition, and the queries against their SQL."""

import json
import random
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from loomrec.operators import arrays, carriers
from loomrec.plans import array_queries

COLUMNS = "k long, old string, new string"


def bodies(spark, rows):
    frame = spark.createDataFrame([(k, a if isinstance(a, str) else json.dumps({"x": a}), b if isinstance(b, str) else json.dumps({"x": b})) for k, a, b in rows], COLUMNS)
    return frame.select("k", F.parse_json("old").alias("old"), F.parse_json("new").alias("new"))


def found(spark, rows, **more):
    out = {}
    for r in arrays.array_pairs(bodies(spark, rows), "k", "x", **more).collect():
        out.setdefault(r["k"], []).append(r)
    return out


def test_strategies_and_keys(spark):
    perks = [{"Perk": "0x1", "Rank": 1}, {"Perk": "0x1", "Rank": 2}]
    parts = [{"Component": {"formid": "0x1", "name": "old"}, "Count": 1}, {"Component": {"formid": "0x2"}, "Count": 2}]
    moved = [{"Component": {"formid": "0x2"}, "Count": 5}, {"Component": {"formid": "0x1", "name": "new"}, "Count": 1}]
    rows = [
        (1, [1, 2, 2], [2, 1, 3]),
        (2, [[1], [2]], [[1], [3]]),
        (3, parts, moved),
        (4, perks, [*perks, {"Perk": "0x1", "Rank": 3}]),
        (5, [*perks, perks[0]], perks),
        (6, [{"Text": "a"}, {"Text": "b"}], [{"Text": "b"}, {"Text": "a"}]),
        (7, [{"Text": "a"}, {"Text": "b"}], [{"Text": "a"}]),
        (8, [1, {"a": 1}], [1]),
        (9, [], [{"Leveled List Entry": {"Item": "0x5", "Level": 3}}]),
        (10, [{"W": {"My Index": 1, "v": 2}}], [{"W": {"My Index": 1, "v": 3}}]),
        (11, [{"name": "n", "type": 1, "value": 2}], [{"name": "n", "type": 1, "value": 3}]),
        (12, [{"a": "0x1", "b": {"formid": "0x2"}, "c": 1}], [{"a": "0x1", "b": {"formid": "0x2"}, "c": 2}]),
        (13, [1, "1", True], [True, "1", 1]),
        (14, [[1], [2, 3]], [[1]]),
        (15, [1], [1]),
        (16, [], []),
        (17, "null", "null"),
        (18, '{"y": 1}', '{"x": [1]}'),
    ]
    got = found(spark, rows)
    strategy = {k: (v[0]["strategy"], v[0]["key_fields"]) for k, v in got.items()}
    assert strategy == {
        1: ("set", None),
        2: ("positional", None),
        3: ("keyed", "Component"),
        4: ("keyed", "Perk,Rank"),
        5: ("unkeyed", None),
        6: ("positional", None),
        7: ("unkeyed", None),
        8: ("unkeyed", None),
        9: ("keyed", "Leveled List Entry/Item,Leveled List Entry/Level"),
        10: ("keyed", "W/My Index"),
        11: ("keyed", "name"),
        12: ("keyed", "a,b"),
        13: ("set", None),
        14: ("unkeyed", None),
    }
    counts = {k: dict(Counter(r["status"] for r in v)) for k, v in got.items()}
    assert counts[1] == {"same": 2, "removed": 1, "added": 1} and counts[13] == {"same": 3}
    assert counts[3] == {"changed": 2} and {(r["index_from"], r["index_to"]) for r in got[3]} == {(0, 1), (1, 0)}
    assert counts[4] == {"same": 2, "added": 1} and counts[5] == {"same": 2, "removed": 1} and counts[8] == {"same": 1, "removed": 1}
    told = {r["k"]: r for r in arrays.envelopes(arrays.array_pairs(bodies(spark, rows), "k", "x"), "k").collect()}
    assert 13 not in told and told[1]["count_from"] == told[1]["count_to"] == 3 and told[1]["unchanged_count"] == 2


def test_no_rows(spark):
    assert arrays.array_pairs(bodies(spark, [(1, [1], [2])]).where("k > 1"), "k", "x").count() == 0
    assert arrays.change_entries(bodies(spark, [(1, [1], [2])]).where("k > 1"), "k").count() == 0


def _longest(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(best[j + 1], row[-1]))
        best = row
    return best[-1]


def test_random_arrays_against_their_definition(spark):
    rnd = random.Random(6)
    rows = [(k, *([rnd.randrange(4) for _ in range(rnd.randrange(9))] for _ in (0, 1))) for k in range(60)]
    sets, ordered = found(spark, rows), found(spark, [(k, [[], *a], [[], [], *b]) for k, a, b in rows])
    for k, a, b in rows:
        of = lambda status, got, side: Counter(json.loads(r[side]) for r in got.get(k, []) if r["status"] == status)
        if a != b:
            assert of("removed", sets, "from") == Counter(a) - Counter(b) and of("added", sets, "to") == Counter(b) - Counter(a)
        same = [r for r in ordered[k] if r["status"] == "same"]
        assert len(same) == 1 + _longest(a, b) and all(r["from"] == r["to"] for r in same)
        places = sorted((r["index_from"], r["index_to"]) for r in same)
        assert places == sorted(places, key=lambda p: p[1])


def test_more_than_the_cells_is_a_bag():
    assert arrays.aligned(list("abc"), list("cba"), 4) == ([], [])
    assert arrays.aligned(list("xabb"), list("ybca"), 4) == ([0, 2], [0, 2])
    assert arrays.aligned(list("abc"), list("cba"), None) == ([0, 1], [1, 2])


def test_carriers_refuse_what_they_cannot_mean(spark):
    frame = bodies(spark, [(1, [], [])])
    with pytest.raises(ValueError, match="record id"):
        carriers.carriers(frame, "k", "old", "x", "$", "0x12")
    with pytest.raises(ValueError, match="scope"):
        carriers.carriers(frame, "k", "old", "x", "$", "12", scope_at="$.s")


@pytest.mark.parametrize("name", sorted(array_queries.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    frame = array_queries.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({array_queries.oracle_sql()[name]})").fetchall()
    assert Counter(tuple(r) for r in frame.select(*columns).collect()) == Counter(want) and want


def test_lines_in_order(spark, sf_dir):
    rows = array_queries.array_ordered(spark, sf_dir).collect()
    lines = {}
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").collect():
        lines.setdefault(r[0], []).append((r[1], r[2], int(r[3])))
    got = {}
    for r in rows:
        got.setdefault(r["l_orderkey"], []).append(r)
    for key, each in lines.items():
        each.sort()
        old, new = [q % 5 for _, _, q in each], [q % 5 for _, p, q in each if p % 3]
        if old == new:
            assert key not in got
            continue
        same = sum(r["status"] == "same" for r in got[key])
        assert same == _longest(old, new) and len(got[key]) == len(old) + len(new) - same


def test_pairs_stay_in_their_row(spark):
    frame = arrays.array_pairs(bodies(spark, [(1, [{"Perk": "0x1", "Rank": 1}], [{"Perk": "0x1", "Rank": 2}])]), "k", "x")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan.replace("sort_array", "")


def test_change_entries_take_bodies_apart_once(spark, monkeypatch):
    jobs = []
    real = arrays.leaves
    monkeypatch.setattr(arrays, "leaves", lambda *a, **b: jobs.append(1) or real(*a, **b))
    rows = [(1, '{"a": {"b": 1}, "c": null, "e": [1]}', '{"a": {"b": 2}, "c": null, "e": []}'), (2, '{"a": 1}', '{"a": 1}'), (3, '{"a": 1}', '{"d": {"formid": "0x1"}}')]
    got = sorted(map(tuple, arrays.change_entries(bodies(spark, rows), "k").select("k", "path", "kind", "from", "to").collect()))
    assert got == [(1, "a.b", "scalar", "1", "2"), (1, "e", "array", "[1]", "[]"), (3, "a", "scalar", "1", None), (3, "d", "formid", None, '{"formid":"0x1"}')]
    assert len(jobs) == 1
