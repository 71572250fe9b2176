"""Queries on changes and bundles against their SQL; splits, labels and streams against plain Python."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomrec.functions.labels import group_label
from loomrec.operators import bundles, changes
from loomrec.plans import change_queries
from loomrec.streaming import snapshots


@pytest.mark.parametrize("name", sorted(change_queries.queries()))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in "nation customer supplier part orders region lineitem".split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    frame = change_queries.queries()[name](spark, sf_dir)
    cursor = con.execute(change_queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    wanted = sorted(cursor.fetchall(), key=repr)
    assert wanted and sorted((tuple(r) for r in frame.select(*names).collect()), key=repr) == wanted


def test_split_against_plain_search(spark):
    rnd = random.Random(8)
    sizes = {1: 30, 2: 12, 3: 5, 4: 25}
    members, links, wanted = [], [], {}
    for component, n in sizes.items():
        nodes = [component * 100 + i for i in range(n)]
        ranks = {v: rnd.randrange(3) for v in nodes[: 1 if component == 4 else 4]}
        members += [(component, v, ranks.get(v)) for v in nodes]
        pairs = {tuple(rnd.sample(nodes[:-1], 2)) for _ in range(n)}
        links += list(pairs)
        if n <= 10 or len(ranks) < 2:
            wanted |= dict.fromkeys(nodes)
            continue
        near = {v: {w for p in pairs for w in p if v in p and w != v} for v in nodes}
        best = {}
        for anchor in ranks:
            front, seen, depth = {anchor}, {anchor}, 0
            while front:
                for v in front:
                    best[v] = min(best.get(v, (99,)), (depth, ranks[anchor], anchor))
                front = {w for v in front for w in near[v]} - seen
                seen |= front
                depth += 1
        foremost = min((r, v) for v, r in ranks.items())[1]
        wanted |= {v: best[v][2] if v in best else foremost for v in nodes}
    rows = spark.createDataFrame(members, "component long, node long, rank long")
    got = bundles.split_oversized(rows, spark.createDataFrame(links, "src long, dst long"), 10)
    assert {r["node"]: r["owner"] for r in got.collect()} == wanted
    assert bundles.split_oversized(rows.limit(0), spark.createDataFrame([], "src long, dst long")).count() == 0


def test_labels(spark):
    label = lambda kind, value: spark.range(1).select(group_label(F.lit(kind), F.lit(value).cast("long")).alias("v")).first()["v"]
    assert label(0, int.from_bytes(b"NPC_", "little")) == "NPC_"
    assert label(4, (0xFFFE << 16) | 3) == "3,-2" and label(3, 0xFFFFFFFF) == "-1" and label(8, 31) == "0x0000001F" and label(11, 7) == "7"


def test_markers(spark):
    rows = spark.createDataFrame([("zzzIron",), ("Poster",), ("post_x",), ("x_ZZZ",), ("zzziron",), ("",), (None,)], "e string")
    got = [r["m"] and tuple(r["m"]) for r in rows.select(changes.marker_of(F.col("e"), ["ZZZ", "POST"]).alias("m")).collect()]
    assert got == [("ZZZ", "medium"), None, ("POST", "medium"), ("ZZZ", "low"), None, None, None]


def test_stream_of_snapshots(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "form_id long, name string"
    for rows in ([(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, "d")], [(2, "c")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        snapshots.follow(stream, "form_id", ["name"], out).awaitTermination()
    got = {(r["batch"], r["form_id"], r["status"]) for r in spark.read.parquet(f"{out}/changes").collect()}
    assert got == {(0, 1, "added"), (0, 2, "added"), (1, 2, "changed"), (1, 3, "added"), (2, 1, "removed"), (2, 3, "removed")}
