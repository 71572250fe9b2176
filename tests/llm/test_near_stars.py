"""What one task has compared is connected already: links are stars, and stars take no step."""

import numpy as np

from loomrec.llm import components, near_dedup


def chain(n):
    """n texts of 200 words, each similar to the one before and the one after only."""
    words = [f"word{k}" for k in range(200)]
    return [" ".join("x" + w if k < 8 * i else w for k, w in enumerate(words)) for i in range(n)]


def test_confirmed_links_are_stars():
    texts = chain(6)
    sets = [set(near_dedup.shingles(near_dedup.word_hashes(t)).tolist()) for t in texts]
    assert [100 * len(sets[0] & s) >= 85 * len(sets[0] | s) for s in sets] == [True, True] + [False] * 4
    rids = np.array([30, 10, 50, 20, 60, 40, 7])
    found = near_dedup._confirmed(rids, np.array([*texts, "something else that stands alone"], dtype=object), 85)
    assert sorted(found) == [(10, 20), (10, 30), (10, 40), (10, 50), (10, 60)]


def test_stars_take_no_step(spark, monkeypatch):
    written = []

    def counted(df, name, drop=(), write=components.write_through):
        written.append(name)
        return write(df, name, drop)

    monkeypatch.setattr(components, "write_through", counted)
    stars = [(1, k) for k in range(2, 40)] + [(50, 51), (51, 50), (50, 50)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 40)} | {50: 50, 51: 50}
    assert len(written) == 1
    # A node whose larger neighbours are two deep, and one with two smaller ones, are settled by steps.
    links = [(1, 2), (2, 3), (3, 4), (9, 7), (9, 8), (8, 6)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 6: 6, 7: 6, 8: 6, 9: 6}
