"""The similarity of near-dedup: 0.80 for the stage, 0.85 for the query."""

import pytest

from loomrec.llm import near_dedup

LONG = [f"word{k}" for k in range(200)]


def edited(n):
    """LONG with n words changed, 20 apart: 196 shingles, 5 n of them new."""
    return " ".join("x" + w if k % 20 == 10 and k // 20 < n else w for k, w in enumerate(LONG))


def test_stage_links_from_80(spark):
    import corpus_pipeline

    # 176 common of 216 (0.81), and 171 of 221 (0.77).
    rows = [(1, edited(0)), (2, edited(4)), (3, "other " + edited(0).replace("word", "w")), (4, "other " + edited(5).replace("word", "w"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == {1, 3, 4}
    assert {r["doc_id"] for r in near_dedup.near_report(docs, similarity=85).where("kept").collect()} == {1, 2, 3, 4}
    with pytest.raises(ValueError):
        near_dedup.near_report(docs, similarity=79)
