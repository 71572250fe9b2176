"""Voters come from all labelled rows, whatever the sample of the fit holds."""

from loomrec.llm import toxicity


def test_rare_class_and_many_stems(spark):
    plain = "the quiet river runs past an old stone mill"
    words = [f"{a}{b}zqx" for a in "bcdfghjklm" for b in "bcdfghjklm"]
    # Rare toxic rows, of 100 words in turn: each in 10 of 1,000 toxic rows among 20,000.
    rows = [(k, f"{plain} {words[k // 20 % 100]}" if k % 20 == 0 else f"{plain} w{k % 7}", int(k % 20 == 0)) for k in range(20_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").persist()
    model = toxicity.train(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"), sample_rows=400)
    assert len(model.stems) >= 90
    out = toxicity.score(frame.select("doc_id", "text"), model).join(frame.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] for r in out if r["toxic"]) >= 0.9 * sum(r["toxic"] for r in out)
    assert sum(r["predicted"] for r in out if not r["toxic"]) <= 0.01 * len(out)
