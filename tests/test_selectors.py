"""Selectors that name records of every type."""

from loomrec.plans import queries as record_queries
from loomrec.plans.model import BASE


def test_selectors_of_every_type(spark, sf_dir, monkeypatch):
    first = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet").first() for name in ("part", "supplier", "lineitem")}
    line = first["lineitem"]
    named = [(1, str(5 * BASE + first["part"]["p_partkey"]), "PART"), (2, first["supplier"]["s_name"], "SUPP"), (3, f"Line#{line['l_orderkey']}-{line['l_linenumber']}", "LINE")]
    selectors = spark.createDataFrame([x[:2] for x in named], "ordinal long, selector string")
    monkeypatch.setattr(record_queries, "_selectors", lambda spark, d: selectors)
    assert {(r["ordinal"], r["sig"]) for r in record_queries.bulk_get(spark, sf_dir).collect()} == {(n, sig) for n, _, sig in named}
    assert all(r["form_id"] is not None for r in record_queries.selector_resolve(spark, sf_dir).collect())
