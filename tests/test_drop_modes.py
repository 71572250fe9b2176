"""Drop tables of lists in pool mode, and of unknown modes."""

import pytest

from loomrec.operators import odds

ENTRIES = "list_id long, ordinal long, mode string, target long, is_list boolean, p double, quantity double, list_factor double"


def test_drop_table_pool(spark):
    # Even pool of two sure entries, with equal ordinals, and one list that holds it.
    rows = [(1, 0, "pool", 10, False, 1.0, 2.0, 1.0), (1, 0, "pool", 11, False, 1.0, 1.0, 1.0), (2, 0, "pool", 1, True, 0.5, 1.0, 1.0), (2, 1, "pool", 10, False, 0.5, 1.0, 1.0)]
    got = {(r["list_id"], r["item"]): (r["presence"], r["expected"]) for r in odds.drop_tables(spark.createDataFrame(rows, ENTRIES), 2).collect()}
    # Each entry of list 2 is drawn with 0.5 * (0.5 + 0.5 / 2).
    assert got == {(1, 10): pytest.approx((0.5, 1.0)), (1, 11): pytest.approx((0.5, 0.5)), (2, 10): pytest.approx((0.5625, 0.75)), (2, 11): pytest.approx((0.1875, 0.1875))}


def test_drop_table_unknown_mode(spark):
    for mode in ("any", None):
        with pytest.raises(Exception, match="unknown mode"):
            odds.drop_tables(spark.createDataFrame([(1, 0, mode, 10, False, 1.0, 1.0, 1.0)], ENTRIES), 2).collect()
