import __spark_entry__


def test_names_and_sql(spark):
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names)
    assert __spark_entry__.entry(spark).columns == ["sig", "form_id", "editor_id", "name", "rank"]
