"""The driver contract."""

import __spark_entry__


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "chunk_id", "rank", "score"] and df.count() > 0
