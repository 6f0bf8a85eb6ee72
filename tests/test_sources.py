"""Sources: JDBC options (no database is started), declared schemas, sink append."""

import pytest

from tollgate.sources import jdbc, sinks
from tollgate.sources.tables import RAW_SCHEMAS, read_table


def test_jdbc_partitioned_options():
    o = jdbc.jdbc_options("jdbc:postgresql://db/x", "sessions", "id", 1, 1000, partitions=4)
    assert o["numPartitions"] == "4" and o["partitionColumn"] == "id" and o["lowerBound"] == "1"
    with pytest.raises(ValueError):
        jdbc.jdbc_options("u", "t", "c", 0, 1, partitions=0)


def test_declared_schema_scan(spark, sf_small):
    df = read_table(spark, sf_small, "orders")
    assert df.schema == RAW_SCHEMAS["orders"]
    assert df.count() > 0


def test_sink_appends(spark):
    df = spark.range(3)
    out = sinks.append_and_read(spark, df, "sink-test", times=2)
    assert out.count() == 6
