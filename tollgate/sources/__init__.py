"""Sources and sinks: parquet scans, the fixture mapping, JDBC, feeds, sinks."""
