"""Sources and sinks: file readers, the Parquet store and line writers."""
