"""Sources and sinks: CSV/Parquet scans, written stages, graph export files, model store."""
