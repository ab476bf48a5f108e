"""Sources and sinks: driver-table adapters, CSV/Parquet readers and writers."""
