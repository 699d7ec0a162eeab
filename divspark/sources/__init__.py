"""Readers and writers: the driver's parquet tables, labelled CSV files laid out
by run, raw-response and metric-log tables."""
