"""Readers and writers."""

from tessera.sources.tables import TABLES, append_time_series, load, read_time_range, write_table

__all__ = ["TABLES", "append_time_series", "load", "read_time_range", "write_table"]
