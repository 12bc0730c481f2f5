"""Reading star-schema tables and grouped files, writing result tables."""

from loomframe.sources.files import read_grouped, table, write_csv

__all__ = ["read_grouped", "table", "write_csv"]
