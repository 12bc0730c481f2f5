"""Tabular analytics on Spark: reshape, group, scan, slide and match tables."""
