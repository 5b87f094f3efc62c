"""Tabular data quality control on Spark."""
