"""Readers that turn text layouts into typed long tables, and the Parquet writer."""
