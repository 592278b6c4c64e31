"""Readers: JDBC, existing tables, parameter-driven batches."""
