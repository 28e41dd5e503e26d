"""Readers, writers, materialized views and data generators."""
