"""Prompt records and the catalogue of queries with their SQL."""
