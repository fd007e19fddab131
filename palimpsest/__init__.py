"""Palimpsest: text reuse and corpus processing on Spark."""
