"""Readers of graph files and writers of results. Lines are split by Spark's input splits; schemas are fixed, never inferred."""
