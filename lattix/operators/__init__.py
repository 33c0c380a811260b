"""Relational building blocks of graph programs."""
