"""Consensus over many noisy versions of the same table, as Spark DataFrame transformations."""
