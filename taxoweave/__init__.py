"""Taxonomy alignment and corpus preparation as Spark DataFrame transformations."""
