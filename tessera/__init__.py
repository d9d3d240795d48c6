"""Catalogue, retrieval and decision analytics as Spark DataFrame transformations."""
