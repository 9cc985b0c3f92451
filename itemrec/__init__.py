"""Recommender data jobs expressed as Spark DataFrame plans."""
