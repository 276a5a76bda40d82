"""Spark-native analytics engine: star-schema queries, equi-join strategies and learned key models."""
