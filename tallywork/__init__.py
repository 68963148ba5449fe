"""Spark-native financial controls: every operator takes and returns DataFrames for all entities and periods at once."""
