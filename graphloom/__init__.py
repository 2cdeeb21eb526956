"""A Spark-native knowledge-graph and retrieval engine."""
