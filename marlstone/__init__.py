"""A Spark-native analytics and vector retrieval engine."""
