"""A Spark-native engine for approximate query processing."""
