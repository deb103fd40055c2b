"""A Spark-native analytics engine for learning-support and corpus data."""
