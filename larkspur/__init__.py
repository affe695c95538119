"""A Spark-native columnar scan, expression and statistics library."""
