"""Lumenframe: a Spark-native analytics engine for media libraries and document collections."""
