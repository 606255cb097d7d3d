"""Spark-native hot-topic and propagation analytics."""
