"""Spark-native analytics of long documents."""
