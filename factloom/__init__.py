"""A Spark-native engine for evidence-backed, bitemporal memory."""
