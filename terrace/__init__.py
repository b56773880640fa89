"""Spark-native analytics over a tiered document knowledge base."""
