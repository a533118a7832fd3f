"""Spark-native extraction of structure from web pages and text."""
