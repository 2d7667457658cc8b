"""Spark-native analysis of batches of semi-structured letters."""
