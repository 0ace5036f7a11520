"""Forecast the tail of many curves on Spark, and learn which method to trust."""
