"""Spark-native analytics for water-level series: harmonic models, datums, tide events, reports."""
