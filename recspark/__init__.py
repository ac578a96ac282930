"""recspark: neighborhood and trust-based recommendation as PySpark DataFrame jobs."""
