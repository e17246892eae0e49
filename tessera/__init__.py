"""Content scanning and corpus preparation on Spark."""
