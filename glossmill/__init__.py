"""Spark jobs for mining, cleaning and encoding corpora of source code comments."""
