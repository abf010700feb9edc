"""Subword-corpus analytics on Spark."""
