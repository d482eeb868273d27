"""Saved-post analytics as Spark DataFrame operators."""
