"""Prose-revision analytics and corpus operators on Spark."""
