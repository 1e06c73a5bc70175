"""Quire: web-page archiving and corpus processing expressed as Spark jobs."""
