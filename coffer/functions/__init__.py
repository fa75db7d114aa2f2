"""Scalar column expressions (built-in Spark functions only)."""
