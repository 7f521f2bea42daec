"""Scalar functions of the engine, as column expressions where Spark's built-ins can express them."""
