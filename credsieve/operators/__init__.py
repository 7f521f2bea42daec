"""Operators of the scan, each a function from DataFrame to DataFrame or a column expression."""
