"""Queries over the driver's tables: the library's operators with an SQL twin where SQL can express them."""
