"""Sources: each gives fragments (path, source_type, size, attributes, text) from files, exports or table cells."""
